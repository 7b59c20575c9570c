"""Alert rules over all scored companies, de-duplicated by rule, company and day, with an outbox of payloads.

Rules are joined without hints: written by hand they are few, and Spark broadcasts what it knows to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES: rule kinds and the score family that each watches.
FAMILIES = {"INSIDER_THRESHOLD": "insider", "INSTITUTIONAL_THRESHOLD": "institution", "SHORT_INTEREST_THRESHOLD": "short_interest"}
LABEL_RULE = "CONVERGENCE_LABEL"

RULE = "name string, version int, rule_type string, min_score double, labels array<string>, webhook_url string, webhook_format string"


def is_valid():
    return F.when(F.col("rule_type") == LABEL_RULE, F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0).otherwise(
        F.col("rule_type").isin(list(FAMILIES)) & F.col("min_score").isNotNull()
    )


def current_rules(changes: DataFrame) -> DataFrame:
    """The newest version of each rule by name, active again by that, and whether it is valid."""
    fields = [c for c in changes.columns if c != "name"]
    newest = changes.groupBy("name").agg(F.max_by(F.struct(*fields), "version").alias("r"))
    return newest.select("name", "r.*").withColumns({"is_active": F.lit(True), "is_valid": is_valid()})


def listing(alerts: DataFrame, *, rule: str | None = None, company=None) -> DataFrame:
    """Alerts, of one rule or company if asked for, newest first."""
    for column, value in (("name", rule), ("company_id", company)):
        alerts = alerts if value is None else alerts.filter(F.col(column) == F.lit(value))
    return alerts.orderBy(F.col("alert_date").desc(), "name", "company_id")


def shown(rules: DataFrame) -> DataFrame:
    """Rules as they are listed: the address only as a yes or no."""
    return rules.withColumn("has_webhook", F.col("webhook_url").isNotNull()).drop("webhook_url")


def threshold_hits(rules: DataFrame, scores: DataFrame) -> DataFrame:
    """scores (family, company_id, composite, ...) that reach a rule's least score; a null never does."""
    family = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    watched = rules.filter(F.col("is_valid") & F.col("rule_type").isin(list(FAMILIES))).withColumn("family", F.try_element_at(family, F.col("rule_type")))
    hits = scores.join(watched.select("family", "name", "min_score"), "family").filter(F.col("composite") >= F.col("min_score"))
    said = F.concat(F.col("family"), F.lit(" score "), F.format_number("composite", 1), F.lit(" reaches "), F.format_number("min_score", 1))
    return hits.select("name", "company_id", "composite", said.alias("summary"), "family")


def label_hits(rules: DataFrame, table: DataFrame) -> DataFrame:
    """Convergence rows whose label a rule watches; they carry no composite, and rest on all families."""
    watched = rules.filter(F.col("is_valid") & (F.col("rule_type") == LABEL_RULE)).select("name", F.explode("labels").alias("label")).distinct()
    hits = table.join(watched, "label")
    return hits.select("name", "company_id", F.lit(None).cast("double").alias("composite"), F.col("label").alias("summary"), F.lit(None).cast("string").alias("family"))


def with_evidence(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """hits with evidence_ids: the ids of evidence (family, company_id, evidence_id) of the hit's family, or of all.

    Only what belongs to a company that was hit is gathered.
    """
    keys = hits.select("name", "company_id", F.col("family").alias("hit_family"))
    found = evidence.join(keys, "company_id").filter(F.col("hit_family").isNull() | (F.col("hit_family") == F.col("family")))
    ids = found.groupBy("name", "company_id").agg(F.sort_array(F.collect_list(F.struct("family", "evidence_id"))).alias("found"))
    none = F.array().cast("array<string>")
    return hits.join(ids, ["name", "company_id"], "left").withColumn("evidence_ids", F.coalesce(F.transform("found", lambda x: x["evidence_id"]), none)).drop("found", "family")


def new_alerts(hits: DataFrame, known: DataFrame, as_of) -> DataFrame:
    """Hits of the day that no alert of the same rule, company and day has."""
    dated = hits.withColumn("alert_date", F.lit(as_of).cast("date")).dropDuplicates(["name", "company_id", "alert_date"])
    return dated.join(known.select("name", "company_id", "alert_date"), ["name", "company_id", "alert_date"], "left_anti")


def rule_errors(rules: DataFrame) -> DataFrame:
    """Rules that can't be evaluated; the others are not held up by them."""
    return rules.filter(~F.col("is_valid")).select("name", F.concat(F.lit("invalid rule of type "), F.col("rule_type")).alias("error"))


def evaluated(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts created by each valid rule, none included."""
    counts = alerts.groupBy("name").agg(F.count("*").alias("n"))
    return rules.filter("is_valid").select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("created"))


def payloads(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """An outbox row for each alert with an address: chat text, or JSON of nine fields with nulls kept.

    alerts has evidence_ids, as with_evidence() gives them.
    """
    rows = alerts.join(rules.filter("webhook_url IS NOT NULL").select("name", "webhook_url", "webhook_format"), "name")
    rule_id, alert_id = F.sha2("name", 256), F.sha2(F.concat_ws(":", "name", F.col("company_id").cast("string"), F.col("alert_date").cast("string")), 256)
    generic = F.to_json(
        F.struct(
            rule_id.alias("rule_id"), F.col("name").alias("rule_name"), alert_id.alias("alert_id"), F.col("company_id").cast("string").alias("company_entity_id"),
            F.col("alert_date").cast("string").alias("alert_date"), F.concat(F.col("alert_date").cast("string"), F.lit("T00:00:00+00:00")).alias("triggered_at"),
            F.col("composite").alias("composite_score"), F.col("summary").alias("signal_summary"), F.col("evidence_ids").alias("source_event_ids"),
        ),
        {"ignoreNullFields": "false"},
    )
    chat = F.to_json(F.struct(F.concat(F.lit("*"), F.col("name"), F.lit("* fired for `"), F.col("company_id").cast("string"), F.lit("` on "), F.col("alert_date").cast("string"), F.lit(": "), F.col("summary")).alias("text")))
    return rows.select("name", "company_id", "alert_date", "webhook_url", F.when(F.col("webhook_format") == "SLACK", chat).otherwise(generic).alias("payload"))
