"""Streaming queries over the given tables: rows are laid down as landed files and go through a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive
from ..streaming import ingest, keyed, outbox, portfolio
from .core import AS_OF, CH, CONV, ENTITY_SQL, HITS, ROLES_SQL, D, Facts, entity_columns, evidence_columns, query, rules, sightings, titled
from .store import stored, workspace
from .views import base, view


ROWS_A_FILE = 2_000_000


def landing_files(spark, d, table: str = "lineitem", least: int = 6) -> int:
    """How many files a stream's rows are laid down in: it follows the rows of the table that they come from."""
    return max(least, -(-base(spark, d, table).count() // ROWS_A_FILE))


@query("st01_streamed_append", "SELECT accession, txn_index, count(*) AS n FROM (SELECT DISTINCT accession, txn_index FROM tb_form4_raw) GROUP BY 1, 2")
def st01(spark, d):
    folder, raw = workspace(spark, "stream"), view(spark, d, "tb_form4_raw")
    files = landing_files(spark, d)
    # landed in order of accession numbers, as filings come in; equal ranges, as to sample them would be to make the view twice
    last = base(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0
    raw.repartitionById(files, F.floor(F.col("accession") * files / (last + 1)).cast("int")).write.parquet(f"{folder}/landing")
    stream = ingest.landing(spark, f"{folder}/landing", raw.schema, files_per_batch=max(2, files // 12))
    part = F.floor(F.col("accession") / max(10_000, last // 256))
    ingest.appended_once(stream, f"{folder}/target", f"{folder}/state", ["accession", "txn_index"], [F.col("l_partkey"), F.col("company_id"), F.col("shares")], part).awaitTermination()
    return ingest.read_target(spark, f"{folder}/target", raw.schema).groupBy("accession", "txn_index").agg(F.count("*").alias("n"))


@query("st02_streamed_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def st02(spark, d):
    folder = workspace(spark, "stream")
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartitionByRange("ts").write.parquet(f"{folder}/landing")
    stream = ingest.landing(spark, f"{folder}/landing", events.schema)
    totals = ingest.window_totals(stream, "ts", "event_type", F.col("value"), "1 day", "0 seconds")
    totals.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(totals.schema).parquet(f"{folder}/out")
    return out.select(F.col("window_start").cast("date").alias("day"), "event_type", F.round("total", 4).alias("total"), "n")


def kept_by_stream(spark, d, rows, merge, partials):
    """The state that a stream of rows, landed in files in no order of time, leaves after several batches."""
    folder = workspace(spark, "stream")
    files = landing_files(spark, d)
    rows.repartition(files, F.xxhash64("event_id")).write.parquet(f"{folder}/landing")
    stream = ingest.landing(spark, f"{folder}/landing", rows.schema, files_per_batch=-(-files // 3))
    state = keyed.KeyedState(spark, f"{folder}/state", merge(partials(rows)).schema, merge, parts=16)
    keyed.follow(stream, state, partials, f"{folder}/progress", compact_every=2).awaitTermination()
    return state.read()


@query("e02_streamed_entities", ENTITY_SQL)
def e02_streamed(spark, d):
    rows = view(spark, d, "tb_form4").select("event_id", "accession", "company_id", "person_id", "transaction_code", "publication_time")
    return entity_columns(kept_by_stream(spark, d, rows, keyed.ENTITIES, lambda batch: keyed.entity_partials(sightings(batch))))


@query("e14_streamed_roles", ROLES_SQL)
def e14_streamed(spark, d):
    rows = titled(spark, d).select("event_id", "person_id", "company_id", "publication_time", *keyed.FLAGS, "title")
    return keyed.roles(kept_by_stream(spark, d, rows, keyed.ROLES, keyed.role_partials))


@query(
    "a06_streamed_outbox",
    f"WITH {CONV}, {HITS} SELECT name, company_id, {D} AS alert_date, composite, n_evidence, first_evidence, last_evidence, CASE WHEN name = 'insider strong' THEN concat('insider strong/', company_id) END AS sent FROM th JOIN he USING (name, company_id)",
)
def a06_streamed(spark, d):
    """Alerts that a stream of scores makes, and what of them is in the outbox, by its payload."""
    facts, folder, r = Facts(spark, d), workspace(spark, "stream"), rules(spark)
    scores = facts.families
    scores.repartition(6, F.xxhash64("company_id")).write.parquet(f"{folder}/landing")
    box = outbox.Outbox(spark, f"{folder}/box")
    stream = ingest.landing(spark, f"{folder}/landing", scores.schema, files_per_batch=2)
    outbox.alerted(stream, r, stored(facts.evidence()), box, AS_OF, f"{folder}/state").awaitTermination()
    said = F.from_json("payload", "rule_name string, company_entity_id string")
    sent = box.outbox().select("name", "company_id", F.concat_ws("/", said["rule_name"], said["company_entity_id"]).alias("sent"))
    return box.alerts().join(sent, ["name", "company_id"], "left").select("name", "company_id", "alert_date", "composite", *evidence_columns(), "sent")


@query("d02_streamed_amendments", f"WITH {CH} SELECT institution_id, period_of_report, company_id, shares, market_value_usd, shares_change, position_status FROM ch")
def d02_streamed(spark, d):
    """Position changes by a stream of filings in no order of time; every third portfolio was first filed with doubled shares and positions left out."""
    folder, whole = workspace(spark, "stream"), stored(derive.quarter_holdings(view(spark, d, "tb_13f_raw")))
    wrong = (F.col("institution_id") + F.quarter("period_of_report")) % 3 == 0
    named = lambda rows, form, lag: rows.withColumns({"accession": F.concat_ws("-", "institution_id", "period_of_report", F.lit(form)), "filed": F.date_add("period_of_report", lag)})
    first = named(whole.filter(~wrong | (F.col("company_id") % 5 != 0)).withColumn("shares", F.when(wrong, F.col("shares") * 2).otherwise(F.col("shares")).cast("decimal(28,4)")), "HR", 45)
    filings = first.unionByName(named(whole.filter(wrong), "HR-A", 75))
    files = landing_files(spark, d)
    filings.repartition(files, F.xxhash64("accession")).write.parquet(f"{folder}/landing")
    kept = portfolio.Portfolios(spark, f"{folder}/portfolios", parts=4)
    portfolio.follow(ingest.landing(spark, f"{folder}/landing", filings.schema, files_per_batch=-(-files // 3)), kept, f"{folder}/state").awaitTermination()
    return kept.read().select("institution_id", "period_of_report", "company_id", *(F.col(c).cast("double").alias(c) for c in ("shares", "market_value_usd", "shares_change")), "position_status")
