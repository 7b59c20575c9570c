"""The event log: keys, idempotent appends, envelopes, roles, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: FIXED VALUES: disclosure codes of a transaction and what they stand for; any other code is OTHER.
TRANSACTION_TYPES = {
    "P": "OPEN_MARKET_PURCHASE", "S": "OPEN_MARKET_SALE", "A": "COMPENSATION_AWARD", "F": "TAX_WITHHOLDING", "M": "OPTION_EXERCISE",
    "X": "OPTION_EXERCISE", "C": "CONVERSION", "G": "GIFT", "W": "TRANSFER", "Z": "TRANSFER",
}

#: FIXED VALUES: what each kind of facts comes from: kind, source name, tier, address.
SOURCES = [
    ("insider", "SEC EDGAR", "A_OFFICIAL", "https://www.sec.gov"), ("holdings", "SEC EDGAR", "A_OFFICIAL", "https://www.sec.gov"), ("short_interest", "FINRA", "A_OFFICIAL", "https://api.finra.org"),
    ("control", "Companies House", "A_OFFICIAL", "https://api.company-information.service.gov.uk"), ("wallet", "blockchain.info", "A_OFFICIAL", "https://blockchain.info"),
    ("volatility", "Cboe Global Markets", "A_OFFICIAL", "https://www.cboe.com"), ("tone", "GDELT Project", "C_PUBLICATION", "https://www.gdeltproject.org"),
]


def natural_key(prefix: str, *columns: str, separators: str = "#") -> Column:
    """A readable reference such as ``form4:<accession>#<index>``."""
    parts: list[Column] = [F.lit(f"{prefix}:")]
    for i, c in enumerate(columns):
        parts += [F.lit(separators[min(i - 1, len(separators) - 1)])] if i else []
        parts.append(F.col(c).cast("string"))
    return F.concat(*parts)


def stable_id(kind: str, *columns: str) -> Column:
    """A key that a rerun makes again: the hash of kind and natural key."""
    return F.sha2(F.concat_ws(":", F.lit(kind), *(F.col(c).cast("string") for c in columns)), 256)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the order must decide, so that reruns agree."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """What an idempotent append adds: one row for each key of the batch that the target does not have.

    The target's keys are not made distinct first: an anti-join needs no distinct side, and that would be a shuffle more.
    """
    return first_per_key(batch.join(target.select(*keys), keys, "left_anti"), keys, order)


def quarantine(batch: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """The rows of a batch that fail a check, with the first reason."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in checks))
    return batch.withColumn("reason", reason).filter("reason IS NOT NULL")


def batch_summary(batch: DataFrame, target: DataFrame, keys: list[str], order: list[Column], is_valid: Column, is_empty: Column | None = None) -> DataFrame:
    """How many rows of a batch are seen, created, duplicate, empty and in error; a bad row never stops the others."""
    empty = F.coalesce(is_empty if is_empty is not None else F.lit(False), F.lit(False))
    bad = ~F.coalesce(is_valid, F.lit(False)) & ~empty
    counts = batch.agg(F.count("*").alias("seen"), F.count_if(empty).alias("empty"), F.count_if(bad).alias("error"))
    created = new_rows(batch.filter(~empty & is_valid), target, keys, order)
    one = counts.crossJoin(created.agg(F.count("*").alias("created")))
    return one.select("seen", "created", (F.col("seen") - F.col("empty") - F.col("error") - F.col("created")).alias("duplicate"), "empty", "error")


def source_kinds(spark) -> DataFrame:
    return spark.createDataFrame(SOURCES, "kind string, name string, tier string, base_url string")


def sources(spark) -> DataFrame:
    """The source dimension: one row a name, however many kinds of facts come from it."""
    return source_kinds(spark).select("name", "tier", "base_url").distinct()


def insider_envelope(transactions: DataFrame) -> DataFrame:
    """Event columns of insider transactions: purchase or sale by direction, type by code, midnight event time."""
    code = F.create_map(*(F.lit(x) for kv in TRANSACTION_TYPES.items() for x in kv))
    return transactions.withColumns(
        {
            "event_type": F.when(F.col("acquired_disposed") == "A", "INSIDER_PURCHASE").otherwise("INSIDER_SALE"),
            "transaction_type": F.coalesce(F.try_element_at(code, F.col("transaction_code")), F.lit("OTHER")),
            "event_ts": F.col("event_time").cast("timestamp"),
        }
    )


def ownership_envelope(rows: DataFrame) -> DataFrame:
    """13D is an activist stake, 13G a major holder's change; more than one filer in a filing makes it joint."""
    filers = W.partitionBy("accession")
    return rows.withColumns(
        {
            "event_type": F.when(F.col("form_type").startswith("SCHEDULE 13D"), "ACTIVIST_STAKE").otherwise("MAJOR_HOLDER_CHANGE"),
            "is_joint": F.size(F.collect_set("filer_id").over(filers)) > 1,
        }
    )


def event_union(*parts: tuple[str, DataFrame, Column, Column, Column]) -> DataFrame:
    """One narrow log of (event_type, entity, event_time, publication_time) from several facts."""
    out = None
    for kind, rows, entity, happened, public in parts:
        one = rows.select(F.lit(kind).alias("event_type"), entity.cast("bigint").alias("entity"), happened.alias("event_time"), public.alias("publication_time"))
        out = one if out is None else out.unionByName(one)
    return out


def roles(transactions: DataFrame) -> DataFrame:
    """Person-company roles after all transactions: the latest flags and non-empty title, the earliest disclosure."""
    order = F.struct("publication_time", "event_id")
    return transactions.groupBy("person_id", "company_id").agg(
        *(F.max_by(c, order).alias(c) for c in ("is_officer", "is_director", "is_ten_percent_owner")), F.max_by("title", F.when(F.col("title") != "", order)).alias("title"), F.min("publication_time").alias("start_date")
    )


def backfill_start(role_rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """start_date where it is null: the first publication of the pair's transactions, if there is one."""
    first = transactions.groupBy("person_id", "company_id").agg(F.min("publication_time").alias("_first"))
    return role_rows.join(first, ["person_id", "company_id"], "left").withColumn("start_date", F.coalesce("start_date", "_first")).drop("_first")


def integrity(rows: DataFrame, *, unique: dict[str, list[str]], ranges: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Violations by rule: rows beyond the first of each key, and values outside their range."""
    out = None
    for rule, keys in unique.items():
        one = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    for rule, (column, low, high) in ranges.items():
        one = rows.agg(F.count_if(~F.col(column).between(low, high)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
