"""Entity resolution: identifiers to entities, by aggregation and joins instead of a lookup for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES: of kinds claimed for one identifier, the later wins.
KIND_PRIORITY = ["OTHER", "COMPANY", "INSTITUTION", "PERSON"]


def entities_by_key(sightings: DataFrame, key: str, name: str, seen_at: Column, *, kind: str, id_type: str) -> DataFrame:
    """One entity for each identifier value; the name that was seen first stays."""
    return (
        sightings.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("id_value"))
        .agg(F.min_by(name, F.struct(seen_at.alias("at"), F.col(name))).alias("canonical_name"))
        .withColumns({"entity_key": F.sha2(F.concat_ws(":", F.lit(id_type), "id_value"), 256), "kind": F.lit(kind), "id_type": F.lit(id_type)})
    )


def unseen(candidates: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Candidates whose (id_type, id_value) no known identifier has."""
    return candidates.join(identifiers.select("id_type", "id_value").distinct(), ["id_type", "id_value"], "left_anti")


def by_ticker(requests: DataFrame, identifiers: DataFrame) -> DataFrame:
    """ticker to company: any holder of the upper-cased ticker (the smallest id of several), else a new key."""
    known = identifiers.groupBy(F.upper("ticker").alias("ticker")).agg(F.min("company_id").alias("known_id"))
    own = requests.select(F.upper("ticker").alias("ticker")).distinct()
    return own.join(known, "ticker", "left").select("ticker", F.coalesce(F.col("known_id").cast("string"), F.concat(F.lit("new:"), "ticker")).alias("company_key"))


def person_kinds(claims: DataFrame) -> DataFrame:
    """One kind for each CIK out of all that were claimed: a person's claim corrects every other."""
    order = F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), F.col("kind"))
    return claims.groupBy("cik").agg(F.max_by("kind", order).alias("kind"), F.count_distinct("kind").alias("n_kinds"))


def filer_keys(rows: DataFrame) -> DataFrame:
    """13D/G filers: by CIK where there is one (IN is a person), else by exact name among the others."""
    has = F.col("filer_cik").isNotNull()
    key = F.when(has, F.concat(F.lit("cik:"), F.col("filer_cik").cast("string"))).otherwise(F.concat(F.lit("name:"), F.col("filer_id").cast("string")))
    kind = F.when(has & (F.col("type_code") == "IN"), "PERSON").otherwise("OTHER")
    order = F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), kind)
    return rows.select(key.alias("filer_key"), kind.alias("kind"), order.alias("o")).groupBy("filer_key").agg(F.max_by("kind", "o").alias("kind"), F.count("*").alias("n_rows"))


def control_persons(rows: DataFrame, home: list[str]) -> DataFrame:
    """Register entries to identifiers: a home company by number, anyone else by the register's own link."""
    is_home = F.lower(F.trim("country_registered")).isin(home)
    company = (F.col("psc_kind") == "corporate") & is_home
    return rows.select(
        "psc_id",
        F.when(company, "COMPANY_NUMBER").otherwise("ALIAS").alias("id_type"),
        F.when(company, F.concat(F.lit("GB"), F.col("psc_id").cast("string"))).otherwise(F.concat(F.lit("psc:"), F.col("psc_id").cast("string"))).alias("id_value"),
        F.when(company, "COMPANY").when(F.col("psc_kind") == "individual", "PERSON").otherwise("OTHER").alias("entity_kind"),
    )


def funds(snapshots: DataFrame) -> DataFrame:
    """One row a fund: the series name that was filed last and is not null."""
    filed = F.struct("publication_time", "series_name")
    return snapshots.groupBy("fund_id").agg(F.max_by("series_name", F.when(F.col("series_name").isNotNull(), filed)).alias("series_name"), F.count("*").alias("n_snapshots"))


BLOCK = 8  # a block of one level is so many of the level below
LEVELS = 8  # the largest blocks are 8^7 days, and two of them hold every date of the years 1 to 9999


def day_number(at: Column) -> Column:
    return F.datediff(at, F.lit("0001-01-01").cast("date"))


def covering_blocks(low: Column, high: Column) -> Column:
    """The fewest aligned blocks of days (level, block) that make up the days from low to high, both included.

    A level has its blocks that lie within the interval, less those that the level above covers: at most fourteen.
    """
    levels = []
    of_level = lambda k: lambda b: F.struct(F.lit(k).alias("level"), b.alias("block"))
    inside = [(F.ceil(low / BLOCK**k), F.floor((high + 1) / BLOCK**k)) for k in range(LEVELS)]
    none = F.array().cast("array<bigint>")
    run = lambda first, end: F.when(first < end, F.sequence(first.cast("bigint"), end.cast("bigint") - 1)).otherwise(none)
    for k, (first, end) in enumerate(inside):
        blocks = run(first, end)
        if k + 1 < LEVELS:
            over, past = inside[k + 1]
            blocks = F.when(over < past, F.concat(run(first, over * BLOCK), run(past * BLOCK, end))).otherwise(blocks)
        levels.append(F.transform(blocks, of_level(k)))
    return F.concat(*levels)


def valid_on(rows: DataFrame, identifiers: DataFrame, on: str) -> DataFrame:
    """rows joined to the identifier that was valid on the row's date; both ends count, open ends are null.

    An interval is cut into aligned blocks of 1, 8, 64, ... days, and a date lies in one block of each size, so the join
    is one of equal (ticker, level, block), which a pair meets in once at most, however many intervals its ticker has. Only
    the distinct (ticker, date) of the rows are taken through it, at eight keys each: a hot ticker's large blocks are then
    keys of as many rows as it has days, not transactions. The rows are joined with what was found for their ticker and
    date, so they are sent once and spread over their days. A row without a date or ticker, and an interval that ends
    before it starts, match nothing.
    """
    day = day_number(F.col(on))
    keys = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(day / BLOCK**k).cast("bigint").alias("block")) for k in range(LEVELS)))
    low = F.coalesce(day_number(F.col("valid_from")), F.lit(0))
    high = F.coalesce(day_number(F.col("valid_to")), day_number(F.lit("9999-12-31").cast("date")))
    cut = identifiers.withColumn("_at", F.explode(covering_blocks(low, high)))
    dates = rows.select("ticker", on).dropna().distinct().withColumn("_at", F.explode(keys))
    found = dates.join(cut, ["ticker", "_at"]).drop("_at")
    return rows.join(found, ["ticker", on])


def worklist(explicit: DataFrame, companies: DataFrame) -> DataFrame:
    """An explicit list (cik, pos), then the companies' CIKs that it lacks, in order, each once."""
    both = explicit.select(F.lit(0).alias("part"), "pos", "cik").unionByName(companies.select(F.lit(1).alias("part"), F.col("cik").alias("pos"), "cik"))
    return both.groupBy("cik").agg(F.min(F.struct("part", "pos")).alias("at")).select("cik", F.col("at.part").alias("part"), F.col("at.pos").alias("pos"))
