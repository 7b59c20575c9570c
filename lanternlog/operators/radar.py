"""Rankings over the scores, and where independent signals agree or disagree."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring

#: FIXED VALUES: labels and their rank in the convergence table.
LABEL_RANK = {
    "INSIDER_AND_INSTITUTIONAL_ACCUMULATING": 0, "MIXED_INSIDER_BUYING_INSTITUTIONAL_SELLING": 1, "INSIDER_ONLY": 2, "INSTITUTIONAL_ONLY": 2, "SHORT_INTEREST_ONLY": 3,
}


def checked(*, window_days: int = 90, lookback_days: int = 730, cycles: int = 12, top_n: int = 25) -> None:
    """The ranges that a radar's parameters must keep to."""
    for name, value, most in (("window_days", window_days, 3650), ("lookback_days", lookback_days, 36500), ("cycles", cycles, 200), ("top_n", top_n, 500)):
        if not 1 <= value <= most:
            raise ValueError(f"{name} must be between 1 and {most}, not {value}")


def top(scores: DataFrame, n: int = 25) -> DataFrame:
    """The n highest composites, nulls last, ties by company."""
    checked(top_n=n)
    return scores.orderBy(F.col("composite").desc_nulls_last(), "company_id").limit(n)


def insider_candidates(transactions: DataFrame, as_of: date, window_days: int = 90) -> DataFrame:
    from datetime import timedelta

    return scoring.in_window(scoring.discretionary(transactions, as_of), as_of - timedelta(window_days), as_of).select("company_id").distinct()


def institution_candidates(changes: DataFrame, as_of: date, window_days: int = 365) -> DataFrame:
    from datetime import timedelta

    rows = scoring.in_window(scoring.public_holdings(changes, as_of), as_of - timedelta(window_days), as_of)
    return rows.filter(F.col("position_status").isin(scoring.ACCUMULATING)).select("company_id").distinct()


def short_interest_candidates(snapshots: DataFrame, as_of: date) -> DataFrame:
    """Companies whose newest public cycle rose."""
    public = snapshots.filter(F.col("publication_time") <= F.lit(as_of))
    return public.groupBy("company_id").agg(F.max_by("change_percent", "settlement_date").alias("latest")).filter("latest > 0").select("company_id")


def label(has_insider, accumulating, distributing, has_institution):
    """Short interest never changes the first four labels."""
    return (
        F.when(has_insider & (accumulating > 0), "INSIDER_AND_INSTITUTIONAL_ACCUMULATING")
        .when(has_insider & (distributing > 0), "MIXED_INSIDER_BUYING_INSTITUTIONAL_SELLING")
        .when(has_insider, "INSIDER_ONLY")
        .when(accumulating > 0, "INSTITUTIONAL_ONLY")
        .otherwise("SHORT_INTEREST_ONLY")
    )


def convergence(insider: DataFrame, institution: DataFrame, short_interest: DataFrame, directions: DataFrame) -> DataFrame:
    """Every company that any family scores, with the three composites side by side, a label and its rank."""
    one = insider.select("company_id", F.col("composite").alias("insider_composite"), F.lit(True).alias("_insider"))
    two = institution.select("company_id", F.col("composite").alias("institution_composite"), F.lit(True).alias("_institution"))
    three = short_interest.select("company_id", F.col("composite").alias("short_interest_composite"))
    rows = one.join(two, "company_id", "full_outer").join(three, "company_id", "full_outer").join(directions, "company_id", "left")
    none = F.lit(0)
    kind = label(F.coalesce("_insider", F.lit(False)), F.coalesce("accumulating", none), F.coalesce("distributing", none), F.coalesce("_institution", F.lit(False)))
    rank = F.create_map(*(F.lit(x) for kv in LABEL_RANK.items() for x in kv))
    return rows.withColumn("label", kind).select(
        "company_id", "insider_composite", "institution_composite", "short_interest_composite", "label", F.element_at(rank, F.col("label")).cast("bigint").alias("rank")
    )


def convergence_top(rows: DataFrame, n: int = 25) -> DataFrame:
    checked(top_n=n)
    return rows.orderBy("rank", "company_id").limit(n)


def label_shares(rows: DataFrame) -> DataFrame:
    """How many companies carry each label, and their share of all."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))


def overview(companies: DataFrame, alerts: DataFrame, interlocks: DataFrame, levels: DataFrame) -> DataFrame:
    """One row of counts, and the newest close of the index. ``interlocks`` is a row that has their number."""
    latest = levels.agg(F.max_by("close", "trade_date").alias("latest_close"))
    return (
        companies.agg(F.count("*").alias("companies"))
        .crossJoin(alerts.agg(F.count("*").alias("alerts")))
        .crossJoin(interlocks)
        .crossJoin(latest)
    )


def search(companies: DataFrame, query: str, n: int = 8) -> DataFrame:
    """Companies with the query in name, sector or country, by its place in the name; not in the name comes first."""
    q = query.lower()
    place = F.instr(F.lower("canonical_name"), q)
    hit = (place > 0) | (F.instr(F.lower("sector"), q) > 0) | (F.instr(F.lower("country"), q) > 0)
    return companies.filter(hit).withColumn("position", (place - 1).cast("bigint")).orderBy("position", "entity_id").limit(n)
