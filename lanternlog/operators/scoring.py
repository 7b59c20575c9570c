"""Explainable scores of each company against its own history: insiders, institutions, short interest.

All companies are scored at once: windows and history buckets are columns, not queries. A company without a qualifying
row in the window has no row here.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSIDER_WEIGHTS = {"size_vs_history": 0.35, "breadth": 0.30, "persistence": 0.15, "discretion": 0.20}
INSTITUTION_WEIGHTS = {"magnitude_vs_history": 0.35, "breadth": 0.30, "consensus": 0.20, "new_money_share": 0.15}
SHORT_INTEREST_WEIGHTS = {"magnitude_vs_history": 0.40, "days_to_cover_vs_history": 0.35, "persistence": 0.25}
ACCUMULATING, DISTRIBUTING = ["NEW", "INCREASED"], ["DECREASED", "EXITED"]


# --- history and anomaly -------------------------------------------------------------------------------------------


def bucket(event_time: Column, window_start: date | datetime, window_days: int) -> Column:
    """Number of the half-open window before window_start that a time lies in, 0 the nearest; negative after it.

    Times are compared to the microsecond; a date is its first moment.
    """
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    before = micros(F.lit(window_start)) - micros(event_time) - 1
    return F.floor(before / F.lit(window_days * 86_400_000_000)).cast("int")


def window_and_history(rows: DataFrame, as_of: date | datetime, window_days: int, lookback_days: int) -> DataFrame:
    """rows of the window (k = -1) and of the floor(lookback / window) windows before it (k = 0, 1, ...); others are gone."""
    n = lookback_days // window_days
    k = F.greatest(bucket(F.col("event_time"), as_of - timedelta(window_days), window_days), F.lit(-1))
    return rows.filter(F.col("event_time") < F.lit(as_of)).withColumn("k", k).filter(F.col("k") < n)


def of_window(column: str | Column) -> Column:
    """A bucket's value in the window's row, for an aggregation over a company's buckets."""
    return F.max(F.when(F.col("k") == -1, column if isinstance(column, Column) else F.col(column)))


def history_of(amount: str, n: int) -> Column:
    """The amounts of the n windows before, 0 where nothing happened; their order does not matter."""
    return padded(F.collect_list(F.when(F.col("k") >= 0, F.coalesce(F.col(amount).cast("double"), F.lit(0.0)))), n)


def padded(some: Column, n: int) -> Column:
    """An array filled up to n with zeros; null counts as empty."""
    have = F.coalesce(some, F.array().cast("array<double>"))
    return F.concat(have, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(have)))


def middle(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def percentile_of(values: Column, value: Column) -> Column:
    """Share of values that are not above value."""
    return F.size(F.filter(values, lambda x: x <= value)) / F.size(values)


def robust_z(values: Column, value: Column) -> Column:
    """0.6745 (value - median) / MAD; without spread 0 at the median and 10 either way elsewhere."""
    m = middle(values)
    mad = middle(F.transform(values, lambda x: F.abs(x - m)))
    flat = F.when(value == m, 0.0).when(value > m, 10.0).otherwise(-10.0)
    return F.when(mad == 0, flat).otherwise(F.lit(0.6745) * (value - m) / mad)


def clamp(x: Column) -> Column:
    """x within 0 and 100; null stays null, which greatest() and least() would pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)))


def composite(weights: dict[str, float]) -> Column:
    """Weighted mean of the components that are not null."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name) * w, F.lit(0.0))
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, total / weight)


def components(weights: dict[str, float], said: dict[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(w).alias("weight"), said[n].alias("explanation")) for n, w in weights.items()))


def against_history(value: str, least: int) -> dict[str, Column]:
    """baseline_n, baseline_percentile and baseline_z of a column against its history; null under the least length."""
    enough = F.size("history") >= least
    return {
        "baseline_n": F.size("history").cast("bigint"),
        "baseline_percentile": F.when(enough, percentile_of(F.col("history"), F.col(value))),
        "baseline_z": F.when(enough, robust_z(F.col("history"), F.col(value))),
    }


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 0))


def notes(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, text) for c, text in pairs)))


def text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


# --- insiders ------------------------------------------------------------------------------------------------------


def amount() -> Column:
    """shares * price without loss of scale; null where the price is unknown."""
    return F.col("shares").cast("decimal(18,4)") * F.col("price").cast("decimal(18,4)")


def discretionary(transactions: DataFrame, as_of: date | datetime) -> DataFrame:
    """Open-market purchases that were public by as_of."""
    return transactions.filter((F.col("acquired_disposed") == "A") & (F.col("transaction_code") == "P") & (F.col("publication_time") <= F.lit(as_of)))


def in_window(rows: DataFrame, start: date | datetime, end: date | datetime) -> DataFrame:
    return rows.filter((F.col("event_time") >= F.lit(start)) & (F.col("event_time") < F.lit(end)))


ROLES = ("is_officer", "is_director", "is_ten_percent_owner")


def insider_buckets(transactions: DataFrame, roles: DataFrame, as_of: date | datetime, window_days: int, lookback_days: int) -> DataFrame:
    """Per company and bucket: dollars, transactions, priced ones, distinct and senior insiders, plan dollars.

    One pass over the transactions: they are summed for each person first, so that distinct people are rows, and roles
    are joined to those. Senior is who is an officer, a director or an owner of ten percent.
    """
    rows = window_and_history(discretionary(transactions, as_of), as_of, window_days, lookback_days)
    people = rows.groupBy("company_id", "k", "person_id").agg(
        F.sum(amount()).alias("total"), F.count("*").alias("transactions"), F.count("price").alias("priced"), F.sum(F.when(F.col("is_10b5_1"), amount())).alias("plan")
    )
    senior = F.coalesce(*(F.when(F.col(c), F.lit(True)) for c in ROLES), F.lit(False))
    known = roles.select("person_id", "company_id", senior.alias("is_senior"))
    return (
        people.join(known, ["person_id", "company_id"], "left")
        .groupBy("company_id", "k")
        .agg(
            F.sum("total").alias("total"), F.sum("transactions").alias("transactions"), F.sum("priced").alias("priced"), F.count("*").alias("insiders"),
            F.count_if(F.col("is_senior")).alias("senior"), F.sum("plan").alias("plan"),
        )
    )


def insider_window(transactions: DataFrame, roles: DataFrame, as_of: date | datetime, window_days: int, lookback_days: int = 0) -> DataFrame:
    """Per company with a purchase in the window: the window's sums and counts, and the history of dollars."""
    counts = ("transactions", "priced", "insiders", "senior")
    return (
        insider_buckets(transactions, roles, as_of, window_days, lookback_days)
        .groupBy("company_id")
        .agg(
            F.coalesce(of_window("total").cast("double"), F.lit(0.0)).alias("window_total"), *(of_window(c).alias(c) for c in counts),
            F.coalesce(of_window("plan").cast("double"), F.lit(0.0)).alias("plan_total"), history_of("total", lookback_days // window_days).alias("history"),
        )
        .filter("transactions IS NOT NULL")
    )


def insider_evidence(transactions: DataFrame, roles: DataFrame, as_of: date | datetime, window_days: int = 90) -> DataFrame:
    """The purchases that a score rests on, a row each: who, in which roles, when, how much, and where it was disclosed."""
    rows = in_window(discretionary(transactions, as_of), as_of - timedelta(window_days), as_of)
    known = roles.select("person_id", "company_id", *ROLES)
    url = F.col("source_url") if "source_url" in transactions.columns else F.lit(None).cast("string").alias("source_url")
    return rows.join(known, ["person_id", "company_id"], "left").select(
        "company_id", "event_time", "event_id", "person_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ROLES), "shares", "price", amount().alias("dollars"), F.col("is_10b5_1").alias("plan"), url, "accession"
    )


def insider_scores(transactions: DataFrame, roles: DataFrame, companies: DataFrame, as_of: date | datetime, *, window_days: int = 90, lookback_days: int = 730, least: int = 4) -> DataFrame:
    """A row for each company with a purchase in the window; insider_evidence() has the rows that it rests on."""
    start = as_of - timedelta(window_days)
    out = insider_window(transactions, roles, as_of, window_days, lookback_days)
    out = out.withColumns(against_history("window_total", least)).withColumns(
        {
            "size_vs_history": clamp(F.col("baseline_percentile") * 100),
            "breadth": F.least(F.lit(100.0), 25.0 * F.col("insiders") + 15.0 * F.col("senior")),
            "persistence": clamp((F.col("transactions") / F.col("insiders") - 1) * 50),
            "plan_share": F.when(F.col("window_total") > 0, F.col("plan_total") / F.col("window_total")).otherwise(0.0),
        }
    )
    out = out.withColumn("discretion", F.greatest(F.lit(0.0), 100 - 60 * F.col("plan_share")))
    short = F.col("baseline_n") < least
    said = {
        "size_vs_history": F.when(short, text("History is too short: ", F.col("baseline_n").cast("string"), " window(s).")).otherwise(
            text(dollars(F.col("window_total")), " bought; percentile ", F.format_number(F.col("baseline_percentile") * 100, 0), " of own windows, robust z ", F.format_number("baseline_z", 1), ".")
        ),
        "breadth": text(F.col("insiders").cast("string"), " buyer(s), ", F.col("senior").cast("string"), " of them senior."),
        "persistence": text(F.format_number(F.col("transactions") / F.col("insiders"), 1), " purchase(s) a buyer."),
        "discretion": text(F.format_number(F.col("plan_share") * 100, 0), "% of the dollars bought under a plan."),
    }
    complete = F.col("priced") / F.col("transactions")
    enough = F.least(F.lit(1.0), F.col("baseline_n") / least) if least else F.lit(1.0)
    return companies.select(F.col("entity_id").alias("company_id"), F.col("canonical_name").alias("company_name")).join(
        out.withColumns(
            {
                "composite": composite(INSIDER_WEIGHTS),
                "confidence": F.least(complete, 0.5 + 0.5 * enough),
                "components": components(INSIDER_WEIGHTS, said),
                "notes": notes(
                    (complete < 1, text((F.col("transactions") - F.col("priced")).cast("string"), " transaction(s) without a price are left out of the dollars.")),
                    (short, F.lit("The history is too short for a comparison.")),
                ),
                "explanation": F.array(text(F.col("insiders").cast("string"), " insider(s), ", F.col("transactions").cast("string"), " purchase(s), ", dollars(F.col("window_total")), "."), *said.values()),
                "window_start": F.lit(start),
            }
        ),
        "company_id",
    )


# --- institutions --------------------------------------------------------------------------------------------------


def accumulated() -> Column:
    """Dollars that a holding adds: all of a new one, the added shares at the holding's own price for a grown one."""
    price = F.col("market_value_usd").cast("double") / F.nullif(F.col("shares").cast("double"), F.lit(0.0))
    grown = F.coalesce(F.col("shares_change").cast("double") * price, F.lit(0.0))
    return F.when(F.col("position_status") == "NEW", F.col("market_value_usd").cast("double")).when(F.col("position_status") == "INCREASED", grown).otherwise(0.0)


def public_holdings(changes: DataFrame, as_of: date | datetime) -> DataFrame:
    return changes.filter(F.col("publication_time") <= F.lit(as_of)).withColumn("event_time", F.col("period_of_report"))


def institution_window(changes: DataFrame, as_of: date | datetime, window_days: int = 365, lookback_days: int = 0) -> DataFrame:
    """Per company: the window's dollars added and in new positions, distinct institutions that added and that reduced or
    left, and the history of dollars added. One pass: changes are summed for each institution first."""
    adding, reducing = F.col("position_status").isin(ACCUMULATING), F.col("position_status").isin(DISTRIBUTING)
    rows = window_and_history(public_holdings(changes, as_of).filter(adding | reducing), as_of, window_days, lookback_days)
    each = rows.groupBy("company_id", "k", "institution_id").agg(
        F.sum(F.when(adding, accumulated()).otherwise(0.0)).alias("total"), F.sum(F.when(F.col("position_status") == "NEW", accumulated()).otherwise(0.0)).alias("new"),
        F.max(adding).alias("adds"), F.max(reducing).alias("reduces"),
    )
    sums = each.groupBy("company_id", "k").agg(F.sum("total").alias("total"), F.sum("new").alias("new"), F.count_if("adds").alias("adding"), F.count_if("reduces").alias("reducing"))
    return sums.groupBy("company_id").agg(
        of_window("total").alias("window_total"), of_window("new").alias("new_total"), of_window("adding").alias("accumulating"), of_window("reducing").alias("distributing"),
        history_of("total", lookback_days // window_days).alias("history"),
    ).filter("accumulating IS NOT NULL")


def direction_counts(changes: DataFrame, as_of: date | datetime, window_days: int = 365) -> DataFrame:
    """Per company: distinct institutions that added, and that reduced or left, in the window."""
    return institution_window(changes, as_of, window_days).select("company_id", "accumulating", "distributing")


def institution_evidence(changes: DataFrame, as_of: date | datetime, window_days: int = 365) -> DataFrame:
    """The holdings that a score's dollars come from, a row each."""
    rows = in_window(public_holdings(changes, as_of), as_of - timedelta(window_days), as_of).filter(F.col("position_status").isin(ACCUMULATING))
    return rows.select("company_id", "event_time", "institution_id", "position_status", "shares", "shares_change", "market_value_usd", accumulated().alias("dollars"))


def institution_scores(changes: DataFrame, companies: DataFrame, as_of: date | datetime, *, window_days: int = 365, lookback_days: int = 1460, least: int = 3) -> DataFrame:
    """A row for each company that an institution added in the window; institution_evidence() has what it rests on."""
    return scored_institutions(institution_window(changes, as_of, window_days, lookback_days), companies, as_of, window_days, least)


def scored_institutions(window: DataFrame, companies: DataFrame, as_of: date | datetime, window_days: int = 365, least: int = 3) -> DataFrame:
    """institution_scores() of an institution_window() that the caller has."""
    start = as_of - timedelta(window_days)
    out = window.filter("accumulating > 0")
    out = out.withColumns(against_history("window_total", least)).withColumns(
        {
            "magnitude_vs_history": clamp(F.col("baseline_percentile") * 100),
            "breadth": F.least(F.lit(100.0), 30.0 * F.col("accumulating")),
            "consensus": F.col("accumulating") / (F.col("accumulating") + F.col("distributing")) * 100,
            "new_money_share": F.when(F.col("window_total") > 0, F.col("new_total") / F.col("window_total") * 100).otherwise(0.0),
        }
    )
    said = {
        "magnitude_vs_history": text(dollars(F.col("window_total")), " added; percentile ", F.coalesce(F.format_number(F.col("baseline_percentile") * 100, 0), F.lit("unknown")), " of own windows."),
        "breadth": text(F.col("accumulating").cast("string"), " institution(s) added."),
        "consensus": text(F.col("accumulating").cast("string"), " added, ", F.col("distributing").cast("string"), " reduced or left."),
        "new_money_share": text(F.format_number("new_money_share", 0), "% from new positions."),
    }
    enough = F.least(F.lit(1.0), F.col("baseline_n") / least) if least else F.lit(1.0)
    return companies.select(F.col("entity_id").alias("company_id"), F.col("canonical_name").alias("company_name")).join(
        out.withColumns(
            {
                "composite": composite(INSTITUTION_WEIGHTS),
                "confidence": 0.5 + 0.5 * enough,
                "components": components(INSTITUTION_WEIGHTS, said),
                "notes": notes((F.col("baseline_n") < least, F.lit("The history is too short for a comparison.")), (F.lit(True), F.lit("Increases are valued at the period's own price a share, not at cost."))),
                "explanation": F.array(*said.values()),
                "window_start": F.lit(start),
            }
        ),
        "company_id",
    )


# --- short interest ------------------------------------------------------------------------------------------------


def latest_cycles(snapshots: DataFrame, as_of: date | datetime, lookback_cycles: int = 12) -> DataFrame:
    """The newest lookback + 1 public cycles of each company, numbered from 1."""
    newest = W.partitionBy("company_id").orderBy(F.col("settlement_date").desc())
    return snapshots.filter(F.col("publication_time") <= F.lit(as_of)).withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= lookback_cycles + 1)


def short_interest_evidence(snapshots: DataFrame, as_of: date | datetime, lookback_cycles: int = 12) -> DataFrame:
    """The cycles that a score rests on, a row each, of companies whose newest one rose."""
    rows = latest_cycles(snapshots, as_of, lookback_cycles)
    rising = rows.filter("rn = 1 AND change_percent > 0").select("company_id")
    return rows.join(rising, "company_id", "left_semi").select("company_id", "rn", "settlement_date", "current_short_position", "change_percent", "days_to_cover")


def short_interest_scores(snapshots: DataFrame, companies: DataFrame, as_of: date | datetime, *, lookback_cycles: int = 12, least: int = 3) -> DataFrame:
    rows = latest_cycles(snapshots, as_of, lookback_cycles)
    first = F.col("rn") == 1
    past = F.col("rn") > 1
    rising = F.coalesce(F.col("change_percent") > 0, F.lit(False))
    out = rows.groupBy("company_id").agg(
        F.max(F.when(first, F.col("settlement_date"))).alias("settlement_date"),
        F.max(F.when(first, F.col("change_percent"))).alias("change_percent"),
        F.max(F.when(first, F.col("days_to_cover"))).alias("days_to_cover"),
        F.collect_list(F.when(past, F.col("change_percent"))).alias("history"),
        F.collect_list(F.when(past, F.col("days_to_cover"))).alias("cover_history"),
        (F.coalesce(F.min(F.when(past & ~rising, F.col("rn"))), F.max("rn") + 1) - 2).cast("bigint").alias("run"),
    )
    out = out.filter("change_percent > 0").withColumns(against_history("change_percent", least))
    cover = (F.size("cover_history") >= least) & F.col("days_to_cover").isNotNull()
    out = out.withColumns(
        {
            "magnitude_vs_history": clamp(F.col("baseline_percentile") * 100),
            "days_to_cover_vs_history": F.when(cover, clamp(percentile_of(F.col("cover_history"), F.col("days_to_cover")) * 100)),
            "persistence": F.least(F.lit(100.0), 34.0 * F.col("run")),
        }
    )
    said = {
        "magnitude_vs_history": text("+", F.format_number("change_percent", 2), "% in the newest cycle; percentile ", F.coalesce(F.format_number(F.col("baseline_percentile") * 100, 0), F.lit("unknown")), "."),
        "days_to_cover_vs_history": F.coalesce(text(F.format_number("days_to_cover", 2), " days to cover."), F.lit("Days to cover are unknown.")),
        "persistence": text(F.col("run").cast("string"), " cycle(s) before it rose as well."),
    }
    enough = F.least(F.lit(1.0), F.col("baseline_n") / least) if least else F.lit(1.0)
    return companies.select(F.col("entity_id").alias("company_id"), F.col("canonical_name").alias("company_name")).join(
        out.withColumns(
            {
                "composite": composite(SHORT_INTEREST_WEIGHTS),
                "confidence": 0.5 + 0.5 * enough,
                "components": components(SHORT_INTEREST_WEIGHTS, said),
                "notes": notes((F.col("baseline_n") < least, F.lit("The history is too short for a comparison.")), (F.lit(True), F.lit("Only rising short interest is scored."))),
                "explanation": F.array(*said.values()),
            }
        ),
        "company_id",
    )
