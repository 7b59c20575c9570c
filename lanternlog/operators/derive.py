"""Facts derived from facts: portfolio changes, fund flows, canonical fundamentals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ["revenue", "net_income", "eps_diluted", "gross_profit", "operating_income"]


def quarter_holdings(raw: DataFrame) -> DataFrame:
    """Shares and value summed for each institution, period and company."""
    return raw.groupBy("institution_id", "period_of_report", "company_id").agg(
        F.sum("shares").cast("decimal(28,4)").alias("shares"), F.sum("market_value_usd").cast("decimal(28,2)").alias("market_value_usd")
    )


def periods(holdings: DataFrame) -> DataFrame:
    """Each institution's reporting periods, and the one before and after each."""
    own = W.partitionBy("institution_id").orderBy("period_of_report")
    distinct = holdings.select("institution_id", "period_of_report").distinct()
    return distinct.withColumns({"prior_period": F.lag("period_of_report").over(own), "next_period": F.lead("period_of_report").over(own)})


def prior_portfolio(holdings: DataFrame) -> DataFrame:
    """Every period's portfolio as of the period before it."""
    at = periods(holdings).filter("prior_period IS NOT NULL").select("institution_id", "period_of_report", "prior_period")
    before = holdings.withColumnRenamed("period_of_report", "prior_period")
    return at.join(before, ["institution_id", "prior_period"]).select("institution_id", "period_of_report", "company_id", F.col("shares").alias("prior_shares"))


def status_of(prior: Column, change: Column) -> Column:
    """The status of a position that is held, by the shares before and the change."""
    return F.when(prior.isNull(), "NEW").when(change > 0, "INCREASED").when(change < 0, "DECREASED").otherwise("UNCHANGED")


def position_changes(holdings: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Holdings with status and change against the period before, and a row for each position that was given up.

    A holding is compared with the company's holding before it where that is of the institution's period before: by lag
    and lead over (institution, company), so the holdings are read once, and joined only with the institutions' periods.
    What is only before is EXITED, as of the period after it; what is only now is NEW. With ``since`` and ``until`` only
    the changes of periods between (both included) are made, from the holdings of these and of the period before each.
    """
    if until is not None:
        holdings = holdings.filter(F.col("period_of_report") <= F.lit(until))
    own = W.partitionBy("institution_id", "company_id").orderBy("period_of_report")
    at = holdings.select("institution_id", "period_of_report", "company_id", "shares", "market_value_usd").join(periods(holdings), ["institution_id", "period_of_report"])
    if since is not None:
        at = at.filter((F.col("period_of_report") >= F.lit(since)) | (F.col("next_period") >= F.lit(since)))
    at = at.withColumns({"last_period": F.lag("period_of_report").over(own), "last_shares": F.lag("shares").over(own), "lead_period": F.lead("period_of_report").over(own)})
    prior = F.when(F.col("last_period") == F.col("prior_period"), F.col("last_shares"))
    change = F.col("shares") - prior
    status = status_of(prior, change)
    shares, value = (lambda x: x.cast("decimal(28,4)")), (lambda x: x.cast("decimal(28,2)"))
    now = F.struct(F.col("period_of_report").alias("period"), shares(F.col("shares")).alias("shares"), value(F.col("market_value_usd")).alias("value"), shares(change).alias("change"), status.alias("status"))
    gone = F.col("next_period").isNotNull() & ~F.col("lead_period").eqNullSafe(F.col("next_period"))
    zero = F.lit(0)
    left = F.struct(F.col("next_period").alias("period"), shares(zero).alias("shares"), value(zero).alias("value"), shares(-F.col("shares")).alias("change"), F.lit("EXITED").alias("status"))
    rows = at.select("institution_id", "company_id", F.explode(F.array_compact(F.array(now, F.when(gone, left)))).alias("r"))
    if since is not None:
        rows = rows.filter(F.col("r.period") >= F.lit(since))
    return rows.select(
        "institution_id", F.col("r.period").alias("period_of_report"), "company_id", "r.shares", F.col("r.value").alias("market_value_usd"), F.col("r.change").alias("shares_change"),
        F.col("r.status").alias("position_status"), F.date_add("r.period", 45).alias("publication_time"),
    )


def fund_changes(snapshots: DataFrame) -> DataFrame:
    """Net assets and their change against the period before; null for a fund's first."""
    own = W.partitionBy("fund_id").orderBy("period_end")
    return snapshots.withColumn("net_change", F.col("net_assets_usd") - F.lag("net_assets_usd").over(own))


def short_interest_changes(snapshots: DataFrame) -> DataFrame:
    """change_percent against the cycle before, and days to cover."""
    own = W.partitionBy("company_id").orderBy("settlement_date")
    position = F.col("current_short_position").cast("double")
    before = F.lag("current_short_position").over(own).cast("double")
    return snapshots.withColumns(
        {
            "change_percent": F.round((position - before) / F.nullif(before, F.lit(0.0)) * 100, 2),
            "days_to_cover": position / F.nullif(F.col("average_daily_volume"), F.lit(0.0)),
            "publication_time": F.col("settlement_date"),
        }
    )


def period_type(start: Column, end: Column) -> Column:
    """QUARTER or FISCAL_YEAR by length in days; null for stubs and year-to-date spans."""
    days = F.datediff(end, start)
    return F.when(days.between(80, 100), "QUARTER").when(days.between(330, 380), "FISCAL_YEAR")


def earliest_filed(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The fact filed first of each key, the smallest accession of ties."""
    first = F.struct("filed", "accession", "value")
    return facts.groupBy(*keys).agg(F.min(first).alias("f")).select(*keys, F.col("f.value").alias("value"), F.col("f.filed").alias("filed"), F.col("f.accession").alias("accession"))


def agreed_first(facts: DataFrame) -> DataFrame:
    """The fact filed first of each metric's period, of quarters and years; with more than one distinct value there is none.

    One aggregation: the least and the greatest value tell whether all agree, so facts are read, and parsed, once.
    """
    typed = facts.withColumn("period_type", period_type(F.col("period_start"), F.col("period_end"))).filter("period_type IS NOT NULL AND company_id IS NOT NULL AND metric IS NOT NULL")
    keys = ["company_id", "metric", "period_start", "period_end", "period_type"]
    found = typed.groupBy(*keys).agg(F.min(F.struct("filed", "accession", "value")).alias("f"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.filter("low = high").select(*keys, F.col("f.value").alias("value"), F.col("f.filed").alias("filed"), F.col("f.accession").alias("accession"))


def fundamentals(facts: DataFrame) -> DataFrame:
    """One row a company and period with a column for each metric, its first filing, and margins."""
    first = agreed_first(facts)
    at = first.groupBy("company_id", "period_start", "period_end", "period_type").agg(
        *(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS), F.min("filed").alias("publication_time")
    )
    return at.withColumns({"gross_margin": margin("gross_profit", "revenue"), "operating_margin": margin("operating_income", "revenue")})


def margin(part: str, whole: str) -> Column:
    """part over whole in percent, as decimal(7,4); null where whole is null or 0 or the ratio does not fit."""
    ratio = F.col(part).cast("double") / F.nullif(F.col(whole).cast("double"), F.lit(0.0)) * 100
    return ratio.try_cast("decimal(7,4)")
