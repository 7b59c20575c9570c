"""Forward returns after signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rising_signals(snapshots: DataFrame, as_of) -> DataFrame:
    """Every public cycle with a rise, by settlement date. as_of gates the signals, not the prices."""
    return snapshots.filter((F.col("publication_time") <= F.lit(as_of)) & (F.col("change_percent") > 0)).select("company_id", F.col("settlement_date").alias("signal_date"))


def forward_returns(signals: DataFrame, bars: DataFrame, holding_bars: int, days_a_range: int = 128) -> DataFrame:
    """Return from the first bar on or after the signal to the bar holding_bars later, in percent, with an outcome.

    A company's dates are cut into ranges, so that no company, however many bars and signals it has, is one task's work:
    a range finds the next bar of its signals in itself, and what it lacks is the first bar of the next range that has
    one. Bars are numbered by the range's own order and the bars of the ranges before it; the bar to leave at is the one
    whose number is holding_bars higher, by an equality join. So no signal is compared with all bars.
    """
    in_range = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days_a_range).cast("int").alias("range")
    priced = bars.select("company_id", in_range("trade_date"), "trade_date", F.col("close").cast("double").alias("close"))
    own = W.partitionBy("company_id", "range").orderBy("trade_date")
    bar = F.struct("trade_date", "close", "place")
    placed = priced.withColumn("place", F.row_number().over(own))
    # a row for each range, so these windows are small: bars before it, and the first bar of the next range
    held = priced.groupBy("company_id", "range").agg(F.count("*").alias("n"), F.min(F.struct("trade_date", "close")).alias("first"))
    ordered = W.partitionBy("company_id").orderBy("range")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = held.select("company_id", "range", before.alias("before"))
    numbered = placed.join(ranges, ["company_id", "range"]).withColumn("place", F.col("place") + F.col("before")).drop("before")
    some = signals.select("company_id", in_range("signal_date"), F.col("signal_date").alias("at"))
    rows = numbered.select("company_id", "range", F.col("trade_date").alias("at"), F.lit(1).alias("is_bar"), bar.alias("bar")).unionByName(some.withColumn("is_bar", F.lit(0)), allowMissingColumns=True)
    # from the last date to the first, so that the next bar is the last one seen and a frame grows by a row at a time
    seen = W.partitionBy("company_id", "range").orderBy(F.col("at").desc(), F.col("is_bar").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("own", F.last("bar", ignorenulls=True).over(seen)).filter("is_bar = 0").select("company_id", "range", F.col("at").alias("signal_date"), "own")
    # the first bar of the next range that has one, for ranges with signals only too
    asked = some.select("company_id", "range").distinct().join(held, ["company_id", "range"], "full")
    total = F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    following = F.first("first", ignorenulls=True).over(ordered.rowsBetween(1, W.unboundedFollowing))
    nexts = asked.select("company_id", "range", F.struct(following["trade_date"].alias("trade_date"), following["close"].alias("close"), (total + 1).alias("place")).alias("next"), following.isNotNull().alias("has_next"))
    entered = found.join(nexts, ["company_id", "range"]).withColumn("entry", F.coalesce("own", F.when(F.col("has_next"), F.col("next"))))
    leaving = numbered.select("company_id", (F.col("place") - holding_bars).alias("entry_place"), F.col("trade_date").alias("exit_date"), F.col("close").alias("exit_close"))
    matched = entered.select("company_id", "signal_date", "entry", F.col("entry.place").alias("entry_place")).join(leaving, ["company_id", "entry_place"], "left")
    return matched.select(
        "company_id",
        "signal_date",
        F.col("entry.trade_date").alias("entry_date"),
        "exit_date",
        ((F.col("exit_close") - F.col("entry.close")) / F.nullif(F.col("entry.close"), F.lit(0.0)) * 100).alias("return_percent"),
        F.when(F.col("entry").isNull(), "no_entry").when(F.col("exit_date").isNull(), "too_few_bars").otherwise("ok").alias("outcome"),
    )


def summary(returns: DataFrame) -> DataFrame:
    x = F.col("return_percent")
    return returns.agg(
        F.count("*").alias("signals"), F.count(x).alias("computable"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative")
    )
