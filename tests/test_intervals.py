"""Identifiers by date: the join by blocks against all pairs, and what it costs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lanternlog.operators import resolve

ROWS, INTERVALS = "row long, ticker string, at date", "ticker string, company_id long, valid_from date, valid_to date"


def matched(spark, rows, intervals):
    out = resolve.valid_on(spark.createDataFrame(rows, ROWS), spark.createDataFrame(intervals, INTERVALS), "at")
    return sorted((r.row, r.company_id) for r in out.collect())


def test_blocks_make_up_the_interval_once(spark):
    rng, cases = random.Random(1), [(0, 0), (7, 8), (0, 63), (1, 64), (5, 4), (0, 3652058)]
    cases += [(a := rng.randint(0, 5000), a + rng.choice([0, 1, 9, 70, 3000])) for _ in range(200)]
    df = spark.createDataFrame(cases, "low long, high long").withColumn("blocks", resolve.covering_blocks(F.col("low"), F.col("high")))
    for r in df.collect():
        parts = sorted((b.block * 8**b.level, (b.block + 1) * 8**b.level) for b in r.blocks)
        assert len(parts) <= 14 * resolve.LEVELS
        ends = [r.low, *(end for _, end in parts)]
        assert [start for start, _ in parts] == ends[:-1] and (ends[-1] == r.high + 1 or r.high < r.low)


def test_join_equals_all_pairs_with_open_ends_nulls_and_ties(spark):
    rng, day = random.Random(2), (lambda n: date(1999, 1, 1) + timedelta(n))
    rows = [(k, rng.choice(["A", "B", None]), None if k % 40 == 0 else day(rng.randint(0, 900))) for k in range(300)]
    rows += [(900, "A", date(1, 1, 1)), (901, "A", date(9999, 12, 31))]
    intervals = [(rng.choice(["A", "B", "C"]), k, rng.choice([None, day(a := rng.randint(0, 900))]), rng.choice([None, day(a + rng.randint(-5, 200))])) for k in range(60)]
    intervals += [intervals[0], (None, 99, None, None)]
    want = sorted((r, c) for r, t, at in rows for u, c, lo, hi in intervals if t and at and t == u and (lo or date.min) <= at <= (hi or date.max))
    assert matched(spark, rows, intervals) == want and want


def test_a_ticker_of_many_intervals_costs_its_matches(spark):
    n = 20_000
    at = F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int"))
    intervals = spark.range(n).select(F.lit("T").alias("ticker"), F.col("id").alias("company_id"), at.alias("valid_from"), at.alias("valid_to"))
    rows = spark.range(n).select(F.col("id").alias("row"), F.lit("T").alias("ticker"), at.alias("at"))
    out = resolve.valid_on(rows, intervals, "at")  # 400 million pairs by ticker alone
    assert out.filter("row = company_id").count() == out.count() == n


def test_empty_tables(spark):
    assert matched(spark, [], [("A", 1, None, None)]) == [] == matched(spark, [(1, "A", date(2000, 1, 1))], [])
