"""What keeps a task's work and memory from growing with the tables: shared steps of the larger queries."""

import glob
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from lanternlog.operators import graph, resolve
from lanternlog.plans import core, streams, views
from lanternlog.sources import filings, landing
from lanternlog.streaming import ingest, portfolio

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_joined_to_seats_and_not_to_pairs(spark):
    roles = spark.createDataFrame([(1, c, date(2026, 1, 1), "T") for c in (1, 2, 3)], "person_id long, company_id long, start_date date, title string")
    names = spark.createDataFrame([(1, "One", "company"), (1, "Ann", "person")], "entity_id long, name string, kind string")
    out = graph.interlocks(roles, names=names)
    last = next(line for line in plan(out).splitlines() if "Join" in line)
    assert "lo#" in last and "hi#" in last
    assert sorted((r.company_a, r.company_b, r.person_name, r.company_a_name) for r in out.collect()) == [(1, 2, "Ann", "One"), (1, 3, "Ann", "One"), (2, 3, "Ann", "UNKNOWN")]


SEAT = "person_id long, company_id long, start_date date, title string"


def test_pairs_come_in_order_and_without_an_unknown_company(spark):
    roles = spark.createDataFrame([(1, c, date(2026, 1, 1), "T") for c in (*range(40), None)], SEAT)
    rows = graph.interlocks(roles, most_seats=10).collect()
    assert {(r.company_a, r.company_b) for r in rows} == {tuple(sorted((a, b), key=str)) for a in range(40) for b in range(a)} and len(rows) == 780
    runs = [1 + sum(one[side] != after[side] for one, after in zip(rows, rows[1:])) for side in ("company_a", "company_b")]
    assert min(runs) <= 40 * 4  # a seat's pairs with a block follow each other, which is what makes a file of them small


def test_a_company_of_two_names_is_no_pair_with_itself(spark):
    roles = spark.createDataFrame([(1, c, date(2026, 1, 1), "T") for c in (1, 2, 3)], SEAT)
    names = spark.createDataFrame([(2, "Two", "company"), (2, "Deux", "company")], "entity_id long, name string, kind string")
    for most_seats in (1, 500):
        out = graph.interlocks(roles, names=names, most_seats=most_seats)
        assert sorted((r.company_a, r.company_b) for r in out.collect()) == [(1, 2), (1, 2), (1, 3), (2, 3), (2, 3)]


def test_seats_are_made_once_and_pairs_are_dealt_by_their_number(spark, monkeypatch):
    out = core.QUERIES["g01_interlocks"](spark, SF)
    assert not any("lineitem" in f for f in out.inputFiles())
    pairs = out.count()
    few = max(1, pairs // 16)
    monkeypatch.setattr(core, "PAIRS_A_TASK", few)
    assert core.QUERIES["g01_interlocks"](spark, SF).rdd.getNumPartitions() == -(-pairs // few) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_lines_of_other_parts_are_three_columns(spark, tmp_path):
    lines = [(1, 1, 40), (1, 1, 39), (1, 2, 80), (1, 2, 79), (1, 2, 81), (1, 3, 40), (1, 3, 40), (1, None, 80), (1, None, 40), (2, None, 40), (2, None, 39), (2, 4, None), (2, 5, 120), (3, 1, 40), (None, 1, 40), (4, 1, 39), (4, 1, 40)]
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(k, n, p, i % 4, 1.0 * i, 1.0, 0.0, 0.06, "A", "F", None) for i, (k, n, p) in enumerate(lines)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(k, 10 * k + i, date(1996, k, 1)) for k in (1, 2, 4) for i in range(1 + k // 4)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, 2.0) for p in (39, 40, 40, 80, 81, None)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    whole = views.view(spark, str(tmp_path), "tb_roles")
    seats = core.seats(spark, str(tmp_path))
    got = sorted(map(str, seats.select(whole.columns).collect()))
    assert got == sorted(map(str, whole.collect())) and len(got) > 2
    scans = [line for line in seats._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "l_partkey#" in line]
    assert len(scans) >= 2 and all("% 40) = 0" in x for x in scans if "l_quantity#" in x)


def test_changes_of_one_part_are_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a hundred rows would be one task again
    kept = portfolio.Portfolios(spark, f"file://{tmp_path}/p", parts=1, spread=8)
    rows = [(1, date(2026, 3, 31), "a", date(2026, 5, 1), c, Decimal(1), Decimal(1)) for c in range(100)]
    try:
        assert kept.add(spark.createDataFrame(rows, portfolio.HOLDING), 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert 1 < len(glob.glob(f"{tmp_path}/p/changes/batch=0/part=0/*.parquet")) <= 8
    assert len(glob.glob(f"{tmp_path}/p/holdings/batch=0/part=0/*/*.parquet")) == 1 and kept.read().count() == 100


def test_a_part_of_a_batch_is_few_files(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1)], "k long, v long"))
    rows.repartition(8).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = ingest.landing(spark, f"{tmp_path}/in", rows.schema, files_per_batch=4)
        ingest.appended_once(stream, f"{tmp_path}/out", f"{tmp_path}/state", ["k"], [F.col("v")], F.floor(F.col("k") / 1000), spread=1).awaitTermination()
    got = ingest.read_target(spark, f"{tmp_path}/out", rows.schema)
    assert got.filter("k IS NOT NULL").count() == got.select("k").dropna().distinct().count() == 2000 and got.filter("k IS NULL").count() == 1
    for part in glob.glob(f"{tmp_path}/out/batch=[0-9]*/part=*"):
        assert len(glob.glob(f"{part}/*.parquet")) == 1


FORM4 = (
    "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>1</rptOwnerCik></reportingOwnerId></reportingOwner><reportingOwner><reportingOwnerId><rptOwnerCik>2</rptOwnerCik></reportingOwnerId></reportingOwner>"
    "<nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"
)
TRADE = "<nonDerivativeTransaction><transactionDate><value>{}</value></transactionDate><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction>"


def test_rows_of_a_filing_are_numbered_within_it(spark):
    body = FORM4.format(TRADE.format("2026-01-01") + TRADE.format("none") + TRADE.format("2026-01-02"))
    out = filings.form4_transactions(spark.createDataFrame([("a", body), ("a", body), ("b", FORM4.format(""))], "document string, payload string"))
    got = sorted((r.document, int(r.owner_cik), r.transaction_index, r.event_time.day) for r in out.collect())
    assert got == sorted(2 * [("a", 1, 0, 1), ("a", 1, 1, 2), ("a", 2, 2, 1), ("a", 2, 3, 2)])
    text = plan(out)
    assert text.count("from_xml") == 1 and "Window" not in text


def test_a_quarantine_alone_parses_once(spark):
    source = landing.Source("tone", "json", filings.TONE, lambda p: filings.tone_bins(p).withColumnRenamed("company_id", "document"), ["document", "bin"])
    docs = spark.createDataFrame([("1", '{"tonechart":[]}'), ("2", "{"), ("3", " ")], "document string, payload string")
    took = landing.intake(docs.repartition(2), source, spark.createDataFrame([], "document string, bin int"), lambda parsed: parsed)
    assert sorted((r.document, r.reason) for r in took.quarantine.collect()) == [("2", "broken json"), ("3", "no payload")]
    assert plan(took.quarantine).count("from_json") == 1


def test_shuffles_start_wider_for_longer_tables(spark, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(views, "ROWS_A_TASK", 100)
    rows = views.base(spark, SF, "lineitem").count()
    views.view(spark, SF, "tb_form4_raw")
    assert int(spark.conf.get(key)) == -(-rows // 100) > 8
    monkeypatch.setattr(views, "ROWS_A_TASK", 1_000_000)
    views.view(spark, SF, "tb_form4_raw")
    assert int(spark.conf.get(key)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_landed_files_follow_the_table(spark, monkeypatch):
    rows = views.base(spark, SF, "lineitem").count()
    assert streams.landing_files(spark, SF) == 6
    monkeypatch.setattr(streams, "ROWS_A_FILE", 100)
    assert streams.landing_files(spark, SF) == -(-rows // 100)


def test_only_distinct_dates_are_cut_into_blocks(spark):
    rows = spark.range(1000).select("id", F.lit("T").alias("ticker"), F.lit("2026-01-01").cast("date").alias("at"))
    intervals = spark.createDataFrame([("T", 7, None, None)], "ticker string, company_id long, valid_from date, valid_to date")
    out = resolve.valid_on(rows, intervals, "at")
    assert "Aggregate" in plan(out) and out.filter("company_id = 7").count() == out.count() == 1000
