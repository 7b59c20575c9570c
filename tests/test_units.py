"""Operators whose inputs are small literals: feeds, dates, rules, payloads, streams."""

import json
import math
import random
from collections import Counter
from datetime import date, datetime, timedelta

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternlog.functions.normalise import to_thousandths
from lanternlog.operators import alerts, asof, backtest, eventlog, graph
from lanternlog.plans.core import RULES, thousandths_sql
from lanternlog.sources import filings, landing
from lanternlog.streaming import ingest

DAY = date(2026, 3, 10)


def test_sources_are_unique_by_name(spark):
    rows = eventlog.sources(spark)
    assert rows.count() == rows.select("name").distinct().count() == 6
    assert {r.name: r.tier for r in rows.collect()}["GDELT Project"] == "C_PUBLICATION"


def test_candidate_settlement_dates(spark):
    days = [r[0] for r in filings.candidate_settlement_dates(spark, DAY).collect()]
    assert days == sorted(days, reverse=True) and max(days) <= DAY
    assert date(2026, 2, 28) in days and date(2026, 2, 24) in days and date(2026, 1, 12) in days and date(2026, 1, 18) not in days
    assert min(days) == date(2025, 12, 12)


def test_acceptance_time_is_new_york(spark):
    df = spark.createDataFrame([("<ACCEPTANCE-DATETIME>20260701120000\n",), ("<ACCEPTANCE-DATETIME>20260101120000",), ("none",)], "t string")
    got = [r[0] for r in df.select(filings.acceptance_time("t").cast("string")).collect()]
    assert got == ["2026-07-01 16:00:00", "2026-01-01 17:00:00", None]


FEED = "<feed><entry><id>accession-number=1-2-{}</id><link href='/data/77/x'/><category term='4'/><updated>2026-01-01T00:00:00Z</updated></entry></feed>"


def test_broken_payloads_give_no_row_and_are_quarantined(spark):
    schema = "entry array<struct<id:string,link:struct<_href:string>,category:struct<_term:string>,updated:string>>"
    feed = landing.Source("feed", "xml", schema, lambda p: filings.feed_entries(p).withColumnRenamed("accession", "document"), ["document"])
    payloads = [("good", FEED.format(3)), ("other", FEED.format(4)), ("bad", "<feed><entry>"), ("cut", FEED.format(5)[:-3]), ("text", "nonsense"), ("none", None), ("blank", " \n"), ("empty", "<feed></feed>")]
    docs = spark.createDataFrame(payloads, "document string, payload string")
    known = spark.createDataFrame([("1-2-4",)], "document string")
    took = landing.intake(docs, feed, known, lambda df: df.cache())
    assert [(r.document, r.cik) for r in took.accepted.collect()] == [("1-2-3", "0000000077")]
    assert {(r.document, r.reason, r.payload) for r in took.quarantine.collect()} == {(n, "no payload" if n in ("none", "blank") else "broken xml", dict(payloads)[n]) for n in ("bad", "cut", "text", "none", "blank")}
    assert took.summary.first().asDict() == {"source": "feed", "seen": 8, "error": 5, "empty": 1, "created": 1, "duplicate": 1}


def test_broken_json_is_quarantined_whole(spark):
    docs = spark.createDataFrame([("a", '{"tonechart":[{"bin":1,"count":2}]}'), ("b", '{"tonechart":[{"bin":1,"count":2}'), ("c", '{"tonechart":[{"bin":"x","count":2},{"bin":2,"count":2}]}'), ("d", '{"tonechart":[]}')], "document string, payload string")
    source = landing.Source("tone", "json", filings.TONE, lambda p: filings.tone_bins(p).withColumnRenamed("company_id", "document"), ["document", "bin"])
    took = landing.intake(docs, source, spark.createDataFrame([], "document string, bin int"), lambda df: df.cache())
    assert {r.document for r in took.quarantine.collect()} == {"b", "c"} and took.accepted.count() == 1
    assert tuple(took.summary.first()) == ("tone", 4, 2, 1, 1, 0)


def test_both_sinks_of_a_batch_are_replaced_when_it_is_run_again(spark, tmp_path):
    docs = spark.createDataFrame([("a", '{"tonechart":[{"bin":1,"count":2}]}'), ("b", "{")], "document string, payload string")
    source = landing.Source("tone", "json", filings.TONE, lambda p: filings.tone_bins(p).withColumnRenamed("company_id", "document"), ["document", "bin"])
    for _ in range(2):
        landing.intake(docs, source, spark.createDataFrame([], "document string, bin int"), lambda df: df.cache()).write(str(tmp_path), 7)
    assert spark.read.parquet(f"{tmp_path}/accepted").count() == spark.read.parquet(f"{tmp_path}/quarantine").count() == 1


def test_an_index_file_is_told_by_its_first_line(spark, tmp_path):
    files = {
        "vix_history.csv": "\n\n date,open,HIGH,low,close \r\n1/2/2024,1,2,0.5, 1.25\r\n01/03/2024,1,2\n\n", "late_history.csv": "note\nDATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,1,2,1,1\n", "other_history.csv": "DATE,VALUE\n01/02/2024,1\n",
        "bad_history.csv": "DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,1,2,1,1\n13/45/2024,1,2,1,1\n", "number_history.csv": "DATE,OPEN,HIGH,LOW,CLOSE\n01/02/2024,1,x,1,1\n01/03/2024,1,,1,1\n", "empty_history.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    lines = landing.landed_records(spark, str(tmp_path))
    assert [(r.index_code, r.trade_date, float(r.close)) for r in filings.index_levels(lines).collect()] == [("VIX", date(2024, 1, 2), 1.25)]
    assert {(r.document.split("/")[-1], r.payload) for r in filings.index_rejects(lines).collect()} == {("bad_history.csv", "13/45/2024,1,2,1,1"), ("number_history.csv", "01/02/2024,1,x,1,1")}


def test_records_are_numbered_in_their_files_however_they_are_read(spark, tmp_path):
    rows = {f"f{k}": [f"{k}:{i}" for i in range(n)] for k, n in enumerate((1, 3000, 700))}
    for name, lines in rows.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
        read = landing.landed_records(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 10
        got = {(r.document.split("/")[-1], r.record_no): r.payload for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {(name, i): x for name, lines in rows.items() for i, x in enumerate(lines)}
    whole = {r.document.split("/")[-1]: (r.size, r.payload) for r in landing.landed_files(spark, str(tmp_path)).collect()}
    assert (whole["f0"][0], whole["f0"][1].strip()) == (4, "0:0") and len(whole) == 3


def test_submissions_are_split_into_their_documents(spark):
    text = "<SEC-HEADER>\n<ACCEPTANCE-DATETIME>20260101120000\n</SEC-HEADER>\n<DOCUMENT>\n<TYPE>13F-HR\n<TEXT>\n<XML>\n<a>1</a>\n</XML>\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>INFORMATION TABLE\r\n<TEXT>plain</TEXT></DOCUMENT>\n"
    df = landing.submission_documents(spark.createDataFrame([(text,), ("no documents",), (None,)], "payload string"))
    rows = df.select("documents", filings.acceptance_time("header").cast("string").alias("at"), landing.document_of("13F-HR").alias("cover"), landing.document_of("13F-HR/A").alias("none")).collect()
    assert [tuple(x) for x in rows[0].documents] == [("13F-HR", "<a>1</a>"), ("INFORMATION TABLE", "plain")]
    assert (rows[0].at, rows[0].cover, rows[0].none) == ("2026-01-01 17:00:00", "<a>1</a>", None) and rows[1].documents == [] and rows[2].documents is None


def test_rules_keep_their_newest_version(spark):
    got = {r.name: r for r in alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE)).collect()}
    assert got["insider strong"].min_score == 60.0 and got["insider strong"].is_active
    assert not got["broken"].is_valid and got["labels"].is_valid
    errors = alerts.rule_errors(alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE))).collect()
    assert [e.name for e in errors] == ["broken"]


def test_rules_are_shown_without_their_address(spark):
    rows = alerts.shown(alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE)))
    assert "webhook_url" not in rows.columns
    assert {r.name for r in rows.filter("has_webhook").collect()} == {"insider strong", "labels"}


def test_null_score_never_fires(spark):
    rules = alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE))
    scores = spark.createDataFrame([("insider", 1, None), ("insider", 2, 60.0), ("insider", 3, 59.9)], "family string, company_id long, composite double")
    assert [r.company_id for r in alerts.threshold_hits(rules, scores).collect()] == [2]


def test_same_day_is_one_alert_and_a_later_day_another(spark):
    hits = spark.createDataFrame([("r", 1, 70.0, "s")], "name string, company_id long, composite double, summary string")
    none = spark.createDataFrame([], "name string, company_id long, alert_date date")
    first = alerts.new_alerts(hits, none, DAY)
    assert first.count() == 1
    assert alerts.new_alerts(hits, first, DAY).count() == 0
    assert alerts.new_alerts(hits, first, date(2026, 3, 11)).count() == 1


def test_payloads_keep_nulls_and_differ_by_format(spark):
    rules = alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE))
    rows = spark.createDataFrame([("insider strong", 1, DAY, None, "said", ["e1"]), ("labels", 2, DAY, None, "label", None)], "name string, company_id long, alert_date date, composite double, summary string, evidence_ids array<string>")
    got = {r.name: json.loads(r.payload) for r in alerts.payloads(rows, rules).collect()}
    assert len(got["insider strong"]) == 9 and got["insider strong"]["composite_score"] is None and got["insider strong"]["source_event_ids"] == ["e1"]
    assert list(got["labels"]) == ["text"] and "`2` on 2026-03-10" in got["labels"]["text"]


def test_listing_mode_is_checked(spark):
    with pytest.raises(ValueError, match="mode"):
        asof.list_events(spark.range(1), DAY, "other")


ROLE = "person_id long, company_id long, start_date date, title string"


def test_three_companies_are_three_pairs(spark):
    roles = spark.createDataFrame([(1, c, date(2026, 1, c), f"T{c}") for c in (1, 2, 3)] + [(2, 1, None, None), (2, 2, date(2026, 1, 1), "")], ROLE)
    assert graph.interlocks(roles).count() == 4
    assert graph.interlocks(roles, as_of=date(2026, 1, 2)).count() == 1


def test_interlocks_are_ordered_as_text_and_named(spark):
    roles = spark.createDataFrame([(1, 9, date(2026, 1, 1), "Chair"), (1, 10, date(2026, 1, 2), None)], ROLE)
    names = spark.createDataFrame([(9, "Nine", "company"), (1, "One", "person"), (10, "not a company", "person")], "entity_id long, name string, kind string")
    (r,) = graph.interlocks(roles, names=names).collect()
    assert (r.company_a, r.company_b, r.title_a, r.title_b, r.start_a) == (10, 9, None, "Chair", date(2026, 1, 2))
    assert (r.person_name, r.company_a_name, r.company_b_name) == ("One", "UNKNOWN", "Nine")


def test_a_person_of_many_seats_is_many_tasks(spark):
    rows = [(1, c, date(2026, 1, 1), "T") for c in range(120)] + [(p, c, date(2026, 1, 1), "T") for p in range(2, 40) for c in (p, p + 1)]
    roles = spark.createDataFrame(rows, ROLE)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        out = graph.interlocks(roles, most_seats=20).withColumn("task", F.spark_partition_id())
        got = out.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    pairs = Counter((r.person_id, *sorted((r.company_a, r.company_b))) for r in got)
    assert pairs == Counter([(1, a, b) for a in range(120) for b in range(a + 1, 120)] + [(p, p, p + 1) for p in range(2, 40)])
    tasks = Counter(r.task for r in got if r.person_id == 1)
    assert len(tasks) > 8 and max(tasks.values()) < len(got) / 3


def plain_returns(signals, bars, n):
    out = []
    for c, at in signals:
        own = sorted((t, close) for k, t, close in bars if k == c)
        later = [i for i, (t, _) in enumerate(own) if t >= at]
        entry = own[later[0]] if later else None
        leave = own[later[0] + n] if later and later[0] + n < len(own) else None
        value = None if leave is None or not entry[1] else (leave[1] - entry[1]) / entry[1] * 100
        out.append((c, at, entry and entry[0], leave and leave[0], value, "no_entry" if entry is None else "too_few_bars" if leave is None else "ok"))
    return Counter(out)


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_forward_returns_by_ranges_equal_a_plain_search(spark, days):
    rng = random.Random(31)
    start = date(2026, 1, 1)
    bars = [(c, start + timedelta(t), float(rng.randint(0, 50))) for c in (1, 2, 3) for t in sorted(rng.sample(range(120), 40)) if not 50 < t < 80]
    signals = [(rng.randint(1, 4), start + timedelta(rng.randint(-5, 130))) for _ in range(120)]
    got = backtest.forward_returns(spark.createDataFrame(signals, "company_id long, signal_date date"), spark.createDataFrame(bars, "company_id long, trade_date date, close double"), 5, days)
    assert Counter(map(tuple, got.collect())) == plain_returns(signals, bars, 5)


def test_a_company_with_half_of_all_bars_is_many_tasks(spark):
    start = date(2000, 1, 1)
    bars = spark.createDataFrame([(1, start + timedelta(t), 1.0 + t) for t in range(4000)] + [(c, start + timedelta(t), 1.0) for c in range(2, 42) for t in range(100)], "company_id long, trade_date date, close double")
    signals = spark.createDataFrame([(1, start + timedelta(t)) for t in range(4000)], "company_id long, signal_date date")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(kept, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        out = backtest.forward_returns(signals, bars, 20).withColumn("task", F.spark_partition_id()).groupBy("task", "outcome").count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in out if r.outcome == "ok") == 3980 and sum(r["count"] for r in out) == 4000
    assert max(r["count"] for r in out) < 700


def test_a_cover_without_names_and_numbers_with_separators(spark):
    row = lambda cusip, n, v: f"<infoTable><cusip>{cusip}</cusip><value>{v}</value><shrsOrPrnAmt><sshPrnamt>{n}</sshPrnamt></shrsOrPrnAmt></infoTable>"
    cover = "<edgarSubmission><headerData><filerInfo><periodOfReport>03-31-2026</periodOfReport></filerInfo></headerData></edgarSubmission>"
    table = f"<informationTable>{row('A', 10, 100)}{row('A', 5, 50)}{row('B', '1,000', 9)}</informationTable>"
    df = spark.createDataFrame([("d", cover, table, "77")], "document string, cover string, payload string, path_cik string")
    assert [(r.filer_cik, r.filer_name, r.issuer_name, r.cusip, int(r.shares), int(r.market_value_usd)) for r in filings.holdings_13f(df).collect()] == [("0000000077", "UNKNOWN", "UNKNOWN", "A", 15, 150)]


def test_mean_tone_is_rounded_half_even(spark):
    bins = spark.createDataFrame([(1, 1, 1), (1, 0, 15), (2, 3, 1), (2, 0, 15), (3, 5, 0), (4, -651, 1), (4, 0, 79), (5, 1, 1), (5, 0, 79)], "company_id long, bin int, n long")
    assert {r.company_id: r.mean_tone for r in filings.tone(bins).collect()} == {1: 0.062, 2: 0.188, 4: round(-651 / 80, 3), 5: round(1 / 80, 3)}


def test_rounding_is_by_the_binary_value(spark):
    """Quotients, halves of thousandths and their neighbours, in columns and in the SQL, against Python."""
    rng = random.Random(22)
    numbers = [rng.randint(-5000, 5000) / rng.randint(1, 400) for _ in range(10_000)] + [k / 16 for k in range(-99, 100)] + [k / 80 for k in range(-999, 1000)]
    halves = [(2 * rng.randint(0, 50_000) + 1) / 2000 for _ in range(2000)]
    numbers += halves + [math.nextafter(x, 0) for x in halves] + [math.nextafter(x, 99) for x in halves] + [0.0, 1e-9, 4e-4, 0.0005, 123456.7895]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(to_thousandths("x")).collect()] == [round(x, 3) for x in numbers]
    con = duckdb.connect()
    con.register("numbers", pa.table({"x": numbers}))
    assert [r[0] for r in con.execute(f"SELECT {thousandths_sql('x')} FROM numbers").fetchall()] == [round(x, 3) for x in numbers]


def test_evidence_goes_with_the_alert(spark):
    rules = alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE))
    scores = spark.createDataFrame([("insider", 1, 70.0), ("insider", 2, 10.0)], "family string, company_id long, composite double")
    table = spark.createDataFrame([(1, "SHORT_INTEREST_ONLY"), (3, "SHORT_INTEREST_ONLY")], "company_id long, label string")
    evidence = spark.createDataFrame([("insider", 1, "e2"), ("insider", 1, "e1"), ("short_interest", 1, "s1"), ("insider", 2, "e3")], "family string, company_id long, evidence_id string")
    hits = alerts.threshold_hits(rules, scores).unionByName(alerts.label_hits(rules, table))
    fresh = alerts.new_alerts(alerts.with_evidence(hits, evidence), spark.createDataFrame([], "name string, company_id long, alert_date date"), DAY)
    assert {(r.name, r.company_id): r.evidence_ids for r in fresh.collect()} == {("insider strong", 1): ["e1", "e2"], ("labels", 1): ["e1", "e2", "s1"], ("labels", 3): []}
    got = {(r.name, r.company_id): json.loads(r.payload) for r in alerts.payloads(fresh, rules).collect()}
    assert got["insider strong", 1]["source_event_ids"] == ["e1", "e2"] and len(got) == 3
    assert [r.company_id for r in alerts.listing(fresh, rule="labels").collect()] == [1, 3] and alerts.listing(fresh, company=3).count() == 1


def test_append_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    none = spark.createDataFrame([], rows.schema)
    once = eventlog.new_rows(rows, none, ["k"], [F.col("v")])
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "a"), (2, "c")]
    assert eventlog.new_rows(rows, once, ["k"], [F.col("v")]).count() == 0


def test_stream_equals_batch_and_reruns_add_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50, i) for i in range(200)], "k long, v long")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = ingest.landing(spark, f"{tmp_path}/in", rows.schema, files_per_batch=1)
        ingest.appended_once(stream, f"{tmp_path}/out", f"{tmp_path}/state", ["k"], [F.col("v")], F.floor(F.col("k") / 10)).awaitTermination()
        got = ingest.read_target(spark, f"{tmp_path}/out", rows.schema)
        assert got.count() == got.select("k").distinct().count() == 50


def test_streamed_keys_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, datetime(2026, 1, 1)), (1, datetime(2026, 1, 1, 0, 5)), (2, datetime(2026, 1, 1))], "k long, ts timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.once_within(ingest.landing(spark, f"{tmp_path}/in", rows.schema), ["k"], "ts", "1 hour")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/out").count() == 2
