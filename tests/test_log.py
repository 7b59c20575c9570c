"""The laid-out log: both clocks, late batches, replays, stops halfway, compaction, and what its plans read."""

import random
import re
from datetime import date, timedelta

import pytest
from oracle import SF
from pyspark.sql import functions as F

from lanternlog.plans import log as plans
from lanternlog.sources import eventstore
from lanternlog.sources.ledger import Ledger

ROW = "event_id long, company_id long, event_time date, publication_time date, retrieved_at date, created_at date"


def made(n=60, seed=3):
    """Ten years; a third of the rows are one company's; some clocks are missing; some publications come years late."""
    rng, out = random.Random(seed), []
    for k in range(n):
        at = date(2000 + k % 10, rng.choice([2, 5]), 1) + timedelta(rng.randint(0, 27))
        public = None if k % 50 == 0 else at + timedelta(rng.choice([-2, 0, 3, 900]))
        seen = None if k % 7 == 0 else (public or at) + timedelta(rng.choice([0, 1, 60]))
        out.append((k, 1 if k % 3 == 0 else rng.randint(2, 90), at, public, seen, (public or at) + timedelta(1)))
    return out


def a_log(spark, folder, rows, batches=3, parts=2):
    df = spark.createDataFrame(rows, ROW)
    log = eventstore.EventLog(spark, f"file://{folder}/log", df.schema, parts)
    for k in range(batches):
        assert log.append(df.filter(F.col("event_id") % batches == k), k)
    return log


def ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def files(df):
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def months_read(df, column="pub_month"):
    return {int(re.search(rf"/{column}=(\d+)/", f)[1]) for f in files(df)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check_reads(log, rows):
    day = date(2004, 5, 17)
    assert ids(log.rows()) == [r[0] for r in rows]
    assert ids(log.public(day)) == [r[0] for r in rows if r[3] and r[3] <= day]
    assert ids(log.public(day, since=date(2004, 3, 2))) == [r[0] for r in rows if r[3] and date(2004, 3, 2) <= r[3] <= day]
    assert ids(log.ingested(day)) == [r[0] for r in rows if (r[4] or r[5]) <= day]
    assert ids(log.happened(date(2003, 1, 1), day)) == [r[0] for r in rows if r[3] and r[3] <= day and r[2] >= date(2003, 1, 1)]


def test_both_clocks_before_and_after_compaction(spark, tmp_path):
    rows = made()
    log = a_log(spark, tmp_path, rows)
    check_reads(log, rows)
    before = len(files(log.rows()))
    assert log.compact(1) and not log.compact(1)
    check_reads(log, rows)
    assert len(files(log.rows())) < before
    log.vacuum()
    check_reads(log, rows)
    assert files(log._all()) == files(log.rows())
    late = spark.createDataFrame([(9999, 5, date(2001, 1, 1), date(2001, 1, 5), date(2020, 1, 1), date(2020, 1, 1))], ROW)
    log.append(late, 3)
    assert 9999 in ids(log.public(date(2001, 1, 31), since=date(2001, 1, 1))) and 9999 not in ids(log.ingested(date(2019, 12, 31)))


def test_a_quarter_of_ten_years_reads_its_own_months(spark, tmp_path):
    log = a_log(spark, tmp_path, made())
    quarter = log.public(date(2005, 6, 30), since=date(2005, 4, 1))
    assert months_read(quarter) <= {200504, 200505, 200506} and "PartitionFilters: [" in plan_of(quarter)
    assert max(months_read(log.ingested(date(2002, 2, 3)), "in_month")) <= 200202
    assert min(months_read(log.happened(date(2006, 3, 1), date(2008, 1, 1)))) >= 200602  # the least delay is -2 days


def test_replays_and_batches_that_are_stopped_halfway(spark, tmp_path, monkeypatch):
    rows = made()
    log = a_log(spark, tmp_path, rows[:40])
    df = spark.createDataFrame(rows[40:], ROW)
    assert log.append(df, 2) is False and ids(log.rows()) == list(range(40))
    with pytest.raises(ValueError, match="can't follow"):
        log.append(df, 7)
    with monkeypatch.context() as m:
        m.setattr(Ledger, "commit", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError, match="stopped"):
            log.append(df, 3)
        with pytest.raises(OSError, match="stopped"):
            log.compact(1)
    check_reads(log, rows[:40])
    again = eventstore.EventLog(spark, f"file://{tmp_path}/log", df.schema, 2)  # as after a restart
    assert again.append(df, 3) and again.compact(1)
    check_reads(again, rows)
    again.vacuum()
    check_reads(again, rows)


def test_empty_batches_and_columns_of_the_layout(spark, tmp_path):
    none = spark.createDataFrame([], ROW)
    log = eventstore.EventLog(spark, f"file://{tmp_path}/log", none.schema)
    assert ids(log.rows()) == [] and log.append(none, 0) and ids(log.public(date(2020, 1, 1))) == [] and log.state["last"] == 0
    with pytest.raises(ValueError, match="layout"):
        eventstore.EventLog(spark, f"file://{tmp_path}/other", none.withColumn("log_part", F.lit(1)).schema)


def test_a_hot_company_is_many_files(spark, tmp_path):
    rows = [(k, 1, date(2000, 1, 1), date(2000, 1, 1 + k % 28), None, date(2000, 2, 1)) for k in range(4000)]
    log = a_log(spark, tmp_path, rows, batches=1)
    assert len(files(log.rows())) >= 4


def test_plans_prune_months_and_companies(spark, monkeypatch):
    log = plans.transaction_log(spark, SF)
    monkeypatch.setattr(plans, "transaction_log", lambda *_: log)
    public, radar, sector = plans.t01_laid_out(spark, SF), plans.r04_laid_out(spark, SF), plans.t04_laid_out(spark, SF)
    for df in (public, radar, sector):
        assert re.search(r"PartitionFilters: \[[^\]]*pub_month#\d+", plan_of(df))
    assert "dynamicpruning" in plan_of(sector)
