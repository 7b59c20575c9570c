"""Alerts and outbox of a stream: replays, and batches that are stopped at each of their steps."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import alerts
from lanternlog.sources.ledger import Ledger
from lanternlog.streaming import ingest, outbox

DAY = date(2026, 3, 2)
SCORES = "family string, company_id long, composite double"
RULES = [("a", 1, "INSIDER_THRESHOLD", 50.0, None, "https://x", "GENERIC"), ("b", 1, "INSIDER_THRESHOLD", 80.0, None, None, None)]


@pytest.fixture
def rules(spark):
    return alerts.current_rules(spark.createDataFrame(RULES, alerts.RULE))


@pytest.fixture
def evidence(spark):
    return spark.createDataFrame([("insider", c, f"e{c}") for c in range(0, 40, 2)], "family string, company_id long, evidence_id string")


def scores(first, n):
    return [("insider", c, float(c * 5 % 101)) for c in range(first, first + n)]


def state_of(box):
    rows = [(r.name, r.company_id, r.composite, tuple(r.evidence_ids)) for r in box.alerts().collect()]
    return sorted(rows), sorted((r.name, r.company_id) for r in box.outbox().collect())


def wanted(rows):
    found = sorted((name, c, x, (f"e{c}",) if c % 2 == 0 else ()) for _, c, x in rows for name, _, _, least, *_ in RULES if x >= least)
    return found, sorted((name, c) for name, c, _, _ in found if name == "a")


def landed(spark, folder, n=40):
    for k in range(0, n, 10):
        spark.createDataFrame(scores(k, 10), SCORES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return ingest.landing(spark, f"{folder}/in", spark.createDataFrame([], SCORES).schema, files_per_batch=1)


@pytest.mark.parametrize("stopped_at", ["alerts", "outbox", "note"])
def test_a_stream_that_is_stopped_leaves_no_gap_and_no_duplicate(spark, tmp_path, monkeypatch, rules, evidence, stopped_at):
    stream, box = landed(spark, tmp_path), outbox.Outbox(spark, f"file://{tmp_path}/box")
    follow = lambda: outbox.alerted(stream, rules, evidence, box, DAY, f"{tmp_path}/state")
    place, name = {"alerts": (alerts, "new_alerts"), "outbox": (alerts, "payloads"), "note": (Ledger, "commit")}[stopped_at]
    right, calls = getattr(place, name), []

    def stops_in_its_third_batch(*args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("stopped")
        return right(*args)

    with monkeypatch.context() as m:
        m.setattr(place, name, stops_in_its_third_batch)
        with pytest.raises(Exception, match="stopped"):
            follow().awaitTermination()
    assert box.last == 1 and state_of(box) != wanted(scores(0, 40))
    follow().awaitTermination()
    assert box.last == 3 and state_of(box) == wanted(scores(0, 40))


def test_replayed_batches_and_known_alerts_add_nothing(spark, tmp_path, rules, evidence):
    box = outbox.Outbox(spark, f"file://{tmp_path}/box")
    hits = lambda rows: alerts.with_evidence(alerts.threshold_hits(rules, spark.createDataFrame(rows, SCORES)), evidence)
    assert box.add(hits(scores(0, 20)), rules, DAY, 0) and not box.add(hits(scores(0, 30)), rules, DAY, 0)
    assert state_of(box) == wanted(scores(0, 20))
    again = outbox.Outbox(spark, f"file://{tmp_path}/box")  # as after a restart
    assert again.add(hits(scores(0, 20) * 2 + scores(20, 10)), rules, DAY, 1) and state_of(again) == wanted(scores(0, 30))
    assert {r.company_id for r in again.outbox(after=0).collect()} == {c for _, c in wanted(scores(20, 10))[1]}
    assert again.add(hits([]), rules, DAY, 2) and again.add(hits(scores(0, 5) + scores(10, 1)), rules, date(2026, 3, 3), 3)
    assert again.alerts(date(2026, 3, 3)).filter(F.col("company_id") == 10).count() == 1  # another day, another alert
