"""Keyed state: any order of arrival, replays, compaction, and what a batch reads."""

import random
import re
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lanternlog.streaming import ingest, keyed

SIGHTING = "id_type string, id_value string, kind string, name string, ticker string, seen_at date, seen_order long"
TRANSACTION = "person_id long, company_id long, publication_time date, event_id long, is_officer boolean, is_director boolean, is_ten_percent_owner boolean, title string"


def seen(n=400, seed=1):
    rng = random.Random(seed)
    kinds = ["COMPANY", "PERSON", "OTHER", "INSTITUTION"]
    return [("CIK", str(rng.randint(1, 60)), rng.choice(kinds[: 1 + k % 4]), f"name {k}", f"T{k}" if k % 3 else None, date(2026, 1, 1) + timedelta(rng.randint(0, 90)), k) for k in range(n)]


def plain_entities(rows):
    out = {}
    for _, value, kind, name, ticker, _, _ in sorted(rows, key=lambda r: (r[5], r[6])):
        one = out.setdefault(value, [name, kind, ticker, set()])
        one[3].add(kind)
        if kind == "PERSON":
            one[1] = "PERSON"
    return {v: (n, k, t, tuple(sorted(p))) for v, (n, k, t, p) in out.items()}


def entity_rows(merged):
    return {r.id_value: (r.canonical_name, r.kind, r.ticker, tuple(r.profiles)) for r in keyed.entities(merged).collect()}


def new_state(spark, folder, merge=keyed.ENTITIES, parts=8):
    schema = merge(keyed.entity_partials(spark.createDataFrame([], SIGHTING))).schema
    return keyed.KeyedState(spark, f"file://{folder}/state", schema, merge, parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_twice_and_compacted(spark, tmp_path, seed):
    rows = seen(seed=seed)
    want = plain_entities(rows)
    shuffled = random.Random(seed).sample(rows, len(rows))
    state = new_state(spark, tmp_path)
    for k in range(5):
        batch = keyed.entity_partials(spark.createDataFrame(shuffled[k::5], SIGHTING))
        for _ in range(1 + (k == 2)):  # one batch comes twice
            changed = state.upsert(batch, k)
        known = plain_entities([r for j in range(k + 1) for r in shuffled[j::5]])
        assert entity_rows(changed) == {v: known[v] for v in {r[1] for r in shuffled[k::5]}}
        if k == 3:
            state.compact(2)
            assert {r.batch for r in state.rows().select("batch").distinct().collect()} == {2, 3}
    assert entity_rows(state.read()) == want
    state.compact(4)
    assert entity_rows(state.read()) == want and {r.batch for r in state.rows().select("batch").distinct().collect()} == {4}


def test_a_batch_reads_the_parts_of_its_keys(spark, tmp_path):
    state = new_state(spark, tmp_path, parts=32)
    state.upsert(keyed.entity_partials(spark.createDataFrame(seen(), SIGHTING)), 0)
    one = spark.createDataFrame([("CIK", "7", "PERSON", "late", None, date(2025, 1, 1), 9)], SIGHTING)
    changed = state.upsert(keyed.entity_partials(one), 1)
    assert [(r.canonical_name, r.kind) for r in keyed.entities(changed).collect()] == [("late", "PERSON")]
    plan = changed._jdf.queryExecution().executedPlan().toString()
    (part,) = {r.part for r in state.rows().filter("batch = 1").collect()}
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {part}\)", plan)
    read = state.rows([part]).select(F.input_file_name().alias("f")).distinct().collect()
    assert {re.search("/part=([^/]+)/", r.f)[1] for r in read} == {str(part)}


def test_compaction_that_is_stopped_halfway_loses_nothing(spark, tmp_path, monkeypatch):
    rows = seen()
    state = new_state(spark, tmp_path)
    for k in range(3):
        state.upsert(keyed.entity_partials(spark.createDataFrame(rows[k::3], SIGHTING)), k)
    monkeypatch.setattr(keyed, "remove", lambda spark, folder: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        state.compact(2)
    assert entity_rows(state.read()) == plain_entities(rows)


def test_identifiers_are_the_primary_one_and_the_first_ticker(spark):
    rows = [("CIK", "1", "COMPANY", "A", "TA", date(2026, 1, 1), 1), ("CIK", "1", "COMPANY", "B", "TB", date(2026, 1, 2), 2), ("CIK", "2", "COMPANY", "C", None, date(2026, 1, 1), 3), ("CIK", "2", "COMPANY", "C", "TC", date(2026, 1, 3), 4), ("CIK", None, "COMPANY", "D", "TD", date(2026, 1, 3), 5)]
    found = keyed.entities(keyed.ENTITIES(keyed.entity_partials(spark.createDataFrame(rows, SIGHTING))))
    got = Counter((r.identifier_type, r.identifier_value, r.is_primary) for r in keyed.identifiers(found).collect())
    assert got == Counter([("CIK", "1", True), ("TICKER", "TA", False), ("CIK", "2", True)])


def test_streamed_roles_equal_one_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 9), rng.randint(1, 5), date(2026, 1, 1) + timedelta(rng.randint(0, 60)), k, k % 2 == 0, k % 3 == 0, k % 5 == 0, rng.choice(["", None, f"T{k}"])) for k in range(300)]
    df = spark.createDataFrame(rows, TRANSACTION)
    df.repartition(7, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/in")
    state = keyed.KeyedState(spark, f"file://{tmp_path}/state", keyed.ROLES(keyed.role_partials(df)).schema, keyed.ROLES, 4)
    changes = []
    stream = ingest.landing(spark, f"{tmp_path}/in", df.schema, files_per_batch=1)
    keyed.follow(stream, state, keyed.role_partials, f"{tmp_path}/progress", on_change=lambda changed, k: changes.append(changed.count()), compact_every=3).awaitTermination()
    want = {}
    for p, c, at, k, officer, director, owner, title in sorted(rows, key=lambda r: (r[2], r[3])):
        before = want.get((p, c), (None,) * 5)
        want[p, c] = (officer, director, owner, title or before[3], before[4] or at)
    assert {(r.person_id, r.company_id): tuple(r)[2:] for r in keyed.roles(state.read()).collect()} == want
    assert len(changes) >= 7 and max(changes) <= len(want)
