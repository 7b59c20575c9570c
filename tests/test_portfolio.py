"""Position changes by batches of filings: late and amended ones, replays, stops, and what a batch makes and reads."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import derive
from lanternlog.streaming import portfolio

ROWS = "institution_id long, period_of_report date, accession string, filed date, company_id long, shares decimal(20,4), market_value_usd decimal(20,2)"
PERIODS = [date(2025, 3, 31), date(2025, 6, 30), date(2025, 9, 30), date(2025, 12, 31)]


def filings(seed):
    """Filings by accession, some amended, one withdrawn: accession -> rows."""
    rng, out = random.Random(seed), {}
    for i in range(5):
        for p, period in enumerate(PERIODS):
            for version in range(rng.choice([1, 1, 2, 3])):
                name, filed = f"{i}-{p}-{version}", date(period.year + (period.month == 12), period.month % 12 + 1, 10 + version)
                held = rng.sample(range(8), rng.randint(1, 6))
                rows = [(i, period, name, filed, c, Decimal(rng.randint(1, 4)), Decimal(c)) for c in held]
                rows += rows[:1]  # a company in two lots
                out[name] = rows
    out["1-1-9"] = [(1, PERIODS[1], "1-1-9", date(2026, 5, 1), None, None, None)]
    return out


def counted(found):
    """The holdings of the filings that count."""
    best = {}
    for name, rows in found.items():
        key = rows[0][:2]
        best[key] = max(best.get(key, (date.min, "")), (rows[0][3], name))
    return [r for name, rows in found.items() if best[rows[0][:2]][1] == name for r in rows if r[4] is not None]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("institution_id", "period_of_report", "company_id", "shares", "market_value_usd", "shares_change", "position_status", "publication_time").collect())


def by_batch(spark, found):
    return as_rows(derive.position_changes(derive.quarter_holdings(spark.createDataFrame(counted(found), ROWS))))


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_filings_gives_the_batch_result(spark, tmp_path, seed):
    found = filings(seed)
    order = random.Random(seed).sample(list(found), len(found))
    kept, upto = portfolio.Portfolios(spark, f"file://{tmp_path}/p", parts=3), []
    for k in range(3):
        names = order[k::3]
        # an accession of the batch before comes again, and rows that are no filing
        rows = [r for n in names + order[k - 1 :: 3][: k and 2] for r in found[n]] + [(None, PERIODS[0], "x", None, 1, None, None), (1, None, "y", None, 1, None, None)]
        assert kept.add(spark.createDataFrame(rows, ROWS), k) and not kept.add(spark.createDataFrame(rows, ROWS), k)
        upto.append({n: found[n] for j in range(k + 1) for n in order[j::3]})
        assert as_rows(kept.read()) == by_batch(spark, upto[-1])
    assert as_rows(kept.read(upto=0)) == by_batch(spark, upto[0])
    assert kept.add(spark.createDataFrame([], ROWS), 3) and as_rows(kept.read()) == by_batch(spark, found)


def test_a_batch_makes_its_period_and_the_next_and_reads_their_folders(spark, tmp_path):
    one = lambda p, name, n: [(7, PERIODS[p], name, date(2026, 2, 1), c, Decimal(n), Decimal(1)) for c in range(3)]
    kept = portfolio.Portfolios(spark, f"file://{tmp_path}/p", parts=3)
    kept.add(spark.createDataFrame([r for p in (0, 2, 3) for r in one(p, f"a{p}", p + 1)], ROWS), 0)
    kept.add(spark.createDataFrame(one(1, "late", 9), ROWS), 1)
    made = {r.period_of_report for r in kept.rows("versions", 1, 1).collect()}
    assert made == {PERIODS[1], PERIODS[2]}
    assert {r.at for r in kept.held(1, F.lit(True)).select("at").collect()} == {PERIODS[0], PERIODS[1], PERIODS[2]}
    plan = kept.held(1, F.col("part") == 0)._jdf.queryExecution().toString()
    assert any("day#" in line and "part#" in line for line in plan.splitlines() if "PartitionFilters" in line)
    # an original that comes after its amendment changes nothing
    kept.add(spark.createDataFrame([(7, PERIODS[1], "early", date(2025, 8, 1), 1, Decimal(5), Decimal(5))], ROWS), 2)
    assert kept.rows("versions", 2, 2).count() == 0 and {r.position_status for r in kept.read().filter(F.col("period_of_report") == PERIODS[2]).collect()} == {"DECREASED"}


def test_a_batch_that_is_stopped_before_its_note_is_not_seen_and_is_run_again(spark, tmp_path, monkeypatch):
    found = filings(3)
    rows = [r for rs in found.values() for r in rs]
    kept = portfolio.Portfolios(spark, f"file://{tmp_path}/p", parts=2)
    commit = kept.ledger.commit
    monkeypatch.setattr(kept.ledger, "commit", lambda state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        kept.add(spark.createDataFrame(rows, ROWS), 0)
    assert kept.read().count() == 0
    monkeypatch.setattr(kept.ledger, "commit", commit)
    assert kept.add(spark.createDataFrame(rows, ROWS), 0) and as_rows(kept.read()) == by_batch(spark, found)
