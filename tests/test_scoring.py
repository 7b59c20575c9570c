"""Hand-made rows with known scores."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import backtest, derive, radar, scoring

AS_OF = date(2026, 6, 30)
START = AS_OF - timedelta(90)
COMPANIES = [(1, "One", "s", "c"), (2, "Two", "s", "c")]
TXN = "event_id long, accession string, company_id long, person_id long, transaction_code string, acquired_disposed string, event_time date, publication_time date, shares decimal(20,4), price decimal(20,4), is_10b5_1 boolean"


def companies(spark):
    return spark.createDataFrame(COMPANIES, "entity_id long, canonical_name string, sector string, country string")


ROLE = "person_id long, company_id long, is_officer boolean, is_director boolean, is_ten_percent_owner boolean"


def buy(i, day, dollars, *, person=1, public=None, plan=False, price=True, code="P", company=1):
    from decimal import Decimal

    return (i, f"a{i}", company, person, code, "A", day, public or day, Decimal(dollars), Decimal(1) if price else None, plan)


def score(spark, rows, roles=(), **kw):
    txns = spark.createDataFrame(rows, TXN)
    r = spark.createDataFrame([(*x, *[None] * (5 - len(x))) for x in roles], ROLE)
    return {x.company_id: x for x in scoring.insider_scores(txns, r, companies(spark), AS_OF, **kw).collect()}


def history(*dollars, window=90):
    return [buy(100 + k, START - timedelta(window * k + 1), d) for k, d in enumerate(dollars)]


def test_window_against_its_history(spark):
    got = score(spark, [buy(1, AS_OF - timedelta(5), 100_000), *history(8_000, 9_000, 11_000, 12_000)], lookback_days=360)[1]
    assert got.baseline_percentile == 1.0 and got.size_vs_history == 100.0
    assert got.baseline_z == pytest.approx(0.6745 * 90_000 / 1_500) and got.baseline_z == pytest.approx(40.5, abs=0.1)


def test_no_history_is_a_history_of_zeros(spark):
    got = score(spark, [buy(1, AS_OF - timedelta(5), 100)])[1]
    assert (got.baseline_n, got.baseline_percentile, got.baseline_z) == (8, 1.0, 10.0)


def test_short_history_gives_no_size_component(spark):
    got = score(spark, [buy(1, AS_OF - timedelta(5), 100)], lookback_days=180)[1]
    assert got.size_vs_history is None and "too short" in " ".join(got.notes)
    others = (got.breadth * 0.30 + got.persistence * 0.15 + got.discretion * 0.20) / 0.65
    assert got.composite == pytest.approx(others)


def test_late_publication_is_not_seen(spark):
    assert score(spark, [buy(1, AS_OF - timedelta(5), 100, public=AS_OF + timedelta(1))]) == {}


def test_window_is_half_open(spark):
    assert score(spark, [buy(1, AS_OF, 100)]) == {}
    assert 1 in score(spark, [buy(1, START, 100)])


def test_plan_discount_and_unpriced_rows(spark):
    rows = [buy(1, AS_OF - timedelta(5), 75), buy(2, AS_OF - timedelta(4), 25, plan=True), buy(3, AS_OF - timedelta(3), 50, price=False)]
    got = score(spark, rows)[1]
    assert got.discretion == pytest.approx(100 - 60 * 0.25)
    assert (got.transactions, got.priced, got.window_total) == (3, 2, 100.0)
    assert got.confidence == pytest.approx(2 / 3)
    assert got.persistence == 100.0


def test_senior_buyers(spark):
    rows = [buy(1, AS_OF - timedelta(5), 75, person=1), buy(2, AS_OF - timedelta(4), 25, person=2)]
    got = score(spark, rows, roles=[(1, 1, True), (2, 1, False)])[1]
    assert got.breadth == 25 * 2 + 15
    # a director, or an owner of ten percent, is senior without an office
    assert score(spark, rows, roles=[(1, 1, False, True), (2, 1, False, False, True)])[1].breadth == 25 * 2 + 15 * 2
    evidence = scoring.insider_evidence(spark.createDataFrame(rows, TXN), spark.createDataFrame([(1, 1, False, True, None)], ROLE), AS_OF).orderBy("event_time").collect()
    assert [(e.event_id, e.is_director, e.is_officer) for e in evidence] == [(1, True, False), (2, False, False)]


def test_windows_to_the_second(spark):
    rows = [(*buy(i, AS_OF, 10)[:6], datetime(2026, 6, 30, h), datetime(2026, 6, 30, h), *buy(i, AS_OF, 10)[8:]) for i, h in ((1, 9), (2, 11), (3, 15))]
    txns = spark.createDataFrame(rows, TXN.replace("event_time date, publication_time date", "event_time timestamp, publication_time timestamp"))
    none = spark.createDataFrame([], ROLE)
    seen = lambda at: [r.transactions for r in scoring.insider_scores(txns, none, companies(spark), at, window_days=1).collect()]
    assert seen(datetime(2026, 6, 30, 12)) == [2] and seen(datetime(2026, 7, 1, 10)) == [2] and seen(datetime(2026, 6, 30, 9)) == []
    back = scoring.insider_scores(txns, none, companies(spark), datetime(2026, 7, 1, 12), window_days=1, lookback_days=4).first()
    assert back.transactions == 1 and sorted(back.history) == [0.0, 0.0, 0.0, 20.0]


def test_numbers_are_written_with_thousands_and_half_even(spark):
    got = score(spark, [buy(1, AS_OF - timedelta(5), 1234567)])[1]
    assert "$1,234,567" in got.explanation[0]
    one = spark.range(1).select(F.format_number(F.lit(0.5), 0).alias("a"), F.format_number(F.lit(1.5), 0).alias("b")).first()
    assert (one.a, one.b) == ("0", "2")


@pytest.mark.parametrize("seed", range(3))
def test_later_publications_never_change_the_past(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [buy(i, AS_OF - timedelta(rng.randint(1, 700)), rng.randint(1, 10_000), person=rng.randint(1, 4), company=rng.randint(1, 2)) for i in range(60)]
    later = [buy(1000 + i, AS_OF - timedelta(rng.randint(1, 700)), 10**6, public=AS_OF + timedelta(rng.randint(1, 90))) for i in range(20)]
    keep = lambda s: {k: (v.composite, v.window_total, v.baseline_z) for k, v in s.items()}
    assert keep(score(spark, rows)) == keep(score(spark, rows + later))


def holdings(spark, *rows):
    from decimal import Decimal

    data = [(i, p, c, Decimal(s), Decimal(v)) for i, p, c, s, v in rows]
    return spark.createDataFrame(data, "institution_id long, period_of_report date, company_id long, shares decimal(28,4), market_value_usd decimal(28,2)")


def test_position_changes(spark):
    q1, q2, q3 = date(2025, 12, 31), date(2026, 3, 31), date(2026, 6, 30)
    rows = holdings(spark, (1, q1, 1, 100, 1000), (1, q1, 2, 50, 500), (1, q2, 1, 150, 3000), (1, q3, 1, 150, 3000), (1, q3, 2, 10, 100))
    got = {(r.period_of_report, r.company_id): (r.position_status, None if r.shares_change is None else int(r.shares_change)) for r in derive.position_changes(rows).collect()}
    assert got == {
        (q1, 1): ("NEW", None), (q1, 2): ("NEW", None), (q2, 1): ("INCREASED", 50), (q2, 2): ("EXITED", -50), (q3, 1): ("UNCHANGED", 0), (q3, 2): ("NEW", None),
    }


def test_increase_is_valued_at_the_periods_own_price(spark):
    rows = derive.position_changes(holdings(spark, (1, date(2025, 12, 31), 1, 100, 1000), (1, date(2026, 3, 31), 1, 150, 3000)))
    got = rows.filter("position_status = 'INCREASED'").select(scoring.accumulated().alias("x")).first().x
    assert got == pytest.approx(50 * 3000 / 150)


def test_run_of_increases_stops_at_the_first_other(spark):
    days = [date(2026, 1, 15) + timedelta(15 * k) for k in range(6)]
    change = [5.0, -1.0, 2.0, 3.0, 4.0, 6.0]
    rows = spark.createDataFrame([(1, d, d, c, 100.0, 2.0) for d, c in zip(days, change, strict=True)], "company_id long, settlement_date date, publication_time date, change_percent double, current_short_position double, days_to_cover double")
    got = scoring.short_interest_scores(rows, companies(spark), AS_OF).first()
    assert got.run == 3 and got.persistence == 100.0
    falling = scoring.short_interest_scores(rows.withColumn("change_percent", -F.col("change_percent")), companies(spark), AS_OF)
    assert falling.count() == 0


def test_forward_return(spark):
    from decimal import Decimal

    bars = spark.createDataFrame([(1, date(2026, 1, d), Decimal(c)) for d, c in ((5, 100), (6, 110), (7, 121), (8, 130))], "company_id long, trade_date date, close decimal(14,4)")
    signals = spark.createDataFrame([(1, date(2026, 1, 4)), (1, date(2026, 1, 7)), (1, date(2026, 1, 9)), (2, date(2026, 1, 4))], "company_id long, signal_date date")
    got = {(r.company_id, r.signal_date.day): (r.outcome, r.return_percent) for r in backtest.forward_returns(signals, bars, 2).collect()}
    assert got[1, 4] == ("ok", pytest.approx(21.0))
    assert got[1, 7][0] == "too_few_bars" and got[1, 9][0] == "no_entry" and got[2, 4][0] == "no_entry"


def test_labels(spark):
    cases = [(True, 1, 0, "INSIDER_AND_INSTITUTIONAL_ACCUMULATING"), (True, 0, 1, "MIXED_INSIDER_BUYING_INSTITUTIONAL_SELLING"), (True, 0, 0, "INSIDER_ONLY"), (False, 1, 1, "INSTITUTIONAL_ONLY"), (False, 0, 1, "SHORT_INTEREST_ONLY")]
    df = spark.createDataFrame(cases, "i boolean, a int, d int, want string")
    got = df.select(radar.label(F.col("i"), F.col("a"), F.col("d"), F.col("i")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize("bad", [{"window_days": 0}, {"window_days": 3651}, {"lookback_days": 36501}, {"cycles": 201}, {"top_n": 501}])
def test_radar_parameters_are_checked(bad):
    with pytest.raises(ValueError, match="between"):
        radar.checked(**bad)
