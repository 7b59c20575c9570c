"""Plans that must not do a step again for each row, or move what is large for what is small."""

import random
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from lanternlog.operators import derive, graph
from lanternlog.sources import filings, landing

COVER = "<edgarSubmission><headerData><filerInfo><filer><credentials><cik>{}</cik></credentials></filer>{}</filerInfo></headerData></edgarSubmission>"
TABLE = "<informationTable><infoTable><cusip>A</cusip><value>2</value><shrsOrPrnAmt><sshPrnamt>3</sshPrnamt></shrsOrPrnAmt></infoTable><infoTable><cusip>B</cusip><value>x</value></infoTable></informationTable>"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cover_is_parsed_once_a_filing(spark):
    docs = [("a", COVER.format(7, "<periodOfReport>03-31-2000</periodOfReport>"), TABLE), ("b", COVER.format(8, ""), TABLE), ("c", COVER.format(9, "<periodOfReport>none</periodOfReport>"), TABLE)]
    held = filings.holdings_13f(spark.createDataFrame(docs, "document string, cover string, payload string"))
    assert [(r.document, r.filer_cik, str(r.period_of_report), r.cusip, int(r.shares)) for r in held.collect()] == [("a", "0000000007", "2000-03-31", "A", 3)]
    above, _, below = plan_of(held).partition("Generate")
    assert "from_xml" not in above
    assert below.count("from_xml") == 2  # the table, and the cover beneath it


def test_records_are_not_shuffled_for_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("z\n")
    read = landing.landed_records(spark, str(tmp_path))
    assert sorted((r.document[-5:], r.record_no, r.payload) for r in read.collect()) == [("a.txt", 0, "x"), ("a.txt", 1, "y"), ("b.txt", 0, "z")]
    assert "rightHint=(strategy=broadcast)" in plan_of(read)


def test_interlocks_are_counted_without_their_pairs(spark):
    rows = [(1, 10), (1, 11), (1, 12), (1, 12), (2, 10), (2, 11), (3, 10), (None, 10), (None, 11), (1, None)]
    roles = spark.createDataFrame(rows, "person_id int, company_id int").selectExpr("*", "DATE '2000-01-01' AS start_date", "'x' AS title")
    counted = graph.interlock_count(roles)
    assert counted.first().interlocks == graph.interlocks(roles).count() == 4
    assert "Generate" not in plan_of(counted) and graph.interlock_count(roles.limit(0)).first().interlocks == 0


def test_changes_of_some_periods_equal_those_of_all(spark):
    rng = random.Random(5)
    ends = [date(y, m, 30) for y in (1998, 1999) for m in (3, 6, 9, 12)]
    rows = [(i, p, c, Decimal(rng.randint(1, 3)), Decimal(9)) for i in range(4) for p in ends if rng.random() < 0.7 for c in range(6) if rng.random() < 0.6]
    held = spark.createDataFrame(rows, "institution_id int, period_of_report date, company_id int, shares decimal(28,4), market_value_usd decimal(28,2)")
    since, until = date(1998, 9, 30), date(1999, 6, 30)
    some = derive.position_changes(held, since=since, until=until)
    want = derive.position_changes(held).filter(F.col("period_of_report").between(since, until))
    assert sorted(map(repr, some.collect())) == sorted(map(repr, want.collect())) and want.count() > 20


def test_facts_are_read_once_for_their_agreement(spark):
    q = (date(1999, 1, 1), date(1999, 3, 31))
    rows = [
        (1, "revenue", *q, 5, 2, 1), (1, "revenue", *q, 5, 1, 2), (1, "net_income", *q, 5, 1, 1), (1, "net_income", *q, 6, 1, 1), (2, "revenue", *q, None, 1, 1),
        (2, "eps_diluted", *q, 4, 2, 1), (2, "eps_diluted", *q, None, 3, 1), (None, "revenue", *q, 5, 1, 1), (3, "revenue", q[0], date(1999, 2, 1), 5, 1, 1),
    ]
    facts = spark.createDataFrame(rows, "company_id int, metric string, period_start date, period_end date, value int, lag int, accession int").withColumn("filed", F.date_add("period_end", F.col("lag")))
    made = derive.fundamentals(facts)
    assert sorted((r.company_id, r.revenue, r.net_income, r.eps_diluted, str(r.publication_time)) for r in made.collect()) == [(1, 5, None, None, "1999-04-01"), (2, None, None, 4, "1999-04-02")]
    assert "Join" not in plan_of(made)
