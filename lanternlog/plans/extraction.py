"""Extraction queries by round trip: views are rendered into filing payloads with Spark, and the extractors' rows must
equal the views again. Registered like the core queries, with the SQL over the views as the expected result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise
from ..operators import derive, eventlog
from ..sources import filings, landing
from .core import AGREED, AS_OF, CH, FUND_COLUMNS, NET, TONE, D, fund_columns, query
from .store import landed, stored
from .views import view


def s(column: str):
    return F.col(column).cast("string")


def tag(name: str, value):
    """<name>value</name>, or nothing where value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def leaf(name: str, value):
    return tag(name, F.concat(F.lit("<value>"), value, F.lit("</value>")))


def joined(order, item):
    """The items of a group as one text, in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(order, item.alias("x"))))["x"], "")


def ten(column: str):
    return F.lpad(s(column), 10, "0")


# --- feeds ---------------------------------------------------------------------------------------------------------


def feeds(spark, d):
    """Atom feeds, one for each 500 accession numbers: an entry for every filer, so that a filing may be listed more than once."""
    rows = view(spark, d, "tb_form4").withColumn("form", F.when(F.col("accession") % 3 == 0, "13F-HR/A").when(F.col("accession") % 3 == 1, "13F-HR").otherwise("4"))
    entry = F.concat(
        F.lit("<entry>"), F.lit('<link rel="alternate" href="https://www.sec.gov/Archives/edgar/data/'), s("company_id"), F.lit('/x-index.htm"/>'), F.lit('<category term="'), F.col("form"), F.lit('"/>'),
        tag("updated", F.concat(s("publication_time"), F.lit("T12:00:00Z"))), tag("id", F.concat(F.lit("urn:tag:sec.gov,2008:accession-number="), s("accession"))), F.lit("</entry>"),
    )
    one = rows.groupBy(F.floor(F.col("accession") / 500).alias("document")).agg(joined(F.col("event_id").alias("o"), entry).alias("entries"))
    return one.select(F.lpad(s("document"), 12, "0").alias("document"), F.concat(F.lit("<feed>"), "entries", F.lit("</feed>")).alias("payload"))


FEED_SQL = "SELECT CAST(accession AS VARCHAR) AS accession, lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik, CASE accession % 3 WHEN 0 THEN '13F-HR/A' WHEN 1 THEN '13F-HR' ELSE '4' END AS form_type, publication_time AS filed FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY event_id) AS n FROM tb_form4) WHERE n = 1"


def feed_columns(df):
    return df.select("accession", "cik", "form_type", F.col("filed_at").cast("date").alias("filed"))


@query("x01_filing_feed", FEED_SQL)
def x01(spark, d):
    """Feeds that are written to compressed files, several in one, and read back with their places in the files."""
    folder = landed(feeds(spark, d).select(F.col("payload").alias("value")), "\n\x1e\n")
    pages = landing.landed_records(spark, folder, "\n\x1e\n")
    return feed_columns(filings.feed_entries(pages.select(F.concat("document", F.lit("#"), F.lpad(s("record_no"), 12, "0")).alias("document"), "payload")))


@query("x02_13f_feed", FEED_SQL + " AND accession % 3 = 1")
def x02(spark, d):
    return feed_columns(filings.feed_entries(feeds(spark, d), forms=["13F-HR"]))


# --- ownership filings ---------------------------------------------------------------------------------------------


def form4_payloads(spark, d):
    """A Form 4 an accession: two reporting owners, all its transactions, one derivative row."""
    rows = view(spark, d, "tb_form4")
    txn = tag(
        "nonDerivativeTransaction",
        F.concat(
            leaf("transactionDate", s("event_time")), tag("transactionCoding", tag("transactionCode", F.col("transaction_code"))),
            tag("transactionAmounts", F.concat(leaf("transactionShares", s("shares")), leaf("transactionPricePerShare", s("price")), leaf("transactionAcquiredDisposedCode", F.col("acquired_disposed")))),
        ),
    )
    one = rows.groupBy("accession").agg(joined(F.col("txn_index").alias("o"), txn).alias("txns"), F.min("company_id").alias("company_id"), F.min("person_id").alias("person_id"))
    owner = lambda cik, flag: tag("reportingOwner", F.concat(tag("reportingOwnerId", tag("rptOwnerCik", cik)), tag("reportingOwnerRelationship", tag("isOfficer", F.lit(flag)))))
    body = F.concat(
        F.lit("<ownershipDocument>"), tag("issuer", F.concat(tag("issuerCik", s("company_id")), tag("issuerName", F.lit("An issuer")))), owner(s("person_id"), "true"), owner((F.col("person_id") + 1000).cast("string"), "false"),
        tag("aff10b5One", F.when(F.col("accession") % 2 == 0, "true").otherwise("0")), tag("nonDerivativeTable", F.col("txns")),
        F.lit("<derivativeTable><derivativeTransaction><transactionDate><value>1999-01-01</value></transactionDate></derivativeTransaction></derivativeTable></ownershipDocument>"),
    )
    return one.select(s("accession").alias("document"), body.alias("payload"))


@query(
    "x03_form4_transactions",
    """WITH n AS (SELECT accession, count(*) AS n, min(person_id) AS person, min(company_id) AS company FROM tb_form4 GROUP BY 1),
o AS (SELECT * FROM (VALUES (0), (1)) v(o)),
t AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY txn_index) - 1 AS k FROM (SELECT accession, txn_index, event_time, transaction_code, shares, price, acquired_disposed FROM tb_form4))
SELECT CAST(accession AS VARCHAR) AS document, lpad(CAST(person + 1000 * o AS VARCHAR), 10, '0') AS owner_cik, lpad(CAST(company AS VARCHAR), 10, '0') AS issuer_cik, o = 0 AS is_officer, accession % 2 = 0 AS is_10b5_1, CAST(o * n + k AS BIGINT) AS transaction_index, event_time, transaction_code, CAST(shares AS DOUBLE) AS shares, CAST(price AS DOUBLE) AS price, acquired_disposed, CAST(1 AS BIGINT) AS skipped_derivatives
FROM t JOIN n USING (accession) CROSS JOIN o""",
)
def x03(spark, d):
    out = filings.form4_transactions(form4_payloads(spark, d))
    return out.select(
        "document", "owner_cik", "issuer_cik", "is_officer", "is_10b5_1", F.col("transaction_index").cast("bigint").alias("transaction_index"), "event_time", "transaction_code",
        F.col("shares").cast("double").alias("shares"), F.col("price").cast("double").alias("price"), "acquired_disposed", F.col("skipped_derivatives").cast("bigint").alias("skipped_derivatives"),
    )


END = "\n</SEC-DOCUMENT>\n"


def submission(header, *documents):
    """A submission's text: a header and (type, body) of its documents."""
    parts = [F.concat(F.lit("<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<TEXT>\n<XML>\n"), text, F.lit("\n</XML>\n</TEXT>\n</DOCUMENT>\n")) for kind, text in documents]
    return F.concat(F.lit("<SEC-DOCUMENT>\n<SEC-HEADER>\n"), header, F.lit("\n</SEC-HEADER>\n"), *parts)


@query("x04_13f_filing", f"WITH {CH} SELECT concat(institution_id, ':', period_of_report, ':', CAST(floor(company_id / 500) AS BIGINT)) AS document, lpad(CAST(institution_id AS VARCHAR), 10, '0') AS filer_cik, period_of_report, lpad(CAST(company_id AS VARCHAR), 9, '0') AS cusip, CAST(shares AS DOUBLE) AS shares, CAST(mv AS DOUBLE) AS market_value_usd FROM h")
def x04(spark, d):
    """Submissions of a cover and a table, of 500 companies each at most, written to files and split again after reading."""
    raw = view(spark, d, "tb_13f_raw").withColumn("cusip", F.lpad(s("company_id"), 9, "0"))
    row = tag("infoTable", F.concat(tag("nameOfIssuer", F.col("cusip")), tag("cusip", F.col("cusip")), tag("value", s("market_value_usd")), tag("shrsOrPrnAmt", tag("sshPrnamt", s("shares")))))
    some = raw.groupBy("institution_id", "period_of_report", F.floor(F.col("company_id") / 500).alias("part"))
    one = some.agg(joined(F.struct("company_id", "shares", "market_value_usd").alias("o"), row).alias("rows"))
    cover = F.concat(
        F.lit("<edgarSubmission><headerData><filerInfo><filer><credentials>"), tag("cik", s("institution_id")), F.lit("</credentials></filer>"), tag("periodOfReport", F.date_format("period_of_report", "MM-dd-yyyy")),
        F.lit("</filerInfo></headerData><formData><coverPage><filingManager><name>A manager</name></filingManager></coverPage></formData></edgarSubmission>"),
    )
    header = F.concat(F.lit("ACCESSION NUMBER: "), s("institution_id"), F.lit(":"), s("period_of_report"), F.lit(":"), s("part"))
    text = submission(header, (F.lit("13F-HR"), cover), (F.lit("INFORMATION TABLE"), F.concat(F.lit("<informationTable>"), "rows", F.lit("</informationTable>"))))
    read = landing.submission_documents(landing.landed_records(spark, landed(one.select(text.alias("value")), END), END))
    docs = read.select(F.regexp_extract("header", r"ACCESSION NUMBER: (\S+)", 1).alias("document"), landing.document_of("13F-HR").alias("cover"), landing.document_of("INFORMATION TABLE").alias("payload"))
    return filings.holdings_13f(docs).select("document", "filer_cik", "period_of_report", "cusip", F.col("shares").cast("double").alias("shares"), F.col("market_value_usd").cast("double").alias("market_value_usd"))


def schedules(spark, d, form: str):
    rows = view(spark, d, "tb_ownership").filter(F.col("form_type") == f"SCHEDULE {form}")
    return rows.withColumn("document", F.concat(s("accession"), F.lit(":"), s("filer_id"), F.lit(":"), s("company_id"), F.lit(":"), s("shares_owned"), F.lit(":"), s("publication_time"), F.lit(":"), F.coalesce("type_code", F.lit("-")))).dropDuplicates(["document"])


@query("x05_search_leads", "SELECT CAST(accession AS VARCHAR) AS accession, min(publication_time) AS file_date FROM tb_ownership WHERE form_type = 'SCHEDULE 13D' GROUP BY 1")
def x05(spark, d):
    rows = view(spark, d, "tb_ownership").withColumn("form", F.when(F.col("form_type") == "SCHEDULE 13D", F.col("form_type")).otherwise("SCHEDULE 13D/A"))
    hit = F.struct("publication_time", F.struct(F.struct(F.array(ten("company_id")).alias("ciks"), "form", s("accession").alias("adsh"), s("publication_time").alias("file_date")).alias("_source")).alias("h"))
    # a page for each 500 accession numbers
    pages = rows.groupBy(F.floor(F.col("accession") / 500).alias("p")).agg(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["h"]).alias("hits"))
    docs = pages.select(F.lpad(s("p"), 12, "0").alias("document"), F.to_json(F.struct(F.struct("hits").alias("hits"))).alias("payload"))
    return filings.search_leads(docs, "SCHEDULE 13D").select("accession", "file_date")


SCHEDULE_SQL = "SELECT DISTINCT concat(accession, ':', filer_id, ':', company_id, ':', shares_owned, ':', publication_time, ':', coalesce(type_code, '-')) AS document, lpad(CAST(company_id AS VARCHAR), 10, '0') AS issuer_cik, lpad(CAST(filer_id AS VARCHAR), 10, '0') AS person_cik, type_code, CAST(shares_owned AS DOUBLE) AS shares_owned FROM tb_ownership WHERE form_type = 'SCHEDULE {}'"


def schedule_columns(df):
    return df.select("document", "issuer_cik", "person_cik", "type_code", F.col("shares_owned").cast("double").alias("shares_owned"))


def no_pad(sql: str) -> str:
    return sql.replace("concat(accession", "concat(CAST(accession AS VARCHAR)")


@query("x06_schedule_13d", no_pad(SCHEDULE_SQL.format("13D")))
def x06(spark, d):
    person = tag(
        "reportingPersonInfo",
        F.concat(tag("reportingPersonCIK", s("filer_id")), F.lit("<reportingPersonNoCIK>N</reportingPersonNoCIK>"), tag("typeOfReportingPerson", F.col("type_code")), tag("aggregateAmountOwned", F.format_number(F.col("shares_owned"), 4))),
    )
    cover = tag("coverPageHeader", F.concat(tag("dateOfEvent", F.date_format("event_date", "MM/dd/yyyy")), tag("issuerInfo", tag("issuerCIK", s("company_id")))))
    body = F.concat(F.lit("<edgarSubmission><formData>"), cover, tag("reportingPersons", person), F.lit("</formData></edgarSubmission>"))
    return schedule_columns(filings.schedule_13d(schedules(spark, d, "13D").select("document", body.alias("payload"))))


@query("x07_schedule_13g", no_pad(SCHEDULE_SQL.format("13G")))
def x07(spark, d):
    spelling = F.when(F.col("company_id") % 2 == 0, tag("issuerCik", s("company_id"))).otherwise(tag("issuerCIK", s("company_id")))
    person = tag("coverPageHeaderReportingPersonDetails", F.concat(tag("typeOfReportingPerson", F.col("type_code")), tag("reportingPersonBeneficiallyOwnedAggregateNumberOfShares", F.format_number(F.col("shares_owned"), 4))))
    head = tag("headerData", tag("filerInfo", tag("filer", tag("filerCredentials", tag("cik", s("filer_id"))))))
    body = F.concat(F.lit("<edgarSubmission>"), head, F.lit("<formData>"), tag("coverPageHeader", tag("issuerInfo", spelling)), person, F.lit("</formData></edgarSubmission>"))
    return schedule_columns(filings.schedule_13g(schedules(spark, d, "13G").select("document", body.alias("payload"))))


#: The zone's rule until 2006 in SQL: daylight time from April's first Sunday to October's last; noon is after the change.
DAYLIGHT = "day >= make_date(year(day), 4, 1) + CAST((7 - dayofweek(make_date(year(day), 4, 1))) % 7 AS INT) AND day < make_date(year(day), 10, 31) - CAST(dayofweek(make_date(year(day), 10, 31)) AS INT)"


@query("x08_acceptance_time", f"SELECT accession, CAST(day AS TIMESTAMP) + INTERVAL (CASE WHEN {DAYLIGHT} THEN 16 ELSE 17 END) HOUR AS accepted_at FROM (SELECT accession, min(publication_time) AS day FROM tb_ownership GROUP BY 1)")
def x08(spark, d):
    """From the first 2 KB of submissions that are written to files and read back."""
    rows = view(spark, d, "tb_ownership").groupBy("accession").agg(F.min("publication_time").alias("at"))
    header = F.concat(F.lit("<ACCEPTANCE-DATETIME>"), F.date_format("at", "yyyyMMdd"), F.lit("120000\nACCESSION NUMBER: "), s("accession"))
    folder = landed(rows.select(submission(header, (F.lit("SCHEDULE 13D"), F.lit("<edgarSubmission/>"))).alias("value")), END)
    read = landing.landed_records(spark, folder, END)
    accession = F.regexp_extract("payload", r"ACCESSION NUMBER: (\d+)", 1).cast(rows.schema["accession"].dataType)
    return read.select(accession.alias("accession"), filings.acceptance_time("payload").alias("accepted_at"))


# --- company facts -------------------------------------------------------------------------------------------------


def fact_payloads(spark, d):
    """Company-facts JSON, one a company: each row of the view as a fundamental and, from annual reports, a dividend."""
    rows = view(spark, d, "tb_xbrl")
    one_of = F.create_map(*(F.lit(x) for kv in (("net_income", "NetIncomeLoss"), ("gross_profit", "GrossProfit"), ("operating_income", "OperatingIncomeLoss"), ("eps_diluted", "EarningsPerShareDiluted")) for x in kv))
    revenue = F.when(F.col("concept") == "TagA", "Revenues").otherwise("RevenueFromContractWithCustomerExcludingAssessedTax")
    concept = F.when(F.col("metric") == "revenue", revenue).otherwise(one_of[F.col("metric")])
    unit = F.when(F.col("metric") == "eps_diluted", "USD/shares").otherwise("USD")
    fact = F.struct(s("value").alias("val"), s("period_start").alias("start"), s("period_end").alias("end"), s("filed").alias("filed"), "form", s("accession").alias("accn"))
    reported = F.struct(concept.alias("c"), unit.alias("unit"))
    dividend = F.when(F.col("metric") == "revenue", F.struct(F.lit("PaymentsOfDividends").alias("c"), F.lit("USD").alias("unit")))
    some = rows.select("company_id", F.explode(F.array_compact(F.array(reported, dividend))).alias("k"), fact.alias("f")).select("company_id", "k.c", "k.unit", "f")
    units = some.groupBy("company_id", "c", "unit").agg(F.struct(F.create_map("unit", F.collect_list("f")).alias("units")).alias("u"))
    docs = units.groupBy("company_id").agg(F.map_from_entries(F.collect_list(F.struct("c", "u"))).alias("us-gaap"))
    return docs.select(s("company_id").alias("document"), F.to_json(F.struct(F.lit("A company").alias("entityName"), F.struct("us-gaap").alias("facts"))).alias("payload"))


@query("x09_capital_allocation", "SELECT CAST(company_id AS BIGINT) AS company_id, 'DIVIDEND_PAYMENT' AS event_type, CAST(value AS DOUBLE) AS value, period_start, period_end, filed FROM tb_xbrl WHERE metric = 'revenue' AND form = '10-K' AND date_diff('day', period_start, period_end) BETWEEN 330 AND 380")
def x09(spark, d):
    facts = filings.capital_allocation(filings.company_facts(fact_payloads(spark, d)))
    return facts.select(F.col("document").cast("bigint").alias("company_id"), "event_type", F.col("value").cast("double").alias("value"), "period_start", "period_end", "filed")


@query("x10_fundamental_facts", f"WITH {AGREED} SELECT {FUND_COLUMNS} FROM fund")
def x10(spark, d):
    facts = filings.fundamental_facts(filings.company_facts(fact_payloads(spark, d)))
    return fund_columns(derive.fundamentals(facts.withColumns({"company_id": F.col("document").cast("bigint"), "accession": F.col("accession").cast("bigint")})))


# --- funds and 8-K lists -------------------------------------------------------------------------------------------


def submissions(rows, key: str, order, form, items, accession, day, page=None):
    """Submissions JSON, one a key (and page), with its filings as parallel arrays in order."""
    one = rows.groupBy(key, *([page.alias("page")] if page is not None else [])).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), form.alias("form"), items.alias("items"), accession.alias("acc"), day.alias("day")))).alias("f"))
    at = lambda name: F.transform("f", lambda x: x[name])
    recent = F.struct(
        at("form").alias("form"), at("items").alias("items"), at("acc").alias("accessionNumber"), at("day").alias("filingDate"),
        F.transform("f", lambda x: F.concat(x["day"], F.lit("T12:00:00.000Z"))).alias("acceptanceDateTime"), F.transform("f", lambda x: F.lit("doc.htm")).alias("primaryDocument"),
    )
    body = F.struct(F.lit("A company").alias("name"), F.array(F.lit("TICK")).alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))
    name = s(key) if page is None else F.concat(s(key), F.lit(":"), F.lpad(s("page"), 12, "0"))
    return one.select(name.alias("document"), F.to_json(body).alias("payload"))


@query("x11_nport_leads", "SELECT fund_id, accession, filing_date FROM (SELECT CAST(fund_id AS BIGINT) AS fund_id, CAST(period_end AS VARCHAR) AS accession, publication_time AS filing_date, row_number() OVER (PARTITION BY fund_id ORDER BY period_end) AS n FROM tb_fund_aum WHERE month(period_end) <> 12) WHERE n <= 20")
def x11(spark, d):
    rows = view(spark, d, "tb_fund_aum")
    form = F.when(F.month("period_end") == 12, "NPORT-P/A").otherwise("NPORT-P")
    docs = submissions(rows, "fund_id", F.col("period_end"), form, F.lit(""), s("period_end"), s("publication_time"))
    return filings.nport_leads(docs, 20).select(F.col("document").cast("bigint").alias("fund_id"), "accession", "filing_date")


@query("x12_nport_snapshot", "SELECT CAST(fund_id AS BIGINT) AS fund_id, period_end, CASE WHEN fund_id % 2 = 0 THEN NULL ELSE 'Series' END AS series_name, CAST(net_assets_usd AS DOUBLE) AS net_assets FROM tb_fund_aum WHERE month(period_end) <> 6")
def x12(spark, d):
    rows = view(spark, d, "tb_fund_aum")
    general = tag("genInfo", F.concat(tag("seriesName", F.when(F.col("fund_id") % 2 == 0, "N/A").otherwise("Series")), tag("repPdDate", s("period_end"))))
    info = tag("fundInfo", F.concat(tag("totAssets", s("net_assets_usd")), tag("netAssets", F.when(F.month("period_end") == 6, "unknown").otherwise(s("net_assets_usd")))))
    docs = rows.select(s("fund_id").alias("document"), F.concat(F.lit("<edgarSubmission>"), tag("formData", F.concat(general, info)), F.lit("</edgarSubmission>")).alias("payload"))
    return filings.nport_snapshots(docs).select(F.col("document").cast("bigint").alias("fund_id"), "period_end", "series_name", F.col("net_assets_usd").cast("double").alias("net_assets"))


def eight_k(spark, d, items, limit):
    rows = view(spark, d, "tb_8k")
    # a page of a registrant for each 20,000 accession numbers
    docs = submissions(rows, "company_id", F.col("accession"), F.col("form"), F.col("item_codes"), F.lpad(s("accession"), 18, "0"), s("filing_date"), F.floor(F.col("accession") / 20_000))
    pages = filings.disclosures_8k(filings.recent_filings(docs), items).withColumn("registrant", F.substring_index("document", ":", 1))
    out = filings.first_n(pages, limit, by="registrant", order=("document", "pos"))
    url = filings.document_url(normalise.cik("registrant"), F.col("accession"), F.col("primary_document"))
    return out.select(F.col("registrant").cast("bigint").alias("company_id"), F.col("accession").cast("bigint").alias("accession"), "item_codes", "filing_date", url.alias("url"))


def eight_k_sql(items: str) -> str:
    return f"""SELECT company_id, accession, item_codes, filing_date, concat('https://www.sec.gov/Archives/edgar/data/', CASE WHEN company_id = 0 THEN '' ELSE CAST(company_id AS VARCHAR) END, '/', lpad(CAST(accession AS VARCHAR), 18, '0'), '/doc.htm') AS url
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY accession) AS n FROM tb_8k WHERE form = '8-K' AND len(list_intersect(list_transform(string_split(item_codes, ','), lambda c: trim(c)), {items})) > 0) WHERE n <= 20"""


@query("x13_guidance", eight_k_sql("['2.02', '7.01']"))
def x13(spark, d):
    return eight_k(spark, d, filings.GUIDANCE_ITEMS, 20)


@query("x14_mergers", eight_k_sql("['2.01']"))
def x14(spark, d):
    return eight_k(spark, d, filings.MERGER_ITEMS, 20)


# --- short interest ------------------------------------------------------------------------------------------------


@query(
    "x15_candidate_dates",
    """WITH a AS (SELECT DISTINCT settlement_date AS as_of FROM tb_short_interest), m AS (SELECT as_of, CAST(date_trunc('month', as_of) - to_months(CAST(i AS INT)) AS DATE) AS m FROM a, range(0, 4) r(i)),
c AS (SELECT as_of, m + CAST(k AS INT) AS settlement_date FROM m, range(11, 17) r(k) UNION SELECT as_of, last_day(m) - CAST(k AS INT) FROM m, range(0, 5) r(k)) SELECT as_of, settlement_date FROM c WHERE settlement_date <= as_of""",
)
def x15(spark, d):
    """Of every day on which a cycle settled: the days on which cycles may have settled by then."""
    return filings.settlement_candidates(view(spark, d, "tb_short_interest").select(F.col("settlement_date").alias("as_of")).distinct())


@query("x16_confirmed_cycles", f"SELECT DISTINCT settlement_date FROM tb_short_interest WHERE settlement_date <= {D} AND settlement_date >= DATE '1999-10-01' AND (day(settlement_date) BETWEEN 12 AND 17 OR settlement_date > last_day(settlement_date) - 5) ORDER BY settlement_date DESC LIMIT 5")
def x16(spark, d):
    return filings.confirmed_cycles(filings.candidate_settlement_dates(spark, AS_OF), view(spark, d, "tb_short_interest"), 5)


@query("x17_short_interest_records", "SELECT CAST(company_id AS BIGINT) AS company_id, concat('T', CAST(company_id AS VARCHAR)) AS ticker, settlement_date, CAST(current_short_position AS DOUBLE) AS position, CASE WHEN company_id % 3 = 0 THEN NULL ELSE round(average_daily_volume, 2) END AS volume FROM tb_short_interest WHERE month(settlement_date) <> 2")
def x17(spark, d):
    rows = view(spark, d, "tb_short_interest")
    record = F.struct(
        F.when(F.col("company_id") % 2 == 0, F.concat(F.lit("T"), s("company_id"))).otherwise("").alias("symbolCode"), s("settlement_date").alias("settlementDate"),
        F.when(F.month("settlement_date") == 2, "none").otherwise(s("current_short_position")).alias("currentShortPositionQuantity"),
        F.when(F.col("company_id") % 3 == 0, "n/a").otherwise(F.round("average_daily_volume", 2).cast("decimal(20,2)").cast("string")).alias("averageDailyVolumeQuantity"),
    )
    docs = rows.groupBy("company_id").agg(F.to_json(F.collect_list(record)).alias("payload")).select(s("company_id").alias("document"), F.concat(F.lit("t"), s("company_id")).alias("requested"), "payload")
    out = filings.short_interest_records(docs)
    return out.select(F.col("document").cast("bigint").alias("company_id"), "ticker", "settlement_date", F.col("current_short_position").cast("double").alias("position"), F.col("average_daily_volume").cast("double").alias("volume"))


# --- registers, wallets, indexes, tone -----------------------------------------------------------------------------


@query("x18_company_profile", "SELECT CAST(entity_id AS VARCHAR) AS company_number, canonical_name AS company_name, country AS jurisdiction FROM tb_companies")
def x18(spark, d):
    body = F.to_json(F.struct(F.col("canonical_name").alias("company_name"), s("entity_id").alias("company_number"), F.col("country").alias("jurisdiction")))
    docs = view(spark, d, "tb_companies").select(s("entity_id").alias("document"), body.alias("payload"))
    return filings.company_profiles(docs).select("company_number", "company_name", "jurisdiction")


@query("x19_control_register", "SELECT company_id, psc_name, notified_on, ceased_on, CASE WHEN lower(trim(country_registered)) = 'england' THEN CAST(psc_id AS VARCHAR) END AS registration_number FROM tb_control")
def x19(spark, d):
    item = F.struct(
        F.col("psc_name").alias("name"), F.col("psc_kind").alias("kind"), s("notified_on").alias("notified_on"), s("ceased_on").alias("ceased_on"), F.struct(F.concat(F.lit("/psc/"), s("psc_id")).alias("self")).alias("links"),
        F.struct(s("psc_id").alias("registration_number"), "country_registered").alias("identification"),
    )
    pages = view(spark, d, "tb_control").groupBy("company_id", F.floor(F.col("psc_id") / 5000).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    out = filings.control_register(pages.select(s("company_id").alias("document"), "payload"))
    return out.select(F.col("document").cast(view(spark, d, "tb_control").schema["company_id"].dataType).alias("company_id"), "psc_name", "notified_on", "ceased_on", "registration_number")


@query("x20_wallet_net", f"WITH {NET} SELECT CAST(address AS VARCHAR) AS address, CAST(tx_hash AS VARCHAR) AS tx_hash, CAST(sats AS DOUBLE) / 1e8 AS net_amount FROM net")
def x20(spark, d):
    rows = view(spark, d, "tb_wallet_legs")
    other = F.struct(F.lit("elsewhere").alias("addr"), F.lit(77).cast("long").alias("value"))
    own = F.struct(s("address").alias("addr"), F.col("satoshis").alias("value"))
    is_in = F.col("leg") == "in"
    tx = F.struct(
        s("tx_hash").alias("hash"), F.unix_timestamp(F.col("tx_date").cast("timestamp")).alias("time"),
        F.array(F.struct(F.when(is_in, own).otherwise(other).alias("prev_out"))).alias("inputs"), F.array(F.when(is_in, other).otherwise(own)).alias("out"),
    )
    docs = rows.groupBy("address").agg(F.collect_list(tx).alias("txs")).select(F.to_json(F.struct(s("address").alias("address"), "txs")).alias("payload"))
    return filings.net_effects(filings.wallet_legs(docs)).select("address", "tx_hash", F.col("net_amount").cast("double").alias("net_amount"))


INDEX = r"index=([^/]+)/"


def index_files(spark, d) -> str:
    """A folder of CSV files, one an index: a lower-case header after a blank line; CLICK's comes second, VIEW's is another,
    and SIGNUP has a line with a value that is none. Lines of another width are everywhere."""
    rows = view(spark, d, "tb_volatility").select(F.lower("index_code").alias("index"), F.concat(F.lit("b"), s("trade_date")).alias("o"), F.concat_ws(",", F.date_format("trade_date", "M/d/yyyy"), s("open"), s("high"), s("low"), s("close")).alias("value"))
    code = F.col("index")
    top = F.when(code == "click", F.array(F.lit("a note"), F.lit("DATE,OPEN,HIGH,LOW,CLOSE"))).when(code == "view", F.array(F.lit("DAY,VALUE"))).otherwise(F.array(F.lit(""), F.lit("date,open,high,low,close"), F.lit("01/02/2024,1")))
    head = rows.select("index").distinct().select("index", F.posexplode(top).alias("k", "value")).select("index", F.concat(F.lit("a"), s("k")).alias("o"), "value")
    bad = rows.filter(code == "signup").select("index").distinct().select("index", F.lit("c").alias("o"), F.lit("01/02/2024,1,none,1,1").alias("value"))
    whole = head.unionByName(rows).unionByName(bad).repartition("index").sortWithinPartitions("index", "o").select("index", "value")
    return landed(whole, by="index")


@query("x21_index_levels", "SELECT index_code, trade_date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close FROM tb_volatility WHERE index_code NOT IN ('VIEW', 'CLICK', 'SIGNUP')")
def x21(spark, d):
    out = filings.index_levels(landing.landed_records(spark, index_files(spark, d)), INDEX)
    return out.select("index_code", "trade_date", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")))


@query("x22_tone", f"WITH {TONE} SELECT company_id, article_count, mean_tone FROM tone WHERE article_count > 0")
def x22(spark, d):
    rows = view(spark, d, "tb_tone")
    docs = rows.groupBy("company_id").agg(F.to_json(F.struct(F.collect_list(F.struct("bin", F.col("n").alias("count"))).alias("tonechart"))).alias("payload")).select(F.col("company_id").alias("document"), "payload")
    return filings.tone(filings.tone_bins(docs)).select("company_id", "article_count", "mean_tone")


@query("x23_normalisers", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS DOUBLE) END AS balance FROM customer")
def x23(spark, d):
    from .views import base

    rows = base(spark, d, "customer")
    blank = F.when(F.col("c_custkey") % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    said = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.format_number(F.col("c_acctbal").cast("decimal(14,2)"), 2))
    return rows.select("c_custkey", normalise.cik(F.concat(F.lit(" 000"), s("c_custkey"))).alias("cik"), normalise.text_or_null(blank).alias("name"), normalise.number(said, "decimal(14,2)").cast("double").alias("balance"))


# --- batches with payloads that can't be parsed --------------------------------------------------------------------


SOURCES = {
    "form4": landing.Source("form4", "xml", filings.FORM4, filings.form4_transactions, ["document", "transaction_index"]),
    "nport": landing.Source("nport", "xml", filings.NPORT, filings.nport_snapshots, ["document"], complete="parsed.formData.fundInfo.netAssets IS NOT NULL"),
    "short_interest": landing.Source("short_interest", "json", filings.SHORT_INTEREST, filings.short_interest_records, ["document", "settlement_date"]),
    "tone": landing.Source("tone", "json", filings.TONE, lambda p: filings.tone_bins(p).withColumnRenamed("company_id", "document"), ["document", "bin"]),
    "control": landing.Source("control", "json", filings.CONTROL, filings.control_register, ["psc_link"]),
}
#: Of each source's documents, by their number modulo 10: 0 is cut off, 1 is in the target already, 2 has no rows, 3 is blank.
NOTHING = {"form4": "<ownershipDocument><documentType>4</documentType></ownershipDocument>", "short_interest": "[]", "tone": '{"tonechart":[]}', "control": '{"items":[]}'}


def batches(spark, d):
    """name to (number of a document, document, payload, requested) of five sources."""
    nport = view(spark, d, "tb_fund_aum").withColumn("number", F.year("period_end") * 10 + F.quarter("period_end") * 3 + F.col("fund_id"))
    general = tag("genInfo", tag("repPdDate", s("period_end")))
    info = tag("fundInfo", F.concat(tag("totAssets", s("net_assets_usd")), tag("netAssets", F.when(F.col("number") % 10 != 2, s("net_assets_usd")))))
    shorts = view(spark, d, "tb_short_interest").groupBy("company_id").agg(F.to_json(F.collect_list(F.struct(s("settlement_date").alias("settlementDate"), s("current_short_position").alias("currentShortPositionQuantity")))).alias("payload"))
    bins = view(spark, d, "tb_tone").groupBy("company_id").agg(F.to_json(F.struct(F.collect_list(F.struct("bin", F.col("n").alias("count"))).alias("tonechart"))).alias("payload"))
    item = F.struct(F.col("psc_name").alias("name"), F.struct(F.concat(F.lit("/psc/"), s("psc_id")).alias("self")).alias("links"))
    pages = view(spark, d, "tb_control").groupBy(F.floor(F.col("psc_id") / 20).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("payload"))
    docs = {
        "form4": form4_payloads(spark, d).withColumn("number", F.col("document").cast("long")),
        "nport": nport.select("number", F.concat(s("fund_id"), F.lit(":"), s("period_end")).alias("document"), F.concat(F.lit("<edgarSubmission>"), tag("formData", F.concat(general, info)), F.lit("</edgarSubmission>")).alias("payload")),
        "short_interest": shorts.select(F.col("company_id").alias("number"), s("company_id").alias("document"), "payload"),
        "tone": bins.select(F.col("company_id").alias("number"), s("company_id").alias("document"), "payload"),
        "control": pages.select(F.col("page").alias("number"), s("page").alias("document"), "payload"),
    }
    out = {}
    for name, rows in docs.items():
        r = F.col("number") % 10
        payload = F.when(r == 0, F.left("payload", F.length("payload") - 4)).when(r == 3, " ").otherwise(F.col("payload"))
        payload = F.when((r == 2), F.lit(NOTHING[name])).otherwise(payload) if name in NOTHING else payload
        out[name] = rows.select("number", "document", payload.alias("payload"), F.lit("t").alias("requested"))
    return out


def intakes(spark, d, keep=stored):
    """The five sources' batches taken in, each against a target that has what the documents numbered 1 have."""
    for name, batch in batches(spark, d).items():
        source = SOURCES[name]
        before = source.extract(batch.filter("number % 10 = 1")).select(*source.keys)
        yield landing.intake(batch, source, before, keep)


def index_intake(spark, d) -> landing.Intake:
    """The index files' batch, whose unit of rejection is a file of many lines; levels until the 10th are known."""
    lines = landing.landed_records(spark, index_files(spark, d))
    levels = filings.index_levels(lines, INDEX)
    fresh = eventlog.new_rows(levels, levels.filter("trade_date < DATE '2024-01-10'"), ["index_code", "trade_date"], [F.col("close")])
    bad = filings.index_rejects(lines)
    files = lines.select("document").distinct().join(bad.select("document", "reason"), "document", "left")
    return landing.Intake(fresh, bad.select(F.lit("index").alias("source"), F.regexp_extract("document", INDEX, 1).alias("document"), "reason", "payload"), landing.counted("index", files, levels.select("document"), fresh))


def batch_sql(name: str, documents: str) -> str:
    """documents: a query with number, document and rows of every good document. nport's documents without rows are incomplete."""
    empty = "number % 10 = 2 AND NOT incomplete"
    error = "number % 10 IN (0, 3) OR number % 10 = 2 AND incomplete"
    created = "CASE WHEN number % 10 NOT IN (0, 1, 2, 3) THEN n ELSE 0 END"
    return f"SELECT '{name}' AS source, count(*) AS seen, count(*) FILTER (WHERE {error}) AS error, count(*) FILTER (WHERE {empty}) AS empty, CAST(sum({created}) AS BIGINT) AS created, CAST(coalesce(sum(n) FILTER (WHERE number % 10 = 1), 0) AS BIGINT) AS duplicate FROM (SELECT *, '{name}' = 'nport' AS incomplete FROM ({documents}))"


BATCH_SQL = {
    "form4": "SELECT accession AS number, CAST(accession AS VARCHAR) AS document, 2 * count(*) AS n FROM tb_form4 GROUP BY 1",
    "nport": "SELECT year(period_end) * 10 + quarter(period_end) * 3 + fund_id AS number, concat(fund_id, ':', period_end) AS document, 1 AS n FROM tb_fund_aum",
    "short_interest": "SELECT company_id AS number, CAST(company_id AS VARCHAR) AS document, count(*) AS n FROM tb_short_interest GROUP BY 1",
    "tone": "SELECT company_id AS number, CAST(company_id AS VARCHAR) AS document, count(*) AS n FROM tb_tone GROUP BY 1",
    "control": "SELECT CAST(floor(psc_id / 20) AS BIGINT) AS number, CAST(CAST(floor(psc_id / 20) AS BIGINT) AS VARCHAR) AS document, count(*) AS n FROM tb_control GROUP BY 1",
}
INDEX_SQL = "SELECT 'index' AS source, count(DISTINCT index_code) AS seen, 1 AS error, 2 AS empty, count(*) FILTER (WHERE index_code NOT IN ('VIEW', 'CLICK', 'SIGNUP') AND trade_date >= DATE '2024-01-10') AS created, count(*) FILTER (WHERE index_code NOT IN ('VIEW', 'CLICK', 'SIGNUP') AND trade_date < DATE '2024-01-10') AS duplicate FROM tb_volatility"


@query("e16_sources", " UNION ALL ".join([*(batch_sql(name, sql) for name, sql in BATCH_SQL.items()), INDEX_SQL]))
def e16_sources(spark, d):
    """A row of counts for each source: documents seen, in error and empty, rows created and known before."""
    found = [x.summary for x in [*intakes(spark, d), index_intake(spark, d)]]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


REASON = "CASE WHEN number % 10 = 3 THEN 'no payload' WHEN number % 10 = 2 THEN 'incomplete' ELSE 'broken {}' END"
REJECTS = [f"SELECT '{name}' AS source, document, {REASON.format(SOURCES[name].fmt)} AS reason FROM ({sql}) WHERE number % 10 IN ({'0, 2, 3' if name == 'nport' else '0, 3'})" for name, sql in BATCH_SQL.items()]


@query("e16_rejected_payloads", " UNION ALL ".join([*REJECTS, "SELECT DISTINCT 'index', 'signup', 'broken csv' FROM tb_volatility WHERE index_code = 'SIGNUP'"]))
def e16_rejects(spark, d):
    """The quarantine of all sources: broken XML, JSON and CSV, blank and incomplete payloads."""
    found = [x.quarantine for x in [*intakes(spark, d, keep=lambda parsed: parsed), index_intake(spark, d)]]  # read once
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.select("source", "document", "reason")
