"""Landed filing payloads to typed tables, as bulk jobs over (document, payload) rows.

Every extractor takes a DataFrame with a ``payload`` text column (and what names its document) and returns typed rows;
what can't be parsed gives no row. ``landing.intake`` parses a batch once, hands the result on in ``parsed``, and puts
what can't be parsed into quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normalise import cik, day, eastern_to_utc, number, text_or_null, to_thousandths

from .landing import CORRUPT, OPTIONS, body

PERMISSIVE = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}


# --- feeds and search results --------------------------------------------------------------------------------------


def feed_entries(payloads: DataFrame, forms: list[str] | None = None) -> DataFrame:
    """(accession, cik, form_type, filed_at) of Atom feeds; of a filing that is listed more than once the first entry.

    ``forms`` keeps exact form types only, so that amendments stay out.
    """
    schema = "entry array<struct<id:string,link:struct<_href:string>,category:struct<_term:string>,updated:string>>"
    rows = payloads.select("document", F.posexplode(body(payloads, "xml", schema)["entry"]).alias("pos", "e")).select(
        "document",
        "pos",
        F.nullif(F.regexp_extract("e.id", r"accession-number=([0-9-]+)", 1), F.lit("")).alias("accession"),
        cik(F.regexp_extract("e.link._href", r"/data/(\d+)/", 1)).alias("cik"),
        F.col("e.category._term").alias("form_type"),
        F.col("e.updated").cast("timestamp").alias("filed_at"),
    )
    rows = rows.filter(F.col("accession").isNotNull() & F.col("cik").isNotNull())
    if forms is not None:
        rows = rows.filter(F.col("form_type").isin(forms))
    entry = F.min_by(F.struct("cik", "form_type", "filed_at"), F.struct("document", "pos")).alias("e")
    return rows.groupBy("accession").agg(entry).select("accession", "e.cik", "e.form_type", "e.filed_at")


def search_leads(payloads: DataFrame, form: str, limit: int | None = None) -> DataFrame:
    """(accession, form, ciks, file_date) of full-text search results: the exact form, the first hit of an accession."""
    schema = "hits struct<hits:array<struct<_source:struct<ciks:array<string>,form:string,adsh:string,file_date:string>>>>"
    rows = payloads.select("document", F.posexplode(body(payloads, "json", schema)["hits"]["hits"]).alias("pos", "h")).select(
        "document", "pos", F.col("h._source.adsh").alias("accession"), F.col("h._source.form").alias("form"), F.col("h._source.ciks").alias("ciks"), day("h._source.file_date").alias("file_date")
    )
    rows = rows.filter((F.col("form") == form) & (F.size("ciks") > 0) & F.col("accession").isNotNull())
    first = rows.groupBy("accession").agg(F.min_by(F.struct("form", "ciks", "file_date"), F.struct("document", "pos")).alias("h"), F.min(F.struct("document", "pos")).alias("at"))
    out = first.select("accession", "h.form", "h.ciks", "h.file_date", "at")
    return (out if limit is None else out.orderBy("at").limit(limit)).drop("at")


# --- ownership filings ---------------------------------------------------------------------------------------------

FORM4 = (
    "documentType string, issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, aff10b5One string, "
    "reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,"
    "reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>, "
    "nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:struct<value:string>,transactionCoding:struct<transactionCode:string>,"
    "transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>>>>, "
    "derivativeTable struct<derivativeTransaction:array<struct<transactionDate:struct<value:string>>>>"
)


def form4_transactions(payloads: DataFrame) -> DataFrame:
    """Every reporting owner with every non-derivative transaction that has a date and shares, numbered in that order.

    The plan flag belongs to the filing; skipped_derivatives counts the rows of the other table. A filing is one payload:
    its transactions are made once, as an array, so that each owner's rows are numbered by what the owners before have,
    and nothing is parsed for each owner, shuffled or sorted for the numbers.
    """
    doc = payloads.select("document", body(payloads, "xml", FORM4).alias("f"))
    made = lambda t: F.struct(
        day(t["transactionDate"]["value"]).alias("event_time"),
        F.coalesce(text_or_null(t["transactionCoding"]["transactionCode"]), F.lit("OTHER")).alias("transaction_code"),
        number(t["transactionAmounts"]["transactionShares"]["value"]).alias("shares"),
        number(t["transactionAmounts"]["transactionPricePerShare"]["value"]).alias("price"),
        F.coalesce(text_or_null(t["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"]), F.lit("A")).alias("acquired_disposed"),
    )
    transactions = F.filter(F.transform("f.nonDerivativeTable.nonDerivativeTransaction", made), lambda t: t["event_time"].isNotNull() & t["shares"].isNotNull())
    flag = lambda c: F.coalesce(F.trim(c) == "true", F.lit(False))
    one = doc.select(
        "document",
        "f",
        transactions.alias("transactions"),
        cik("f.issuer.issuerCik").alias("issuer_cik"),
        text_or_null("f.issuer.issuerName").alias("issuer_name"),
        text_or_null("f.issuer.issuerTradingSymbol").alias("ticker"),
        flag("f.aff10b5One").alias("is_10b5_1"),
        F.coalesce(F.size("f.derivativeTable.derivativeTransaction"), F.lit(0)).alias("skipped_derivatives"),
    )
    of_filing = ["document", "issuer_cik", "issuer_name", "ticker", "is_10b5_1", "skipped_derivatives"]
    # conditions that always hold: of a column that is exploded as it is, Spark tests the size below the parsing, and parses
    # again for that; null would be counted as -1
    owners = one.select(*of_filing, "transactions", F.posexplode(F.when(F.col("skipped_derivatives") >= -1, F.col("f.reportingOwner"))).alias("owner_pos", "o")).select(
        *of_filing,
        "transactions",
        "owner_pos",
        cik("o.reportingOwnerId.rptOwnerCik").alias("owner_cik"),
        *(flag(f"o.reportingOwnerRelationship.{c}").alias(n) for c, n in (("isDirector", "is_director"), ("isOfficer", "is_officer"), ("isTenPercentOwner", "is_ten_percent"))),
        (F.col("owner_pos") * F.size("transactions")).alias("before"),
    )
    own = ["owner_cik", "is_director", "is_officer", "is_ten_percent"]
    rows = owners.select(*of_filing, *own, "before", F.posexplode(F.when(F.col("owner_pos") >= 0, F.col("transactions"))).alias("k", "t"))
    return rows.select(*of_filing, *own, "t.*", (F.col("before") + F.col("k")).alias("transaction_index"))


COVER_13F = "headerData struct<filerInfo:struct<filer:struct<credentials:struct<cik:string>>,periodOfReport:string>>, formData struct<coverPage:struct<filingManager:struct<name:string>>>"
TABLE_13F = "infoTable array<struct<nameOfIssuer:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string>>>"


def holdings_13f(filings: DataFrame) -> DataFrame:
    """(document, cover, payload, and path_cik if it is known) to holdings summed by CUSIP.

    A filing without a period is rejected whole; a row whose numbers are none, or have separators, is left out. A filer
    without a CIK has that of the filing's path; unknown names are UNKNOWN.
    """
    path_cik = cik("path_cik") if "path_cik" in filings.columns else F.lit(None).cast("string")
    plain = lambda c, kind: F.trim(F.col(c)).try_cast(kind)
    # the cover's fields are made before the table's rows: what stands beside an explode is made again for each row
    covers = filings.withColumns({"_c": F.from_xml("cover", COVER_13F, PERMISSIVE), "_path_cik": path_cik}).withColumns(
        {
            "filer_cik": F.coalesce(cik("_c.headerData.filerInfo.filer.credentials.cik"), "_path_cik"),
            "filer_name": F.coalesce(text_or_null("_c.formData.coverPage.filingManager.name"), F.lit("UNKNOWN")),
            "period_of_report": day("_c.headerData.filerInfo.periodOfReport", "MM-dd-yyyy"),
        }
    )
    # the test is within the explode: a filter would be pushed below it, with the parsing that it needs
    table = F.when(F.col("period_of_report").isNotNull(), body(filings, "xml", TABLE_13F)["infoTable"])
    rows = covers.select("document", "filer_cik", "filer_name", "period_of_report", F.posexplode(table).alias("pos", "t")).select(
        "document",
        "filer_cik",
        "filer_name",
        "period_of_report",
        "pos",
        text_or_null("t.cusip").alias("cusip"),
        F.coalesce(text_or_null("t.nameOfIssuer"), F.lit("UNKNOWN")).alias("issuer"),
        plain("t.shrsOrPrnAmt.sshPrnamt", "decimal(20,4)").alias("shares"),
        plain("t.value", "decimal(20,2)").alias("value"),
    )
    whole = rows.filter(F.col("cusip").isNotNull() & F.col("shares").isNotNull() & F.col("value").isNotNull())
    return whole.groupBy("document", "filer_cik", "filer_name", "period_of_report", "cusip").agg(
        F.min_by("issuer", "pos").alias("issuer_name"), F.sum("shares").cast("decimal(28,4)").alias("shares"), F.sum("value").cast("decimal(28,2)").alias("market_value_usd")
    )


SCHEDULE_13D = (
    "formData struct<coverPageHeader:struct<dateOfEvent:string,issuerInfo:struct<issuerCIK:string,issuerName:string>>,items1To7:struct<item4:struct<transactionPurpose:string>>,"
    "reportingPersons:struct<reportingPersonInfo:array<struct<reportingPersonCIK:string,reportingPersonNoCIK:string,reportingPersonName:string,typeOfReportingPerson:string,aggregateAmountOwned:string,percentOfClass:string>>>>"
)
SCHEDULE_13G = (
    "headerData struct<filerInfo:struct<filer:struct<filerCredentials:struct<cik:string>>>>, formData struct<coverPageHeader:struct<eventDateRequiresFilingThisStatement:string,issuerInfo:struct<issuerCik:string,issuerCIK:string,issuerName:string>>,"
    "coverPageHeaderReportingPersonDetails:array<struct<reportingPersonName:string,typeOfReportingPerson:string,reportingPersonBeneficiallyOwnedAggregateNumberOfShares:string,classPercent:string>>>"
)


def schedule_13d(payloads: DataFrame) -> DataFrame:
    """A row for each reporting person of a 13D, with the stated purpose; own CIK unless the no-CIK flag is Y."""
    rows = payloads.select("document", body(payloads, "xml", SCHEDULE_13D).alias("d")).select("document", "d", F.explode("d.formData.reportingPersons.reportingPersonInfo").alias("p"))
    no_cik = F.upper(F.coalesce(F.trim("p.reportingPersonNoCIK"), F.lit("N"))) == "Y"
    return rows.select(
        "document",
        F.lit("SCHEDULE 13D").alias("form_type"),
        cik("d.formData.coverPageHeader.issuerInfo.issuerCIK").alias("issuer_cik"),
        day("d.formData.coverPageHeader.dateOfEvent", "MM/dd/yyyy").alias("event_date"),
        F.col("d.formData.items1To7.item4.transactionPurpose").alias("purpose"),
        F.when(~no_cik, cik("p.reportingPersonCIK")).alias("person_cik"),
        F.coalesce(text_or_null("p.reportingPersonName"), F.lit("UNKNOWN")).alias("person_name"),
        text_or_null("p.typeOfReportingPerson").alias("type_code"),
        number("p.aggregateAmountOwned").alias("shares_owned"),
        number("p.percentOfClass", "decimal(6,3)").alias("percent_of_class"),
    )


def schedule_13g(payloads: DataFrame) -> DataFrame:
    """A row for each reporting person of a 13G: no purpose, and the filer's one CIK for all of them."""
    options = PERMISSIVE | {"caseSensitive": "true"}
    rows = payloads.select("document", F.from_xml("payload", SCHEDULE_13G.replace("issuerCIK:string,", ""), options).alias("d"), F.from_xml("payload", "formData struct<coverPageHeader:struct<issuerInfo:struct<issuerCIK:string>>>", options).alias("e"))
    rows = rows.select("document", "d", "e", F.explode("d.formData.coverPageHeaderReportingPersonDetails").alias("p"))
    return rows.select(
        "document",
        F.lit("SCHEDULE 13G").alias("form_type"),
        F.coalesce(cik("d.formData.coverPageHeader.issuerInfo.issuerCik"), cik("e.formData.coverPageHeader.issuerInfo.issuerCIK")).alias("issuer_cik"),
        day("d.formData.coverPageHeader.eventDateRequiresFilingThisStatement", "MM/dd/yyyy").alias("event_date"),
        F.lit(None).cast("string").alias("purpose"),
        cik("d.headerData.filerInfo.filer.filerCredentials.cik").alias("person_cik"),
        F.coalesce(text_or_null("p.reportingPersonName"), F.lit("UNKNOWN")).alias("person_name"),
        text_or_null("p.typeOfReportingPerson").alias("type_code"),
        number("p.reportingPersonBeneficiallyOwnedAggregateNumberOfShares").alias("shares_owned"),
        number("p.classPercent", "decimal(6,3)").alias("percent_of_class"),
    )


def acceptance_time(header: Column | str) -> Column:
    """When a submission was accepted, in UTC, from the first 2 KB of its text; null where it is not said."""
    digits = F.regexp_extract(F.substring(F.col(header) if isinstance(header, str) else header, 1, 2048), r"<ACCEPTANCE-DATETIME>\s*(\d{14})", 1)
    return eastern_to_utc(F.nullif(digits, F.lit("")))


# --- company facts -------------------------------------------------------------------------------------------------

#: FIXED VALUES: reported concepts and the event types that they are facts of.
CAPITAL_CONCEPTS = {
    "PaymentsForRepurchaseOfCommonStock": "SHARE_BUYBACK", "PaymentsOfDividends": "DIVIDEND_PAYMENT",
    "ProceedsFromIssuanceOfLongTermDebt": "DEBT_ISSUANCE", "RepaymentsOfLongTermDebt": "DEBT_REPAYMENT",
}
#: FIXED VALUES: concept, metric, unit.
FUNDAMENTAL_CONCEPTS = [
    ("Revenues", "revenue", "USD"), ("RevenueFromContractWithCustomerExcludingAssessedTax", "revenue", "USD"), ("NetIncomeLoss", "net_income", "USD"),
    ("EarningsPerShareDiluted", "eps_diluted", "USD/shares"), ("GrossProfit", "gross_profit", "USD"), ("OperatingIncomeLoss", "operating_income", "USD"),
]
FACTS = "entityName string, facts struct<`us-gaap`:map<string,struct<units:map<string,array<struct<val:string,start:string,end:string,filed:string,form:string,accn:string>>>>>>"


def company_facts(payloads: DataFrame) -> DataFrame:
    """All dated facts of company-facts JSON: document, concept, unit, value, period, form, filing."""
    concepts = payloads.select("document", F.explode(body(payloads, "json", FACTS)["facts"]["us-gaap"]).alias("concept", "c"))
    units = concepts.select("document", "concept", F.explode("c.units").alias("unit", "facts"))
    rows = units.select("document", "concept", "unit", F.explode("facts").alias("f"))
    typed = rows.select(
        "document", "concept", "unit", number("f.val", "decimal(24,4)").alias("value"), day("f.start").alias("period_start"), day("f.end").alias("period_end"),
        day("f.filed").alias("filed"), F.col("f.form").alias("form"), F.col("f.accn").alias("accession"),
    )
    return typed.filter(F.col("value").isNotNull() & F.col("period_start").isNotNull() & F.col("period_end").isNotNull() & F.col("filed").isNotNull())


def capital_allocation(facts: DataFrame) -> DataFrame:
    """Annual reports' full-year facts of four concepts, as event types."""
    kind = F.create_map(*(F.lit(x) for kv in CAPITAL_CONCEPTS.items() for x in kv))
    days = F.datediff("period_end", "period_start")
    return facts.filter((F.col("form") == "10-K") & (F.col("unit") == "USD") & days.between(330, 380)).withColumn("event_type", F.try_element_at(kind, F.col("concept"))).filter("event_type IS NOT NULL")


def fundamental_facts(facts: DataFrame) -> DataFrame:
    """Facts of five metrics in their units, from annual and quarterly reports."""
    metrics = facts.sparkSession.createDataFrame(FUNDAMENTAL_CONCEPTS, "concept string, metric string, unit string")
    return facts.filter(F.col("form").isin("10-K", "10-Q")).join(F.broadcast(metrics), ["concept", "unit"])


# --- funds and 8-K lists -------------------------------------------------------------------------------------------

SUBMISSIONS = (
    "name string, tickers array<string>, filings struct<recent:struct<form:array<string>,items:array<string>,accessionNumber:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,primaryDocument:array<string>>>"
)
GUIDANCE_ITEMS, MERGER_ITEMS = ["2.02", "7.01"], ["2.01"]


def recent_filings(payloads: DataFrame) -> DataFrame:
    """The parallel arrays of a submissions document as rows, in source order."""
    s = payloads.select("document", body(payloads, "json", SUBMISSIONS).alias("s"))
    recent = "s.filings.recent"
    zipped = F.arrays_zip(*(f"{recent}.{c}" for c in ("form", "items", "accessionNumber", "filingDate", "acceptanceDateTime", "primaryDocument")))
    rows = s.select("document", F.col("s.name").alias("company_name"), F.get("s.tickers", 0).alias("ticker"), F.posexplode(zipped).alias("pos", "f"))
    return rows.select(
        "document", "company_name", "ticker", "pos", F.col("f.form").alias("form"), F.coalesce("f.items", F.lit("")).alias("item_codes"), F.col("f.accessionNumber").alias("accession"),
        day("f.filingDate").alias("filing_date"), F.col("f.acceptanceDateTime").cast("timestamp").alias("filed_at"), F.col("f.primaryDocument").alias("primary_document"),
    )


def first_n(rows: DataFrame, limit: int, by: str = "document", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The first ``limit`` rows of each document, or of all pages of a registrant, in source order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def nport_leads(payloads: DataFrame, limit: int = 20) -> DataFrame:
    return first_n(recent_filings(payloads).filter(F.col("form") == "NPORT-P"), limit)


def disclosures_8k(filings: DataFrame, items: list[str], limit: int | None = None) -> DataFrame:
    """8-K filings (no amendments) whose item codes meet ``items``; the codes stay as they were written."""
    codes = F.transform(F.split("item_codes", ","), lambda c: F.trim(c))
    rows = filings.filter((F.col("form") == "8-K") & F.arrays_overlap(codes, F.array(*map(F.lit, items))))
    return rows if limit is None else first_n(rows, limit)


def document_url(company_cik: Column, accession: Column, primary: Column) -> Column:
    """Where the filing's document is on the registrar's site."""
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(company_cik, F.lit("0")), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), primary)


NPORT = "formData struct<genInfo:struct<seriesName:string,repPdDate:string>,fundInfo:struct<totAssets:string,totLiabs:string,netAssets:string>>"


def nport_snapshots(payloads: DataFrame) -> DataFrame:
    """A fund's period and assets; without period, total or net assets there is no row."""
    rows = payloads.select("document", body(payloads, "xml", NPORT).alias("n")).select(
        "document",
        day("n.formData.genInfo.repPdDate").alias("period_end"),
        F.nullif(text_or_null("n.formData.genInfo.seriesName"), F.lit("N/A")).alias("series_name"),
        number("n.formData.fundInfo.totAssets", "decimal(28,2)").alias("total_assets_usd"),
        number("n.formData.fundInfo.totLiabs", "decimal(28,2)").alias("total_liabilities_usd"),
        number("n.formData.fundInfo.netAssets", "decimal(28,2)").alias("net_assets_usd"),
    )
    return rows.filter(F.col("period_end").isNotNull() & F.col("total_assets_usd").isNotNull() & F.col("net_assets_usd").isNotNull())


# --- short interest ------------------------------------------------------------------------------------------------


def settlement_candidates(days: DataFrame, months: int = 4) -> DataFrame:
    """For each as_of of days the dates on which a cycle may have settled by then: the 12th to 17th and the last five
    days of its month and of those before it, ``months`` in all."""
    back = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.add_months(F.trunc("as_of", "month"), -i))
    month = days.select("as_of", F.explode(back).alias("m"))
    some = F.concat(F.sequence(F.date_add("m", 11), F.date_add("m", 16)), F.sequence(F.date_sub(F.last_day("m"), 4), F.last_day("m")))
    return month.select("as_of", F.explode(F.array_distinct(some)).alias("settlement_date")).filter(F.col("settlement_date") <= F.col("as_of"))


def candidate_settlement_dates(spark, as_of, months: int = 4) -> DataFrame:
    """settlement_candidates() of one day, newest first."""
    day_of = spark.range(1).select(F.lit(as_of).cast("date").alias("as_of"))
    return settlement_candidates(day_of, months).select("settlement_date").orderBy(F.col("settlement_date").desc())


def confirmed_cycles(candidates: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """The newest n candidates on which any row settled."""
    return candidates.join(rows.select("settlement_date").distinct(), "settlement_date", "left_semi").orderBy(F.col("settlement_date").desc()).limit(n)


SHORT_INTEREST = (
    "array<struct<symbolCode:string,issueName:string,settlementDate:string,currentShortPositionQuantity:string,previousShortPositionQuantity:string,changePercent:string,averageDailyVolumeQuantity:string,daysToCoverQuantity:string>>"
)


def short_interest_records(payloads: DataFrame) -> DataFrame:
    """(document, requested, payload) to typed snapshots; no current position, no row; bad numbers are null."""
    rows = payloads.select("document", "requested", F.explode(body(payloads, "json", SHORT_INTEREST)).alias("r"))
    typed = rows.select(
        "document", F.coalesce(text_or_null("r.symbolCode"), F.upper("requested")).alias("ticker"), F.col("r.issueName").alias("issue_name"), day("r.settlementDate").alias("settlement_date"),
        number("r.currentShortPositionQuantity", "decimal(20,2)").alias("current_short_position"), number("r.previousShortPositionQuantity", "decimal(20,2)").alias("previous_short_position"),
        number("r.changePercent", "decimal(10,2)").alias("change_percent"), number("r.averageDailyVolumeQuantity", "decimal(20,2)").alias("average_daily_volume"), number("r.daysToCoverQuantity", "decimal(10,2)").alias("days_to_cover"),
    )
    return typed.filter("current_short_position IS NOT NULL")


# --- registers, wallets, indexes, tone -----------------------------------------------------------------------------

#: FIXED VALUES: spellings of the home registers' countries, trimmed and in lower case.
HOME_COUNTRIES = ["england", "england & wales", "england and wales", "great britain", "northern ireland", "scotland", "uk", "united kingdom", "wales"]


PROFILE = "company_name string, company_number string, company_status string, jurisdiction string, date_of_creation string"
CONTROL = (
    "items array<struct<name:string,kind:string,notified_on:string,ceased_on:string,natures_of_control:array<string>,links:struct<self:string>,identification:struct<registration_number:string,country_registered:string>>>"
)


def company_profiles(payloads: DataFrame) -> DataFrame:
    p = payloads.select("document", body(payloads, "json", PROFILE).alias("p"))
    return p.select("document", "p.company_number", "p.company_name", "p.company_status", "p.jurisdiction", day("p.date_of_creation").alias("created_on")).filter("company_number IS NOT NULL")


def control_register(payloads: DataFrame) -> DataFrame:
    """Register pages to one row an entry; the registration number stays only for a home country."""
    rows = payloads.select("document", F.explode(body(payloads, "json", CONTROL)["items"]).alias("i"))
    at_home = F.lower(F.trim("i.identification.country_registered")).isin(HOME_COUNTRIES)
    return rows.select(
        "document", F.col("i.name").alias("psc_name"), F.col("i.kind").alias("psc_kind"), day("i.notified_on").alias("notified_on"), day("i.ceased_on").alias("ceased_on"),
        F.col("i.natures_of_control").alias("natures_of_control"), F.col("i.links.self").alias("psc_link"), F.col("i.identification.country_registered").alias("country_registered"),
        F.when(at_home, F.col("i.identification.registration_number")).alias("registration_number"),
    )


WALLET = "address string, txs array<struct<hash:string,time:long,block_height:long,inputs:array<struct<prev_out:struct<addr:string,value:long>>>,out:array<struct<addr:string,value:long>>>>"


def wallet_legs(payloads: DataFrame) -> DataFrame:
    """Wallet JSON to the legs of each transaction that touch the wallet's own address."""
    w = payloads.select(body(payloads, "json", WALLET).alias("w")).select("w.address", F.explode("w.txs").alias("t"))
    legs = F.concat(
        F.transform("t.inputs", lambda i: F.struct(F.lit("in").alias("leg"), i["prev_out"]["addr"].alias("addr"), i["prev_out"]["value"].alias("value"))),
        F.transform("t.out", lambda o: F.struct(F.lit("out").alias("leg"), o["addr"].alias("addr"), o["value"].alias("value"))),
    )
    rows = w.select("address", F.col("t.hash").alias("tx_hash"), F.timestamp_seconds("t.time").alias("tx_time"), F.col("t.block_height").alias("block_height"), F.explode(legs).alias("l"))
    return rows.filter(F.col("l.addr") == F.col("address")).select("address", "tx_hash", "tx_time", "block_height", "l.leg", F.col("l.value").alias("satoshis"))


def net_effects(legs: DataFrame) -> DataFrame:
    """What each transaction changed for an address: outputs to it less inputs from it, in whole coins."""
    signed = F.when(F.col("leg") == "in", -F.col("satoshis")).otherwise(F.col("satoshis"))
    return legs.groupBy("address", "tx_hash").agg((F.sum(signed).cast("decimal(28,0)") / F.lit(100_000_000)).cast("decimal(30,8)").alias("net_amount"))


LEVEL = f"trade_date string, open decimal(14,4), high decimal(14,4), low decimal(14,4), close decimal(14,4), {CORRUPT} string"


def index_lines(lines: DataFrame) -> DataFrame:
    """(document, record_no, payload) of index CSVs to the lines that hold levels, typed, and is_bad where a value is none.

    A file's first line that is not blank must be the header, in any case; else the file has none. Lines of another
    width than five are left out.
    """
    said = lines.withColumn("payload", F.trim(F.regexp_replace("payload", r"[\r\t]", " "))).filter("payload != ''")
    head = said.groupBy("document").agg(F.min(F.struct("record_no", "payload")).alias("head"))
    files = head.filter(F.upper("head.payload") == "DATE,OPEN,HIGH,LOW,CLOSE").select("document", F.col("head.record_no").alias("head_no"))
    rows = said.join(files, "document").filter((F.col("record_no") > F.col("head_no")) & (F.size(F.split("payload", ",")) == 5))
    parsed = F.from_csv("payload", LEVEL, OPTIONS | {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    rows = rows.select("document", "record_no", "payload", parsed.alias("parsed"))
    blank = F.exists(F.array(*(F.col(f"parsed.{c}").isNull() for c in ("open", "high", "low", "close"))), lambda x: x)
    date = day("parsed.trade_date", "M/d/yyyy")
    bad = F.col(f"parsed.{CORRUPT}").isNotNull() | blank | date.isNull()
    return rows.select("document", "record_no", "payload", bad.alias("is_bad"), date.alias("trade_date"), *(F.col(f"parsed.{c}").alias(c) for c in ("open", "high", "low", "close")))


def index_rejects(lines: DataFrame) -> DataFrame:
    """(document, reason, payload): files with a value that is none, by the first line that has one. The whole file is out."""
    bad = index_lines(lines).filter("is_bad").groupBy("document").agg(F.min(F.struct("record_no", "payload")).alias("first"))
    return bad.select("document", F.lit("broken csv").alias("reason"), F.col("first.payload").alias("payload"))


def index_levels(lines: DataFrame, name: str = r"([^/_.]+)[^/]*$") -> DataFrame:
    """Levels of index CSVs without a bad line; the index's code is in the file's name."""
    rows = index_lines(lines)
    good = rows.join(rows.filter("is_bad").select("document").distinct(), "document", "left_anti")
    return good.select("document", F.upper(F.regexp_extract("document", name, 1)).alias("index_code"), "trade_date", "open", "high", "low", "close")


TONE = "tonechart array<struct<bin:int,count:long>>"


def tone_bins(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("document", F.explode(body(payloads, "json", TONE)["tonechart"]).alias("b"))
    return rows.select(F.col("document").alias("company_id"), "b.bin", F.col("b.count").alias("n"))


def tone(bins: DataFrame) -> DataFrame:
    """Articles, mean tone to three places and the histogram of each company; none where nothing was counted."""
    total = F.sum("n")
    return (
        bins.groupBy("company_id")
        .agg(
            total.cast("bigint").alias("article_count"),
            to_thousandths(F.sum(F.col("bin") * F.col("n")).cast("double") / F.nullif(total.cast("double"), F.lit(0.0))).alias("mean_tone"),
            F.array_sort(F.collect_list(F.struct("bin", F.col("n").alias("count")))).alias("histogram"),
        )
        .filter("article_count > 0")
    )
