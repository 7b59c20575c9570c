"""Queries over the laid-out event log: transactions are appended to it in batches, late ones last, and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import scoring
from ..sources.eventstore import EventLog
from .core import AS_OF, EVENT, EVENT_SQL, INS, D, query, ranked, ranking, view
from .store import stored, workspace
from .views import VIEWS

def transaction_log(spark, d) -> EventLog:
    """Transactions in two batches, the second of late publications of a first year, whose months are compacted."""
    rows = stored(view(spark, d, "tb_form4"))
    log = EventLog(spark, workspace(spark, "log"), rows.schema, parts=2)  # a real log has more, so that a cell has some 100 MB
    is_late = F.coalesce((F.col("publication_time") < "1993-01-01") & (F.pmod(F.xxhash64("event_id"), F.lit(8)) == 0), F.lit(False))
    log.append(rows.filter(~is_late), 0)
    log.append(rows.filter(is_late), 1)
    log.compact(1)
    return log


@query("t01_laid_out_public", f"SELECT {EVENT_SQL} FROM tb_form4 WHERE publication_time <= {D}")
def t01_laid_out(spark, d):
    return transaction_log(spark, d).public(AS_OF).select(EVENT)


@query("t02_laid_out_ingested", f"SELECT {EVENT_SQL} FROM tb_form4 WHERE coalesce(retrieved_at, created_at) <= {D}")
def t02_laid_out(spark, d):
    return transaction_log(spark, d).ingested(AS_OF).select(EVENT)


@query(
    "t04_laid_out_sector",
    f"SELECT f.company_id, sector, count(*) AS n, min(publication_time) AS first_public FROM tb_form4 f JOIN tb_companies c ON f.company_id = c.entity_id WHERE publication_time BETWEEN DATE '1999-10-01' AND {D} AND sector = 'ASIA' GROUP BY 1, 2",
)
def t04_laid_out(spark, d):
    """A quarter of one sector: months by the clock, hashes of companies by dynamic pruning."""
    log, companies = transaction_log(spark, d), view(spark, d, "tb_companies").filter("sector = 'ASIA'")
    quarter = log.of(log.public(AS_OF, since=AS_OF.replace(year=1999, month=10)), companies.select(F.col("entity_id").alias("company_id"), "sector"))
    return quarter.groupBy("company_id", "sector").agg(F.count("*").alias("n"), F.min("publication_time").alias("first_public"))


@query("r04_laid_out_radar", f"WITH {INS} {ranking('insider')}")
def r04_laid_out(spark, d):
    """The insider ranking from the log: of transactions only the months that its windows can reach."""
    log = transaction_log(spark, d)
    reached = log.happened(AS_OF - timedelta(days=90 + 730), AS_OF).drop("log_part")
    reached = reached.withColumn("source_url", F.concat(F.lit("https://www.sec.gov/Archives/"), F.col("accession").cast("string")))
    roles = spark.sql(VIEWS["tb_roles"].replace("tb_form4", "{form4}"), form4=log.rows())
    return ranked(scoring.insider_scores(reached, roles, view(spark, d, "tb_companies"), AS_OF))
