"""Position changes kept by batches of filings: a batch makes anew what it changes, and reads what that rests on.

A filing is an institution's whole portfolio at a period. The one filed last of an institution's period counts, so an
amendment replaces what came before it, in whichever order the two arrive. A filing that counts changes two portfolios'
statuses: its own, and that of the institution's next period, which is compared with it. Only those are made again, from
the batch's own holdings and those of the period before and after, which are found by folder (part of the institution's
hash, and period). What is made is a version of that institution's period, named by its batch; readers take the newest.

A batch writes holdings, filings, versions and changes, each into a folder of its own, and then notes itself in the
ledger. One that is stopped before its note is run again and replaces what it wrote; after it, it is skipped.

Defined cases: a filing comes whole in one batch, and rows of one company in it are summed; an accession that is known
already adds nothing; of filings of the same day the greater accession counts; a filing whose only row has no company
withdraws the period, and the next one is compared with the one before it; rows without institution, period or accession
are no filing and are left out; a filing without a date counts as older than any other. Each batch leaves files of its
own, and they are not merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import derive
from ..sources.ledger import Ledger

FILING = "institution_id long, period_of_report date, accession string, filed date"
HOLDING = f"{FILING}, company_id long, shares decimal(28,4), market_value_usd decimal(28,2)"
VERSION = "institution_id long, period_of_report date, accession string, prior_period date, prior_accession string"
CHANGE = "institution_id long, period_of_report date, company_id long, shares decimal(28,4), market_value_usd decimal(28,2), shares_change decimal(28,4), position_status string, publication_time date"
#: Each table's columns, and the folders besides the batch's.
TABLES = {"holdings": (HOLDING, "part int, day int"), "filings": (f"{FILING}, alive boolean", "part int"), "versions": (VERSION, "part int"), "changes": (CHANGE, "part int")}
KEY = ["institution_id", "period_of_report"]


def days(period: str) -> Column:
    return F.unix_date(period).cast("int")


class Portfolios:
    """Four tables and a ledger under ``folder``, laid out by ``parts`` hashes of the institution."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64, spread: int = 8):
        self.spark, self.folder, self.parts, self.spread, self.ledger = spark, folder, parts, spread, Ledger(spark, f"{folder}/ledger")
        if self.ledger.latest()[0] < 0:
            for table, (schema, place) in TABLES.items():
                first = "/".join(f"{c.split()[0]}=0" for c in place.split(", "))
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{table}/batch=-1/{first}")
            self.ledger.commit({"last": -1})

    @property
    def last(self) -> int:
        """The last batch that is noted."""
        return self.ledger.latest()[1]["last"]

    def rows(self, table: str, first: int = -1, last: int | None = None) -> DataFrame:
        """A table's rows of some batches, of all noted ones if none are named."""
        schema, place = TABLES[table]
        rows = self.spark.read.schema(f"{schema}, batch long, {place}").parquet(f"{self.folder}/{table}")
        return rows.filter(F.col("batch").between(first, self.last if last is None else last))

    def _write(self, rows: DataFrame, table: str, batch_id: int, dealt: bool = False) -> None:
        place = [c.split()[0] for c in TABLES[table][1].split(", ")]
        (rows if dealt else rows.repartition(*place)).write.mode("overwrite").partitionBy(*place).parquet(f"{self.folder}/{table}/batch={batch_id}")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col("institution_id").cast("long")), F.lit(self.parts)).cast("int").alias("part")

    def _slot(self) -> Column:
        """Parts are few, so that files are; ``spread`` hashes of the company make more tasks of a part."""
        return F.pmod(F.xxhash64(F.col("company_id").cast("long")), F.lit(self.spread)).alias("slot")

    def add(self, filings: DataFrame, batch_id: int) -> bool:
        """Take a batch of filings in (institution_id, period_of_report, accession, filed, company_id, shares, market_value_usd); False if it was noted before."""
        if batch_id <= self.last:
            return False
        by = [*KEY, "accession"]
        keyed = filings.dropna(subset=by).withColumns({"institution_id": F.col("institution_id").cast("long"), "company_id": F.col("company_id").cast("long")})
        # dealt once, so that a company's rows are summed where they are written
        dealt = keyed.select("*", self._part(), days("period_of_report").alias("day")).repartition("part", "day")
        own = dealt.groupBy("part", "day", *by, "company_id").agg(
            F.min("filed").alias("filed"), F.sum("shares").cast("decimal(28,4)").alias("shares"), F.sum("market_value_usd").cast("decimal(28,2)").alias("market_value_usd")
        )
        self._write(own.select(*(c.split()[0] for c in HOLDING.split(", ")), "part", "day"), "holdings", batch_id, dealt=True)
        mine = self.rows("holdings", batch_id, batch_id)
        parts = [r.part for r in mine.select("part").distinct().collect()]  # ``parts`` at most
        here = F.col("part").isin(parts)
        known = self.rows("filings").filter(here)
        heard = mine.groupBy(*by, "part").agg(F.min("filed").alias("filed"), (F.count("company_id") > 0).alias("alive")).join(known, by, "left_anti")
        self._write(heard.select(*by, "filed", "alive", "part"), "filings", batch_id)
        self._write(self._changed(self.rows("filings", last=batch_id).filter(here), batch_id), "versions", batch_id)
        self._write(self._made(batch_id, here), "changes", batch_id, dealt=True)
        self.ledger.commit({"last": batch_id})
        return True

    def _changed(self, filings: DataFrame, batch_id: int) -> DataFrame:
        """The institutions' periods whose changes a batch makes anew, with the filings that they rest on."""
        mine = filings.filter(F.col("batch") == batch_id).select("institution_id").distinct()
        newest = F.max_by(F.struct("accession", "alive", (F.col("batch") == batch_id).alias("changed")), F.struct("filed", "accession"))
        counted = filings.join(mine, "institution_id", "left_semi").groupBy(*KEY, "part").agg(newest.alias("f")).select(*KEY, "part", "f.*")
        before = W.partitionBy("institution_id").orderBy("period_of_report").rowsBetween(W.unboundedPreceding, -1)
        placed = counted.withColumns(
            {
                "prior": F.max(F.when(F.col("alive"), F.struct("period_of_report", "accession"))).over(before),
                "touched": F.max(F.when(F.col("changed"), F.col("period_of_report"))).over(before),
            }
        )
        prior = F.col("prior.period_of_report")
        follows = F.col("alive") & F.col("touched").isNotNull() & (prior.isNull() | (F.col("touched") >= prior))
        # a period that is withdrawn has a version, and no changes in it
        return placed.filter(F.col("changed") | follows).select(
            *KEY, F.when(F.col("alive"), F.col("accession")).alias("accession"), prior.alias("prior_period"), F.col("prior.accession").alias("prior_accession"), "part"
        )

    def _sources(self, batch_id: int) -> DataFrame:
        """For each version of a batch the filings to read: its own, and the one before it."""
        versions = self.rows("versions", batch_id, batch_id).filter("accession IS NOT NULL")
        pick = lambda at, accession, now: F.struct(F.col(at).alias("at"), F.col(accession).alias("accession"), F.lit(now).alias("now"))
        both = F.array(pick("period_of_report", "accession", True), pick("prior_period", "prior_accession", False))
        return versions.select(*KEY, F.explode(both).alias("s")).select(*KEY, "s.*").filter("at IS NOT NULL")

    def held(self, batch_id: int, here: Column) -> DataFrame:
        """The holdings that a batch's versions rest on: folders of its parts and of their periods only."""
        sources = self._sources(batch_id)
        periods = [r.day for r in sources.select(days("at").alias("day")).distinct().collect()]  # quarters' ends
        stored = self.rows("holdings", last=batch_id).filter(here & F.col("day").isin(periods) & F.col("company_id").isNotNull())
        # an accession that came again in a later batch is in the holdings twice; its filing is the first
        first = self.rows("filings", last=batch_id).filter(here).select("institution_id", F.col("period_of_report").alias("at"), "accession", "batch")
        # a row a filing: small beside the holdings, which would else be shuffled and sorted for it
        sources = F.broadcast(sources.join(first, ["institution_id", "at", "accession"]))
        return stored.select("institution_id", F.col("period_of_report").alias("at"), "accession", "batch", "company_id", "shares", "market_value_usd").join(sources, ["institution_id", "at", "accession", "batch"])

    def _made(self, batch_id: int, here: Column) -> DataFrame:
        now, then = F.col("now"), ~F.col("now")
        dealt = self.held(batch_id, here).select("*", self._part(), self._slot()).repartition("part", "slot")
        at = dealt.groupBy("part", "slot", *KEY, "company_id").agg(
            F.max("now").alias("held"), F.max(F.when(now, F.col("shares"))).alias("shares"), F.max(F.when(now, F.col("market_value_usd"))).alias("market_value_usd"), F.max(F.when(then, F.col("shares"))).alias("prior")
        )
        held, zero = F.col("held"), F.lit(0)
        change = F.when(held, F.col("shares") - F.col("prior")).otherwise(-F.col("prior")).cast("decimal(28,4)")
        return at.select(
            *KEY, "company_id", F.when(held, F.col("shares")).otherwise(zero).cast("decimal(28,4)").alias("shares"), F.when(held, F.col("market_value_usd")).otherwise(zero).cast("decimal(28,2)").alias("market_value_usd"),
            change.alias("shares_change"), F.when(held, derive.status_of(F.col("prior"), change)).otherwise("EXITED").alias("position_status"), F.date_add("period_of_report", 45).alias("publication_time"), "part",
        )

    def read(self, upto: int | None = None) -> DataFrame:
        """The changes as of the last noted batch, or as they were after an earlier one: each period's newest version."""
        last = self.last if upto is None else min(upto, self.last)
        newest = self.rows("versions", last=last).groupBy(*KEY).agg(F.max("batch").alias("batch"))
        return self.rows("changes", last=last).join(F.broadcast(newest), [*KEY, "batch"], "left_semi").drop("batch", "part")


def follow(filings: DataFrame, out: Portfolios, checkpoint: str) -> StreamingQuery:
    """Keep position changes by a stream of filings."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out.add(batch, batch_id)

    return filings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
