"""The event log as files that are laid out by its two clocks, publication and ingestion, and by company.

A cell is a month of publication, a month of ingestion and a hash of the company; its rows are sorted by company and
time. A read as of either clock prunes months, a read of some companies prunes hashes (by dynamic pruning, if the
companies come from a filtered dimension), and late publications land in old months without anything being rewritten.

Appends are numbered 0, 1, 2, ... by their writer. A batch is written, then noted in the ledger: readers see it whole or
not at all, a batch that is run again after a failure replaces what it wrote, and one that is noted is not written
again. ``compact`` merges the files of months that many batches wrote to, in the same two steps; ``vacuum`` removes
what compactions have replaced, once no reader is on it.

Defined cases: rows without a publication time are in no public read and in every ingested one that their own clock
allows, and the other way round; an empty batch is noted, and adds nothing; columns besides those named are kept as they
are, whatever their names, but the four of the layout.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.asof import retrieval_time
from .ledger import Ledger

PUBLIC, INGESTED, PART, RUN = LAYOUT = ["pub_month", "in_month", "log_part", "log_run"]
NO_MONTH = 0  # of rows without that clock


def month_of(clock: Column) -> Column:
    return F.coalesce(F.year(clock) * 100 + F.month(clock), F.lit(NO_MONTH)).cast("int")


def month(at: date) -> int:
    return at.year * 100 + at.month


class EventLog:
    """A log of rows with ``company_id``, ``event_time``, ``publication_time`` and retrieved_at, created_at, under ``folder``.

    ``parts`` is the number of hashes of companies. A month of one company may be any size: cells are cut by ranges of
    company and time when they are written, so a hot company is many files of many tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, parts: int = 16):
        taken = set(LAYOUT) & set(schema.names)
        if taken:
            raise ValueError(f"columns {sorted(taken)} are the layout's own")
        self.spark, self.data, self.parts = spark, f"{folder}/data", parts
        self.schema = StructType([*schema.fields, *(StructField(c, IntegerType()) for c in LAYOUT[:3]), StructField(RUN, LongType())])
        self.ledger = Ledger(spark, f"{folder}/ledger")
        if self.ledger.latest()[0] < 0:
            # there is always a folder to read
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.data}/{PUBLIC}={NO_MONTH}/{INGESTED}={NO_MONTH}/{PART}=0/{RUN}=-1")
            self.ledger.commit({"last": -1, "runs": {}, "least_delay": None})

    @property
    def state(self) -> dict:
        """last (the last batch), runs (by month of publication those that count), least_delay (days to publication)."""
        return self.ledger.latest()[1]

    def part_of(self, company: str | Column = "company_id") -> Column:
        return F.pmod(F.xxhash64(F.col(company) if isinstance(company, str) else company), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, run: int) -> DataFrame:
        """Write rows that have their cell's columns, in ranges of cells, companies and times; returns them as written."""
        order = [*LAYOUT[:3], "company_id", "publication_time", "event_time"]
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # all of them: small files of many cells are one task's work otherwise
        laid = rows.withColumn(RUN, F.lit(run).cast("long")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(self.data)
        return self._all().filter(F.col(RUN) == run)  # a new run's months are not noted yet

    def _all(self, months: list[int] | None = None) -> DataFrame:
        """Every file, or those of some months of publication; folders of other months are not even listed."""
        paths = [self.data] if months is None else [f"{self.data}/{PUBLIC}={m}" for m in sorted({NO_MONTH, *months})]
        return self.spark.read.schema(self.schema).option("basePath", self.data).parquet(*paths)

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Write the next batch and note it; False if it was noted before."""
        state = self.state
        if batch_id <= state["last"]:
            return False
        if batch_id != state["last"] + 1:
            raise ValueError(f"batch {batch_id} can't follow batch {state['last']}")
        celled = rows.withColumns({PUBLIC: month_of(F.col("publication_time")), INGESTED: month_of(retrieval_time()), PART: self.part_of()})
        written = self._write(celled, 2 * batch_id)
        # a row for each month of publication in the batch
        months = written.groupBy(PUBLIC).agg(F.min(F.datediff("publication_time", "event_time")).alias("delay")).collect()
        runs = state["runs"]
        for r in months:
            runs.setdefault(str(r[PUBLIC]), []).append(2 * batch_id)
        delays = [d for d in (state["least_delay"], *(r.delay for r in months)) if d is not None]
        self.ledger.commit({"last": batch_id, "runs": runs, "least_delay": min(delays, default=None)})
        return True

    def _rows(self, since: int | None = None, until: int | None = None) -> DataFrame:
        """What counts, of months of publication in a range if it is given; decided on columns of the layout alone.

        Months with the same runs are told together, so the condition is as long as there are kinds of them.
        """
        kinds: dict[tuple, list[int]] = {}
        for m, runs in self.state["runs"].items():
            if (since is None or int(m) >= since) and (until is None or NO_MONTH < int(m) <= until):
                kinds.setdefault(tuple(runs), []).append(int(m))
        counts = F.lit(False)
        for runs, months in kinds.items():
            counts = counts | (F.col(PUBLIC).isin(months) & F.col(RUN).isin(list(runs)))
        return self._all([m for months in kinds.values() for m in months]).filter(counts)

    def rows(self) -> DataFrame:
        """Everything that has been appended, with the company's hash as log_part."""
        return self._rows().drop(PUBLIC, INGESTED, RUN)

    def public(self, as_of: date, since: date | None = None) -> DataFrame:
        """Rows that were public by as_of (from since on, if given): only these months are read."""
        rows = self._rows(month(since) if since else None, month(as_of))
        rows = rows.filter(F.col("publication_time") <= F.lit(as_of))
        rows = rows if since is None else rows.filter(F.col("publication_time") >= F.lit(since))
        return rows.drop(PUBLIC, INGESTED, RUN)

    def happened(self, since: date, as_of: date) -> DataFrame:
        """Rows public by as_of that happened from since on; what is public earliest bounds the months from below."""
        delay = self.state["least_delay"]
        first = None if delay is None else month(since + timedelta(days=delay))
        # rows without a time to happen have no delay, and are not asked for
        rows = self._rows(first, month(as_of))
        return rows.filter((F.col("publication_time") <= F.lit(as_of)) & (F.col("event_time") >= F.lit(since))).drop(PUBLIC, INGESTED, RUN)

    def ingested(self, as_of: date) -> DataFrame:
        """Rows that had come in by as_of: only months of ingestion until then are read."""
        rows = self._rows().filter(F.col(INGESTED).between(NO_MONTH + 1, month(as_of)))
        return rows.filter(retrieval_time() <= F.lit(as_of)).drop(PUBLIC, INGESTED, RUN)

    def of(self, rows: DataFrame, companies: DataFrame) -> DataFrame:
        """rows of this log joined to companies; hashes that no company has are pruned when the companies are known."""
        return rows.join(companies.withColumn(PART, self.part_of()), ["company_id", PART]).drop(PART)

    def compact(self, more_than: int = 8) -> list[int]:
        """Merge the files of months that more than so many runs wrote to; returns the months."""
        state = self.state
        months = [int(m) for m, runs in state["runs"].items() if len(runs) > more_than]
        if months:
            run = 2 * state["last"] + 1
            self._write(self._rows().filter(F.col(PUBLIC).isin(months)), run)
            self.ledger.commit({**state, "runs": {**state["runs"], **{str(m): [run] for m in months}}})
        return months

    def vacuum(self) -> None:
        """Remove folders that don't count: replaced by compactions, or of a batch that was never noted."""
        found = self._all().filter(F.col(RUN) >= 0).select(*LAYOUT).distinct()
        gone = found.join(self._rows().select(*LAYOUT).distinct(), LAYOUT, "left_anti")
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        for r in gone.toLocalIterator():  # folders, not rows
            path = hadoop("/".join([self.data, *(f"{c}={r[c]}" for c in LAYOUT)]))
            path.getFileSystem(conf).delete(path, True)
