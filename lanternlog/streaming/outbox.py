"""Alerts and their outbox by stream: what a batch adds to both stands or falls together, and is there once.

A batch writes its alerts, then the outbox rows of what it wrote, each into a folder of its own, and then notes itself in
the ledger. Readers, and the batches after it, see only what is noted. A batch that is stopped before its note is run
again by the stream and replaces both folders; one that is stopped after it is skipped when it is run again.

Defined cases: a batch without hits is noted, and adds nothing; hits of one rule and company in one batch are one alert,
of the highest composite; a hit that an alert of that day has, whichever batch made it, adds nothing; rules without an
address give alerts and no outbox rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import alerts
from ..sources.ledger import Ledger

ALERTS = "name string, company_id long, alert_date date, composite double, summary string, evidence_ids array<string>"
OUTBOX = "name string, company_id long, alert_date date, webhook_url string, payload string"
PLACE = "day int, batch long"


class Outbox:
    """Two tables and a ledger under ``folder``; a day is a folder, so that a batch reads the alerts of its own day."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.ledger = spark, folder, Ledger(spark, f"{folder}/ledger")
        if self.ledger.latest()[0] < 0:
            for table, schema in (("alerts", ALERTS), ("outbox", OUTBOX)):
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{table}/day=0/batch=-1")
            self.ledger.commit({"last": -1})

    @property
    def last(self) -> int:
        """The last batch that is noted."""
        return self.ledger.latest()[1]["last"]

    def _read(self, table: str, schema: str, condition) -> DataFrame:
        return self.spark.read.schema(f"{schema}, {PLACE}").parquet(f"{self.folder}/{table}").filter(condition).drop("day", "batch")

    def alerts(self, day: date | None = None) -> DataFrame:
        """Alerts of noted batches, of one day if it is given."""
        noted = F.col("batch") <= self.last
        return self._read("alerts", ALERTS, noted if day is None else noted & (F.col("day") == day.toordinal()))

    def outbox(self, after: int = -1) -> DataFrame:
        """Outbox rows of noted batches after a given one: what a sender that has sent until then has to send."""
        return self._read("outbox", OUTBOX, F.col("batch").between(after + 1, self.last))

    def add(self, hits: DataFrame, rules: DataFrame, as_of: date, batch_id: int) -> bool:
        """Write what hits (name, company_id, composite, summary, evidence_ids) add to the day; False if it was noted before."""
        if batch_id <= self.last:
            return False
        best = W.partitionBy("name", "company_id").orderBy(F.col("composite").desc_nulls_last(), "summary")
        one = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
        fresh = alerts.new_alerts(one, self.alerts(as_of), as_of)
        place = f"day={as_of.toordinal()}/batch={batch_id}"
        fresh.select("name", F.col("company_id").cast("long").alias("company_id"), "alert_date", "composite", "summary", "evidence_ids").write.mode("overwrite").parquet(f"{self.folder}/alerts/{place}")
        written = self._read("alerts", ALERTS, (F.col("day") == as_of.toordinal()) & (F.col("batch") == batch_id))
        alerts.payloads(written, rules).write.mode("overwrite").parquet(f"{self.folder}/outbox/{place}")
        self.ledger.commit({"last": batch_id})
        return True


def alerted(scores: DataFrame, rules: DataFrame, evidence: DataFrame, out: Outbox, as_of: date, checkpoint: str) -> StreamingQuery:
    """A stream of scores (family, company_id, composite) held against threshold rules; evidence is read for hits only."""

    def write(batch: DataFrame, batch_id: int) -> None:
        out.add(alerts.with_evidence(alerts.threshold_hits(rules, batch), evidence), rules, as_of, batch_id)

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
