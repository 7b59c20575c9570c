"""Landed files as a source: records with their places in files, submissions of several documents, and intake of batches.

A file is read by as many tasks as its size asks for; a record's number in its file is its number in its block and what
the blocks before it have, so no file is gathered for it. Compressed files are read by one task each.

``intake`` parses a batch once and tells apart what is new, what is known, what is empty and what is rejected, with the
reason and the payload as it came: nothing that landed is lost, and one bad payload stops no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import eventlog

CORRUPT = "_corrupt"
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "ignoreNamespace": "true"}
READERS = {"xml": F.from_xml, "json": F.from_json}


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: document (its path), size, modified, payload. For files that fit in a row."""
    meta = F.col("_metadata")
    return spark.read.option("wholetext", "true").text(path).select(meta["file_path"].alias("document"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified"), F.col("value").alias("payload"))


def landed_records(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(document, record_no, payload): what a file's separators part, numbered from 0 in each file."""
    rows = spark.read.option("lineSep", separator).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("payload"), F.monotonically_increasing_id().alias("row"))
    held = rows.groupBy("document", "block").agg(F.min("row").alias("first"), F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(W.partitionBy("document").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = held.select("document", "block", (before - F.col("first")).alias("shift"))
    # a row for each block of a file: small beside the records, which would else be shuffled with their payloads
    return rows.join(F.broadcast(shift), ["document", "block"]).select("document", (F.col("row") + F.col("shift")).alias("record_no"), "payload")


def submission_documents(records: DataFrame) -> DataFrame:
    """records with header (up to the first document) and documents, an array of (type, body), of a submission's text."""
    parts = F.split("payload", "</DOCUMENT>")
    body = lambda p: F.trim(F.regexp_replace(F.substring_index(F.substring_index(p, "<TEXT>", -1), "</TEXT>", 1), r"^\s*<XML>\s*|\s*</XML>\s*$", ""))
    one = lambda p: F.struct(F.trim(F.regexp_extract(p, r"<TYPE>([^\r\n<]+)", 1)).alias("type"), body(p).alias("body"))
    documents = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("<DOCUMENT>"))), one)
    return records.withColumns({"header": F.substring_index("payload", "<DOCUMENT>", 1), "documents": documents})


def document_of(kind: str) -> Column:
    """The body of a submission's first document of a type; null where it has none."""
    return F.get(F.filter("documents", lambda x: x["type"] == kind), 0)["body"]


def parsed_payload(fmt: str, schema: str, payload: str = "payload") -> Column:
    """The payload by a schema, and itself as ``_corrupt`` where it does not fit. A list of rows is in the field rows."""
    text = F.col(payload)
    if schema.startswith("array"):
        schema, text = f"rows {schema}", F.concat(F.lit('{"rows":'), text, F.lit("}"))
    return READERS[fmt](text, f"{schema}, {CORRUPT} string", OPTIONS)


def body(payloads: DataFrame, fmt: str, schema: str) -> Column:
    """The parsed payload: what intake() has parsed already, or parsed now."""
    found = F.col("parsed") if "parsed" in payloads.columns else parsed_payload(fmt, schema)
    return found["rows"] if schema.startswith("array") else found


@dataclass(frozen=True)
class Source:
    """How one source's payloads become rows: an extractor over (document, payload, parsed), the rows' key and order."""

    name: str
    fmt: str
    schema: str
    extract: Callable[[DataFrame], DataFrame]
    keys: list[str]
    order: list[str] = field(default_factory=list)
    complete: str | None = None  # a condition on ``parsed`` without which a payload as a whole is rejected


@dataclass(frozen=True)
class Intake:
    """accepted: rows that the target lacks; quarantine: source, document, reason, payload; summary: one row of counts."""

    accepted: DataFrame
    quarantine: DataFrame
    summary: DataFrame

    def write(self, folder: str, batch_id: int) -> None:
        """Both sinks of a batch, each in a folder of its own, so that a batch that is run again replaces what it wrote."""
        self.accepted.write.mode("overwrite").parquet(f"{folder}/accepted/batch={batch_id}")
        self.quarantine.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")


def counted(name: str, documents: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """documents has ``reason``, null for good ones; a good document without rows is empty."""
    seen = documents.agg(F.count("*").alias("seen"), F.count("reason").alias("error"))
    found = rows.groupBy("document").agg(F.count("*").alias("n")).agg(F.count("*").alias("with_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    one = seen.crossJoin(found).crossJoin(fresh.agg(F.count("*").alias("created")))  # a row each
    return one.select(F.lit(name).alias("source"), "seen", "error", (F.col("seen") - F.col("error") - F.col("with_rows")).alias("empty"), "created", (F.col("rows") - F.col("created")).alias("duplicate"))


def intake(batch: DataFrame, source: Source, known: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Intake:
    """Take in a batch of (document, payload): parsed once and held by ``keep`` (written and read again), then told apart.

    Who takes one of the three results only needs nothing held, and may give a ``keep`` that returns what it gets.
    ``known`` has the keys of the target. A batch of other shape than the source's schema goes to quarantine payload by
    payload; a null or blank payload does too.
    """
    one = batch.withColumn("parsed", parsed_payload(source.fmt, source.schema))
    broken = F.col("parsed").isNull() | F.col("parsed")[CORRUPT].isNotNull()
    reason = F.when(~F.coalesce("payload", F.lit("")).rlike(r"\S"), "no payload").when(broken, f"broken {source.fmt}")
    if source.complete:
        reason = reason.when(~F.coalesce(F.expr(source.complete), F.lit(False)), "incomplete")
    one = keep(one.withColumn("reason", reason))
    rows = source.extract(one.filter("reason IS NULL").drop("reason"))
    order = [F.col(c).asc_nulls_first() for c in source.order or source.keys]
    fresh = eventlog.new_rows(rows, known, source.keys, order)
    # the test is within an explode: where nothing is kept, a filter would be pushed below the parsing and parse again
    rejected = one.select(F.lit(source.name).alias("source"), "document", F.explode(F.array_compact(F.array("reason"))).alias("reason"), "payload")
    return Intake(fresh, rejected, counted(source.name, one.select("document", "reason"), rows.select("document"), fresh))
