"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Every stage takes all that the one before it kept. All but the last return the columns of documents; n_chars follows
the text. A stage's result is written as Parquet in the shared folder and read again, so a lost executor costs at most
the stage that runs; it is deleted when the stage after it is written.

Null and empty texts fail the quality rules and go in the first stage; repeated rows are judged alike and the third
stage keeps one of them; an empty table gives an empty result. Other columns than doc_id, text, lang and n_chars are
handed on as they are, whatever their names. Very long texts go through every stage whole.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternlog.llm.common import shared_dir, table
from lanternlog.llm.decontaminate import decontaminated
from lanternlog.llm.line_dedup import without_repeated_lines
from lanternlog.llm.minhash import without_near_duplicates
from lanternlog.llm.packing import pack
from lanternlog.llm.quality import kept_documents
from lanternlog.session import ship_package

#: The tokeniser, its bands and the exact packing have no counterpart in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def stage(f):
    """A stage makes sure that the workers can import the package before it builds its plan."""

    @functools.wraps(f)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(docs.sparkSession)
        return f(spark, docs, sf_dir)

    return run


@stage
def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row as it is.

    Null, empty and short texts fail the base rules; a null lang is judged by its script; repeated rows are judged alike.
    """
    return kept_documents(docs)


@stage
def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated three-line windows; n_chars follows. A document that loses all its lines goes.

    A null text has no lines and stays; repeated rows are one document, so neither takes lines from the other.
    """
    left = without_repeated_lines(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


@stage
def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    A text without words is a class of its own; of repeated rows one stays; a null doc_id comes after every other.
    """
    return without_near_duplicates(docs)


@stage
def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and wordless texts hold none; repeated rows are judged alike."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; a null text is the one token that ends it."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]


def delete(folder: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.delete_dir(path)


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    written = ""
    for name, step in STAGES[:-1]:
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if written:
            delete(written)
        written = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
