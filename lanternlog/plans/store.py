"""Folders that driver and executors share, and results that are written once and read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession, kind: str) -> str:
    """A new folder: under spark.checkpoint.dir, or a local one in tests, where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{shared}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet once: for what a plan reads several times with different columns, which Spark can't reuse."""
    folder = workspace(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def landed(df: DataFrame, separator: str = "\n", by: str | None = None) -> str:
    """A folder of compressed text files with the rows of df's column value (a folder in it for each value of ``by``)."""
    folder = workspace(df.sparkSession, "landing")
    writer = df.write.option("lineSep", separator).option("compression", "gzip")
    (writer.partitionBy(by) if by else writer).text(folder)
    return folder
