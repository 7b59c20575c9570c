"""The same transforms under Structured Streaming: files that land are appended once and totalled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators import eventlog


def landing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A landing directory as a stream, always with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def once_within(stream: DataFrame, keys: list[str], clock: str, delay: str) -> DataFrame:
    """Each key once, as long as its repetitions come within ``delay`` of each other; state is bounded by that."""
    return stream.withWatermark(clock, delay).dropDuplicatesWithinWatermark(keys)


MOST_PARTS = 1_000  # parts of a target that a batch is held against by name; beyond, against all of them


def appended_once(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[Column], part: Column | None = None, spread: int = 4, on_new: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append every key once, whenever it comes: each batch is anti-joined with the target, as in a batch run.

    ``part`` is a function of the keys that puts keys that come at about the same time into one part, such as a range of
    accession numbers; the target is laid out by it, and a batch reads only the parts that it has keys of. A batch
    writes into its own folder, so that a batch that is run again after a failure replaces what it wrote. With ``part``,
    a batch and the keys that are known are dealt by part and ``spread`` hashes of the key, once: the first row of each
    key is found there, known keys first, and written from there, so a part gets ``spread`` files a batch at most.
    """
    spark, schema = stream.sparkSession, stream.schema
    own = (part if part is not None else F.lit(0)).cast("long").alias("part")
    # a target always has a first, empty batch, so that there is a folder to read
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{target}/batch=-1/part=0")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select("*", own)
        some = [r.part for r in batch.select("part").distinct().limit(MOST_PARTS + 1).collect()]
        known = target_rows(batch.sparkSession, target, schema, before=batch_id)
        if len(some) <= MOST_PARTS:
            known = known.filter(F.col("part").isin(some))
        fresh = eventlog.new_rows(batch, known, keys, order) if part is None else new_by_part(batch, known, keys, order, spread)
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{target}/batch={batch_id}")
        if on_new is not None:
            on_new(target_rows(batch.sparkSession, target, schema).filter(F.col("batch") == batch_id).drop("batch", "part"), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_by_part(batch: DataFrame, known: DataFrame, keys: list[str], order: list[Column], spread: int) -> DataFrame:
    """eventlog.new_rows where part is a function of the keys: one shuffle, by part and ``spread`` hashes of the key.

    A key with a null is new each time, as in an anti-join.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    both = batch.withColumn("_new", F.lit(True)).unionByName(known.filter(whole).select(*keys, "part", F.lit(False).alias("_new")), allowMissingColumns=True)
    dealt = both.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(spread))).repartition("part", "_slot")
    first = W.partitionBy("part", "_slot", *keys).orderBy("_new", *order)
    return dealt.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1 AND _new").drop("_rank", "_new", "_slot")


def target_rows(spark: SparkSession, target: str, schema, before: int | None = None) -> DataFrame:
    """What has been appended, with its batch and part, of batches before a given one if it is given."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType()), StructField("part", LongType())])).parquet(target)
    return rows if before is None else rows.filter(F.col("batch") < before)


def read_target(spark: SparkSession, target: str, schema) -> DataFrame:
    """What has been appended."""
    return target_rows(spark, target, schema).drop("batch", "part")


def window_totals(stream: DataFrame, clock: str, key: str, amount: Column, window: str, delay: str) -> DataFrame:
    """Totals of tumbling windows by key; a window is final when the watermark has passed it."""
    grouped = stream.withWatermark(clock, delay).groupBy(F.window(clock, window), key)
    return grouped.agg(F.sum(amount).alias("total"), F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "total", "n")
