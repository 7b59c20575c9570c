"""Entities and roles as keyed state: what is known of a key is the merge of what every batch says of it.

A batch is summed up to one row a key (firsts, lasts and sets), and that row is all that is written: into the part that
the key's hash names, in a folder of the batch's own. Firsts, lasts and sets can be merged in any order, and twice does
no harm, so late and shuffled batches give what one batch would give, and a batch that is run again replaces what it
wrote. A batch's reads follow its keys: only parts that it has keys of, and of those only files whose Bloom filters know
one. ``compact`` merges what many batches wrote to a part; until then a part has a small file for each of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType


@dataclass(frozen=True)
class Merge:
    """How rows of a key become one: columns, each an aggregate that takes its own results and may take them twice."""

    keys: list[str]
    columns: dict[str, Callable[[str], Column]]

    def __call__(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*(how(c).alias(c) for c, how in self.columns.items()))


def union_of_sets(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class KeyedState:
    """A table of merged rows under ``folder``, laid out by ``parts`` hashes of the key."""

    def __init__(self, spark: SparkSession, folder: str, schema, merge: Merge, parts: int = 64):
        self.spark, self.folder, self.merge, self.parts = spark, folder, merge, parts
        self.schema = StructType([*schema.fields, StructField("part", IntegerType()), StructField("batch", IntegerType())])
        # a state always has a first, empty batch, so that there is a folder to read
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/part=-1/batch=-1")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.merge.keys), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of (key, columns, part); parts of the same batch that a run before wrote are replaced."""
        writer = rows.repartition("part").sortWithinPartitions("part", *self.merge.keys).withColumn("batch", F.lit(batch_id)).write
        for key in self.merge.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(self.folder)

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """What batches wrote, of some parts if they are named."""
        out = self.spark.read.schema(self.schema).parquet(self.folder)
        return out if parts is None else out.filter(F.col("part").isin(parts))

    def upsert(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's merged rows, and return what is known of its keys from then on."""
        own = self.merge(batch).withColumn("part", self._part())
        self._write(own, batch_id)
        mine = self.rows().filter(F.col("batch") == batch_id)
        touched = [r.part for r in mine.select("part").distinct().collect()]  # ``parts`` at most
        keys = mine.filter(F.col("part").isin(touched)).select(*self.merge.keys)
        return self.merge(self.rows(touched).join(keys, self.merge.keys, "left_semi"))

    def read(self) -> DataFrame:
        """The whole state, a row a key."""
        return self.merge(self.rows())

    def compact(self, upto: int) -> None:
        """One file for each part instead of those of batches until ``upto``. Stopped halfway it leaves rows twice, which merge."""
        old = self.rows().filter((F.col("batch") <= upto) & (F.col("part") >= 0))
        done = [(r.part, r.batch) for r in old.select("part", "batch").distinct().collect()]  # folders, not rows
        self._write(self.merge(old).withColumn("part", self._part()), upto)
        for part, batch in done:
            if batch < upto:
                remove(self.spark, f"{self.folder}/part={part}/batch={batch}")


def follow(stream: DataFrame, state: KeyedState, partials: Callable[[DataFrame], DataFrame], checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, compact_every: int = 100) -> StreamingQuery:
    """Keep a state by a stream: ``partials`` makes a batch's rows; on_change gets what is known now of the batch's keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = state.upsert(partials(batch), batch_id)
        if on_change is not None:
            on_change(changed, batch_id)
        if batch_id and batch_id % compact_every == 0:
            state.compact(batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- entities ------------------------------------------------------------------------------------------------------

ENTITY_KEYS = ["id_type", "id_value"]
ENTITIES = Merge(ENTITY_KEYS, {"first": F.min, "profiles": union_of_sets})


def entity_partials(sightings: DataFrame) -> DataFrame:
    """Sightings (id_type, id_value, kind, name, ticker, seen_at, seen_order) as rows that merge to entities."""
    rows = sightings.filter(F.col("id_value").isNotNull())
    return rows.select(F.col("id_type"), F.col("id_value").cast("string"), F.struct("seen_at", "seen_order", "name", "kind", "ticker").alias("first"), F.array("kind").alias("profiles"))


def entities(merged: DataFrame) -> DataFrame:
    """Merged rows as entities: the first name and, if it came with it, ticker; a person's claim corrects the first kind."""
    kind = F.when(F.array_contains("profiles", "PERSON"), "PERSON").otherwise(F.col("first.kind"))
    key = F.sha2(F.concat_ws(":", "id_type", "id_value"), 256)
    return merged.select("id_type", "id_value", key.alias("entity_key"), F.col("first.name").alias("canonical_name"), kind.alias("kind"), "profiles", F.col("first.ticker").alias("ticker"))


def identifiers(found: DataFrame) -> DataFrame:
    """A row for each identifier of an entity: the one that it was made by is primary, a ticker is not."""
    own = F.struct(F.col("id_type").alias("type"), F.col("id_value").alias("value"), F.lit(True).alias("is_primary"))
    ticker = F.when(F.col("ticker").isNotNull(), F.struct(F.lit("TICKER").alias("type"), F.col("ticker").alias("value"), F.lit(False).alias("is_primary")))
    rows = found.select("entity_key", F.explode(F.array_compact(F.array(own, ticker))).alias("i"))
    return rows.select("entity_key", F.col("i.type").alias("identifier_type"), F.col("i.value").alias("identifier_value"), "i.is_primary")


# --- roles ---------------------------------------------------------------------------------------------------------

FLAGS = ["is_officer", "is_director", "is_ten_percent_owner"]
ROLES = Merge(["person_id", "company_id"], {"latest": F.max, "titled": F.max, "start_date": F.min})


def role_partials(transactions: DataFrame) -> DataFrame:
    """Transactions as rows that merge to roles: the latest flags, the latest title that says something, the first date."""
    order = [F.col("publication_time").alias("at"), F.col("event_id").alias("event")]
    titled = F.when(F.col("title") != "", F.struct(*order, "title"))
    return transactions.select("person_id", "company_id", F.struct(*order, *FLAGS).alias("latest"), titled.alias("titled"), F.col("publication_time").alias("start_date"))


def roles(merged: DataFrame) -> DataFrame:
    return merged.select("person_id", "company_id", *(F.col(f"latest.{c}").alias(c) for c in FLAGS), F.col("titled.title").alias("title"), "start_date")
