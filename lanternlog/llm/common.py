"""What the training-data operators share: table reading, the shared folder, row keys and word splitting.

A document row is identified by (doc_id, hash of its text). Rows that agree in both are one document; each of
them gets that document's result. A null doc_id sorts before every other id.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: FIXED VALUES: the white space that separates words, as in [^\x20\x09-\x0D]+ (bytes.split() cuts at the same six).
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests).

    On a cluster nothing but spark.checkpoint.dir is known to be shared, so there its absence is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text), F.length(text))


def packed(documents: DataFrame) -> DataFrame:
    """doc_id, text, text_hash and everything else in a struct, so that no other column's name can clash."""
    rest = [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    return documents.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("rest"), text_key().alias("text_hash"))


def unpacked(df: DataFrame, documents: DataFrame, *added: str) -> DataFrame:
    """The columns of documents in their order, from what packed() made of them, then the added ones."""
    own = [c for c in documents.columns if c not in added]
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in own), *added)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser) over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(batches, most: int) -> Iterator[tuple[list, ...]]:
    """Column lists of consecutive rows, the last column text: about ``most`` characters a block, one row at least."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = size = 0
        for i, text in enumerate(columns[-1]):
            if size and size + len(text) > most:
                yield tuple(c[start:i] for c in columns)
                start, size = i, 0
            size += len(text) + 1
        if start < batch.num_rows:
            yield tuple(c[start:] for c in columns)


class WordTable:
    """Numbers the distinct words that a task has met; what is derived from a word is computed once for each number.

    It is emptied when it holds more than ``limit`` words, so its memory is bounded whatever the texts are.
    """

    def __init__(self, derive, limit: int = 250_000):
        self.derive, self.limit = derive, limit
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.values: list[np.ndarray] = []

    def numbers(self, docs_words: list[list[bytes]]) -> np.ndarray:
        """The numbers of all words, documents joined; also derives what new words need."""
        if len(self.ids) > self.limit:
            self.ids, self.values = defaultdict(count().__next__), []
        known = len(self.ids)
        out = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(docs_words)), np.int64, sum(map(len, docs_words)))
        if len(self.ids) > known:
            fresh = self.derive(list(islice(self.ids, known, None)))
            self.values = [np.concatenate([a, b]) for a, b in zip(self.values, fresh, strict=True)] if self.values else list(fresh)
        return out
