"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and reduced to words joined by single blanks. A test item of m characters may differ by
k = ``error_rate`` * m edits, so it is cut into k + 1 pieces, one of which must stand unchanged in any text that holds
the item within k edits. Every document is searched for all pieces at once, and the neighbourhood of each hit is
verified by Myers' bit-parallel distance, which finds the best place of the item in it.

The benchmark is a stated query set and goes to the executors in blocks of about ``most_chars`` characters, with one
pass over the documents for each block; a benchmark of the usual size is one block. Documents are never moved.

Defined cases: a null or wordless document holds nothing; a null or wordless item is held by nothing; an item shorter
than 1 / error_rate must occur exactly; repeated rows give their pairs once; empty tables give an empty result. Very
long texts go through the automaton in blocks of their own. Columns besides those that an operator names are not read by
it, or are handed on as they are, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ship_package, table

WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def best_place(item: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to any part of text, and where that part ends; None if over ``most``.

    Myers' algorithm: a column of the distance table is two bit vectors of vertical steps, one bit a character.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = most + 1, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, j
    return (best, at) if best <= most else None


class Searcher:
    """All pieces of a block of items in one automaton, and what their verification needs."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        pieces = defaultdict(list)
        for item_id, text in items:
            item = normal(text)
            if not item:
                continue
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            k = int(len(item) * error_rate)
            cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[item[a:b]].append((len(self.items), b))
            self.items.append((item_id, item, k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of every item that the normal text holds, each at its best place."""
        if not text or not self.items:
            return []
        starts = defaultdict(set)
        for end, places in self.automaton.iter(text):
            for i, offset in places:
                starts[i].add(end + 1 - offset)  # where the item would begin
        out = []
        for i, found in starts.items():
            item_id, item, k, masks = self.items[i]
            best, reach = None, -1
            for start in sorted(found):
                lo, hi = max(start - k, 0), min(start + len(item) + k, len(text))
                if hi <= reach or (best and best[0] == 0):
                    continue  # lies in a neighbourhood that was verified
                if text.startswith(item, max(start, 0)):
                    best = (0, start + len(item))
                    continue
                place, reach = best_place(item, masks, text[lo:hi], k), hi if start - k >= 0 else reach
                if place and (best is None or place[0] < best[0]):
                    best = (place[0], lo + place[1])
            if best:
                out.append((item_id, *best))
        return out


_searchers: dict[str, Searcher] = {}


def searcher(shared, key: str, error_rate: float) -> Searcher:
    """The worker process's automaton for a block; older ones are dropped, so that one is held at a time."""
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = Searcher(shared.value, error_rate)
    return _searchers[key]


def item_blocks(benchmark: DataFrame, most_chars: int):
    """Broadcasts of (item_id, text) lists that together are the benchmark, each about most_chars long at most."""
    spark = benchmark.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = 1 if total <= most_chars else int(2 * total // most_chars) + 1
    for b in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield spark.sparkContext.broadcast([(r[0], r[1]) for r in own.collect()]), uuid.uuid4().hex


PAIRS = "doc_id long, item_id long, distance int, end long"


def pair_finder(shared, key: str, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(shared, key, error_rate)
        for doc_ids, texts in blocks(batches, 3_000_000):
            rows = [(d, *x) for d, t in zip(doc_ids, texts, strict=True) for x in search.find(normal(t))]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "end"])

    return run


def clean_keeper(shared, key: str, error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(shared, key, error_rate)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(np.array([not search.find(normal(t.as_py())) for t in texts], bool)))

    return run


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.06, most_chars: int = 2_000_000) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance, end (in the normal text)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for shared, key in item_blocks(benchmark, most_chars):
        found = docs.mapInArrow(pair_finder(shared, key, error_rate), PAIRS)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.min_by("end", F.struct("distance", "end")).alias("end"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, *, error_rate: float = 0.06, most_chars: int = 2_000_000) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""
    for shared, key in item_blocks(benchmark, most_chars):
        documents = documents.mapInArrow(clean_keeper(shared, key, error_rate), documents.schema)
    return documents


def op8_decontamination(spark, sf_dir):
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")
