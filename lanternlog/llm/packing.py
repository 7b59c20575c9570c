"""Best-fit packing by hierarchical residuals: tokenised documents into as few fixed-length sequences as can be.

Each task tokenises its documents, cuts those longer than a sequence, and packs the pieces best-fit in falling
order. Bins at least ``nearly_full``, and bins that not even the emptiest one fits into, are done; the others go on as
items, ``fan_in`` tasks' bins to one, for the next best-fit round, until as few tasks hold them as can: each takes about
``most_items``. One task's bins don't fit together any more; where several are needed, the bins are dealt anew in each
round, until a round saves less than the share ``least_saved`` of them. A bin travels as one row with its pieces, at most as many as it has tokens, so no task ever
holds more than its share of bins.

Defined cases: a null or empty text is the one token 0; only texts longer than a sequence are cut, and only their last
piece may be shorter; repeated rows and null ids are documents of their own; an empty table gives an empty result. Very
long texts are encoded word by word in a bounded table and become many pieces. Columns besides those that an operator
names are not read by it, or are handed on as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut_lineage, ship_package, table
from .tokens import vocabulary_path, word_encoder

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = pa.schema([("fill", pa.int64()), ("pieces", pa.list_(PIECE))])
BIN_SCHEMA = "fill long, pieces array<struct<doc_id:long, piece:int, start:long, length:long, ids_crc32:long>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in falling order: each item goes to the fullest bin that still takes it. Returns the bins' items.

    Bins wait in one stack for each free space, and a bit for each space that has a bin, so an item costs one search.
    """
    order = np.argsort(-np.asarray(sizes), kind="stable")
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0
    for i in order.tolist():
        size = sizes[i]
        fits = open_spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                open_spaces ^= 1 << space
            bins[b].append(i)
        else:
            space, b = capacity, len(bins)
            bins.append([i])
        rest = space - size
        if rest:
            free[rest].append(b)
            open_spaces |= 1 << rest
    return bins


def piece_lists(lists: list[list[tuple]]) -> pa.ListArray:
    columns = zip(*(p for x in lists for p in x), strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, PIECE, strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(PIECE)))


def packed_rows(items: list[tuple[int, list]], capacity: int, most_items: int) -> Iterator[pa.RecordBatch]:
    """Bins of the items (fill, pieces); more than most_items are packed in blocks of that many."""
    for at in range(0, len(items), most_items):
        block = items[at : at + most_items]
        found = best_fit([x[0] for x in block], capacity)
        for lo in range(0, len(found), 5_000):
            rows = [(sum(block[i][0] for i in b), [p for i in b for p in block[i][1]]) for b in found[lo : lo + 5_000]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), piece_lists([r[1] for r in rows])], schema=BIN)


def first_round(path: str, capacity: int, most_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, items, end = word_encoder(path), [], np.zeros(1, "<u4")
        for doc_ids, texts in blocks(batches, 3_000_000):
            joined, ends = encoder.encode(texts)
            for doc_id, start, stop in zip(doc_ids, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                ids = np.concatenate([joined[start:stop], end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    items.append((len(own), [(doc_id, k, at, len(own), crc32(own.astype("<u4").tobytes()))]))
            if len(items) >= most_items:
                yield from packed_rows(items, capacity, most_items)
                items = []
        yield from packed_rows(items, capacity, most_items)

    return run


def next_round(capacity: int, most_items: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list = []
        for batch in batches:
            pieces = batch.column(1).flatten()
            rows = list(zip(*(pieces.field(i).to_pylist() for i in range(len(PIECE))), strict=True))
            bounds = batch.column(1).offsets.to_pylist()
            items += [(fill, rows[a - bounds[0] : b - bounds[0]]) for fill, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:], strict=False)]
        yield from packed_rows(items, capacity, most_items)

    return run


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of each bin, laid end to end in the bin's order."""
    for batch in batches:
        lists = batch.column(1)
        pieces, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(counts)), counts)
        length = pieces.field("length").to_numpy()
        ends = np.cumsum(length)
        fill = np.bincount(owner, length, len(counts)).astype(np.int64)
        offset = ends - length - (np.cumsum(fill) - fill)[owner]
        columns = [pieces.field(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
        ids = batch.column(0).to_numpy()[owner]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(documents: DataFrame, *, vocabulary: str = VOCABULARY, length: int = LENGTH, nearly_full: float = 0.995, fan_in: int = 8, most_items: int = 200_000, least_saved: float = 0.001) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship_package(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    bins = cut_lineage(docs.mapInArrow(first_round(vocabulary_path(vocabulary), length, most_items), BIN_SCHEMA))
    done, tasks, turn = [], bins.rdd.getNumPartitions(), 0
    while True:
        least, n_bins = bins.agg(F.min("fill"), F.count("*")).first()
        is_done = (F.col("fill") >= int(nearly_full * length)) | (F.col("fill") + (least or 0) > length)
        rest = bins.filter(~is_done)
        done.append(bins.filter(is_done))
        before = rest.count()
        fewest = -(-before // most_items)
        if before < 2 or (turn and tasks == fewest and (tasks == 1 or n_bins > (1 - least_saved) * dealt)):
            break
        # bins are dealt by their first piece, so that each task gets a mixture of sizes, the same on a rerun
        tasks, turn, dealt = max(-(-tasks // fan_in), fewest), turn + 1, before
        first = F.col("pieces")[0]
        bins = cut_lineage(rest.repartition(tasks, F.xxhash64(F.lit(turn), first["doc_id"], first["piece"], "fill")).mapInArrow(next_round(length, most_items), BIN_SCHEMA))
    everything = rest
    for d in done:
        everything = everything.unionByName(d)
    # each bin is one row of a written table, so its number is the same whenever a task runs again
    numbered = everything.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    return numbered.mapInArrow(placed, PLACED)


def op9_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
