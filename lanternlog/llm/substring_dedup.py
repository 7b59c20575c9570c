"""Substring dedup: windows of 35 words that start in more than one place, found by prefix-partitioned suffix trees.

Every word is the start of a suffix; two windows are equal where their suffixes share 35 words, which is where a suffix
tree of the whole corpus has an internal node of that depth or more. The tree is never built whole: suffixes are split
by prefixes into groups that fit a task's memory, each group's subtree is built alone, and the leaves below its deep
internal nodes are the places of repeats.

1. Equal texts are combined, as every hot group is: all their windows repeat, and one text of them goes on as a witness.
2. A suffix is dealt by 8 of its first 35 words, those of least hash (its anchor). Equal windows have the same anchor,
   and neighbours mostly share one, so they travel as one run of words instead of 35 words each. Anchors go through one
   shuffle of numbers; only runs with one that occurs twice are cut out of their documents. Where nothing else has the
   anchor of a suffix, no deep node can be above it.
3. An anchor with more than ``most_runs`` runs is hot. Its suffixes are dealt by a longer prefix, all 35 words, so that
   no group grows with the corpus. A task sends a run twice at most; the others of its own are settled where they are.
4. Runs arrive sorted by what they are dealt by. Of about ``most_words`` words at a time the suffixes are ranked by their
   first 1, 3, 9, 27 and 35 words; prefixes get longer until a group has ``most_leaves`` suffixes at most; each group's
   subtree is its sorted suffixes with the common prefixes of neighbours (``deep_nodes``).
5. Repeated starts go back to their documents as spans; windows that overlap or touch are one maximal repeat there.

Words are compared as they are; hashes only say where a run goes. Texts are shuffled once, for 2 and 5.

Defined cases: a null text has no words; fewer than 35 words lose nothing; a repeated row is a document of its own, so all
its windows repeat; a null doc_id is an id like others; very long texts go in blocks of their own and are cut into runs;
a text of one word or a short period repeats within itself; an empty table gives an empty result; columns besides
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, blocks, mix64, shared_dir, ship_package, table
from .suffix_dedup import NO_ID, joined, ranges

WINDOW, ANCHOR = 35, 8
GRAMS = WINDOW - ANCHOR + 1  # anchors that a window could have
MOST_STARTS = 64  # of one run; longer ones, as of one word repeated, are cut
BLOCK = 2_000_000  # bytes of text at a time
PREFIXES = (1, 3, 9, 27, WINDOW)


def word_hashes() -> WordTable:
    return WordTable(lambda new: [np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])


def runs_of(docs: list[list[bytes]], words: WordTable) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: anchor, document, first start in it, starts, places of the anchor."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(sizes)
    if not len(docs) or ends[-1] < WINDOW:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    begins = ends - sizes
    numbers = words.numbers(docs)
    h = words.values[0][numbers]
    for size in (1, 2, 4):
        h = joined(h, None, size)
    grams = mix64(h)
    keys, span = grams, 1
    while 2 * span <= GRAMS:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    keys = np.minimum(keys[: len(keys) - (GRAMS - span)], keys[GRAMS - span :])
    cut = np.ones(len(keys), bool)
    cut[1:] = keys[1:] != keys[:-1]
    for edge in (begins, ends - WINDOW + 1):  # where a document begins, and where its windows end
        cut[edge[(edge >= 0) & (edge < len(keys))]] = True
    start = np.flatnonzero(cut)
    n = np.diff(np.append(start, len(keys)))
    doc = np.searchsorted(ends, start, "right")
    own = start <= ends[doc] - WINDOW
    start, n, doc = start[own], n[own], doc[own]
    if (n > MOST_STARTS).any():
        parts = -(-n // MOST_STARTS)
        nth = ranges(np.zeros(len(n), np.int64), parts)
        start, n, doc = (np.repeat(x, parts) for x in (start, n, doc))
        start, n = start + nth * MOST_STARTS, np.minimum(n - nth * MOST_STARTS, MOST_STARTS)
    key, seen = keys[start], n + GRAMS - 1
    places = np.zeros(0, np.int64)
    if len(start):
        is_anchor = grams[ranges(start, seen)] == np.repeat(key, seen)
        places = np.add.reduceat(is_anchor.astype(np.int64), np.cumsum(seen) - seen)
    return key, doc, start - begins[doc], n, places


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, slot, text): each document's anchors and how often they occur in it."""
    words = word_hashes()
    for ids, slots, texts in blocks(batches, BLOCK):
        key, doc, _, _, places = runs_of([t.split() for t in texts], words)
        order = np.lexsort((key, doc))
        key, doc, places = key[order], doc[order], places[order]
        if len(key):
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            n = np.add.reduceat(places, first)
            yield pa.RecordBatch.from_arrays([np.array(ids, np.int64)[doc[first]], np.array(slots, np.int64)[doc[first]], key[first].view(np.int64), n], ["id", "slot", "key", "n"])


SENT = "route long, id long, slot long, start int, words binary, spans binary"
SENT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), SENT_KINDS, strict=True)], [x.split()[0] for x in SENT.split(", ")])


def run_sender(most_known: int, most_bytes: int = 64_000_000):
    """From (id, slot, wanted anchors, hot ones of them, text): runs to deal out, and spans of those that are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        known: dict[bytes, bool] = {}  # runs that went out: whether twice
        held = 0
        for ids, slots, wanted, hot, texts in blocks(batches, BLOCK):
            docs = [t.split() for t in texts]
            keys, doc, start, n, _ = runs_of(docs, hashes)
            keys = keys.view(np.int64)
            bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
            rows, size = [], 0
            for d, (i, s) in enumerate(zip(ids, slots, strict=True)):
                a, b = bounds[d], bounds[d + 1]
                hit = a + np.flatnonzero(np.isin(keys[a:b], np.array(wanted[d], np.int64)))
                is_hot = set(hot[d])
                settled: list[tuple[int, int]] = []
                for k, at, m in zip(keys[hit].tolist(), start[hit].tolist(), n[hit].tolist(), strict=True):
                    cuts = [(at, m)] if k not in is_hot else [(at + j, 1) for j in range(m)]
                    for first, starts in cuts:
                        words = b" ".join(docs[d][first : first + starts + WINDOW - 1])
                        twice = known.get(words)
                        if twice:
                            settled.append((first, first + starts + WINDOW - 1))
                            continue
                        if len(known) > most_known or held > most_bytes:
                            known.clear()
                            held = 0
                        held += len(words) if twice is None else 0
                        known[words] = twice is not None
                        route = k if k not in is_hot else xxhash.xxh3_64_intdigest(words) - 2**63
                        rows.append((route, i, s, first, words, None))
                        size += len(words)
                if settled:
                    rows.append((hash((i, s)), i, s, None, None, np.array(settled, np.int64).tobytes()))
                if size > BLOCK:
                    yield as_batch(rows)
                    rows, size = [], 0
            if rows:
                yield as_batch(rows)

    return run


# --- subtrees ------------------------------------------------------------------------------------------------------


def prefix_ranks(words: np.ndarray) -> dict[int, np.ndarray]:
    """For each length of PREFIXES: the rank of the words from each place on, so long, among all of them."""
    ranks = {1: words}
    for shorter, longer in zip(PREFIXES, PREFIXES[1:], strict=False):
        r = ranks[shorter]
        steps = [0, shorter, 2 * shorter] if longer == 3 * shorter else [0, longer - shorter]
        size = len(words) - longer + 1
        is_narrow = len(words) < 1 << 21  # then three ranks fit in one number
        packed = r[:size].astype(np.int64)
        for at in steps[1:]:
            packed = packed << (21 if is_narrow else 31) | r[at : at + size]
            if not is_narrow:
                packed = np.unique(packed, return_inverse=True)[1]
        ranks[longer] = np.unique(packed, return_inverse=True)[1]
    return ranks


def prefix_groups(starts: np.ndarray, ranks: dict[int, np.ndarray], most_leaves: int) -> Iterator[np.ndarray]:
    """Suffixes by prefixes of variable length: longer ones where a group is too large, small groups bundled."""
    waiting = [(starts, 0)]
    while waiting:
        own, depth = waiting.pop()
        if len(own) <= most_leaves or depth == len(PREFIXES):
            yield own
            continue
        own = own[np.argsort(ranks[PREFIXES[depth]][own], kind="stable")]
        r = ranks[PREFIXES[depth]][own]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        size = np.diff(np.append(begin, len(own)))
        lo = 0  # where the bundle begins
        for a, n in zip(begin.tolist(), size.tolist(), strict=True):
            if a > lo and (n > most_leaves or a + n - lo > most_leaves):
                yield own[lo:a]
                lo = a
            if n > most_leaves:
                waiting.append((own[a : a + n], depth + 1))
                lo = a + n
        if lo < len(own):
            yield own[lo:]


def common_prefixes(a: np.ndarray, b: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
    """How many of their first WINDOW words the suffixes at a and b share."""
    whole = ranks[WINDOW][a] == ranks[WINDOW][b]
    length = np.zeros(len(a), np.int64)
    for size in (27, 9, 9, 3, 3, 1, 1):
        fits = length + size <= WINDOW
        at = np.where(fits, length, 0)
        length += np.where(fits & (ranks[size][a + at] == ranks[size][b + at]), size, 0)
    return np.where(whole, WINDOW, length)


def deep_nodes(own: np.ndarray, ranks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A subtree's leaves in order, and the number of the deep internal node, or of the lone leaf, that each is below."""
    leaves = own[np.argsort(ranks[WINDOW][own], kind="stable")]
    common = common_prefixes(leaves[:-1], leaves[1:], ranks)
    return leaves, np.cumsum(np.append(0, common < WINDOW))


def repeated_starts(runs: list[bytes], several: np.ndarray, most_leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct runs, some of them held several times: whether the window at each start repeats, and starts by run."""
    numbers: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.empty(len(runs), np.int64)
    words: list[int] = []
    for k, text in enumerate(runs):
        own = text.split(b" ")
        sizes[k] = len(own)
        words += map(numbers.__getitem__, own)
    n_starts = sizes - WINDOW + 1
    starts = ranges(np.cumsum(sizes) - sizes, n_starts)
    ranks = prefix_ranks(np.array(words, np.int64))
    is_several = np.zeros(len(words), bool)
    is_several[starts] = np.repeat(several, n_starts)
    repeats = np.zeros(len(words), bool)
    for group in prefix_groups(starts, ranks, most_leaves):
        leaves, node = deep_nodes(group, ranks)
        below = np.bincount(node, weights=1 + is_several[leaves])
        repeats[leaves] = below[node] > 1
    return repeats[starts], n_starts


SPANS = "id long, slot long, spans binary"


def span_batch(ids, slots, spans) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(slots, pa.int64()), pa.array(spans, pa.binary())], ["id", "slot", "spans"])


def settled(runs: dict[bytes, int], holders: list[tuple[int, int, int, int]], most_leaves: int) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated windows of all holders (id, slot, start, number of the run)."""
    number = np.array([x[3] for x in holders], np.int64)
    repeats, n_starts = repeated_starts(list(runs), np.bincount(number, minlength=len(runs)) > 1, most_leaves)
    run_of, begins = np.repeat(np.arange(len(runs)), n_starts), np.cumsum(n_starts) - n_starts
    at = np.flatnonzero(repeats)
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (run_of[at[1:]] != run_of[at[:-1]]))) if len(at) else at
    tail = np.append(head[1:], len(at))[: len(head)] - 1
    run = run_of[at[head]]
    spans = np.stack([at[head] - begins[run], at[tail] - begins[run] + WINDOW], axis=1)
    bounds = np.searchsorted(run, np.arange(len(runs) + 1)).tolist()
    out = [(i, s, (spans[bounds[k] : bounds[k + 1]] + at).tobytes()) for i, s, at, k in holders if bounds[k] < bounds[k + 1]]
    for lo in range(0, len(out), 20_000):
        yield span_batch(*zip(*out[lo : lo + 20_000], strict=True))


def run_settler(most_words: int, most_leaves: int):
    """Of runs that come sorted by route: spans of repeated windows, whole routes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[bytes, int] = {}
        holders: list[tuple[int, int, int, int]] = []
        size, last = 0, None
        for batch in batches:
            done = batch.filter(pa.compute.is_valid(batch.column(5)))
            if done.num_rows:
                yield span_batch(done.column(1), done.column(2), done.column(5))
            own = batch.filter(pa.compute.is_valid(batch.column(4)))
            for route, i, s, start, words in zip(*(own.column(k).to_pylist() for k in range(5)), strict=True):
                if route != last and (size > most_words or len(holders) > most_words):
                    yield from settled(runs, holders, most_leaves)
                    runs, holders, size = {}, [], 0
                last = route
                if words not in runs:
                    runs[words] = len(runs)
                    size += words.count(b" ") + 1
                holders.append((i, s, start, runs[words]))
        if holders:
            yield from settled(runs, holders, most_leaves)

    return run


# --- documents -----------------------------------------------------------------------------------------------------

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
SPAN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, is_copy, spans of a document, text): the maximal repeats in words, and the other words joined."""
    for ids, copies, spans, texts in blocks(batches, BLOCK):
        rows = []
        for i, is_copy, own, text in zip(ids, copies, spans, texts, strict=True):
            words = text.split()
            merged: list[tuple[int, int]] = []
            if is_copy:
                merged = [(0, len(words))] if len(words) >= WINDOW else []
            elif own:
                pairs = np.unique(np.frombuffer(b"".join(own), np.int64).reshape(-1, 2), axis=0)
                reach = np.maximum.accumulate(pairs[:, 1])
                first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
                merged = list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist(), strict=True))
            kept, at = [], 0
            for start, end in merged:
                kept += words[at:start]
                at = end
            kept += words[at:]
            rows.append((None if i == NO_ID else i, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in merged], b" ".join(kept)))
        kinds = [pa.int64()] * 3 + [SPAN_LIST, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_copies(docs: DataFrame) -> DataFrame:
    """(id, slot, is_witness) of documents whose whole text another row has too; one id of each text is its witness."""
    slim = docs.filter(F.octet_length("text") >= 2 * WINDOW - 1).select("id", "slot", F.xxhash64(F.lit("second"), "text").alias("h2"))
    first = slim.groupBy("slot", "h2").agg(F.min("id").alias("witness"), F.count("*").alias("n")).filter("n > 1")
    return slim.join(first, ["slot", "h2"]).select("id", "slot", (F.col("id") == F.col("witness")).alias("is_witness")).distinct()


def substring_dedup(documents: DataFrame, *, most_runs: int = 20_000, most_words: int = 500_000, most_leaves: int = 100_000, most_known: int = 200_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, spans (maximal repeats, in words) and kept (the other words, joined)."""
    spark = documents.sparkSession
    ship_package(spark)
    folder = f"{shared_dir(spark)}/substring-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("slot"), text.cast("binary").alias("text"))
    copies = written(whole_copies(docs), f"{folder}/copies")
    every_anchor = written(docs.mapInArrow(anchors, "id long, slot long, key long, n long"), f"{folder}/anchors")
    own = every_anchor.join(copies.filter("NOT is_witness"), ["id", "slot"], "left_anti")
    repeated = own.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key", (F.col("n") > most_runs).alias("is_hot"))
    found = own.join(repeated, "key").groupBy("id", "slot")  # no more than a document's own anchors
    wanted = found.agg(F.collect_list("key").alias("wanted"), F.collect_list(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
    sent = docs.join(wanted, ["id", "slot"]).select("id", "slot", "wanted", "hot", "text").mapInArrow(run_sender(most_known), SENT)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    spans = sent.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(run_settler(most_words, most_leaves), SPANS)
    spans = spans.groupBy("id", "slot").agg(F.collect_list("spans").alias("spans"))
    flags = copies.groupBy("id", "slot").agg(F.lit(True).alias("is_copy"))
    every = docs.join(spans, ["id", "slot"], "left").join(flags, ["id", "slot"], "left")
    return every.select("id", F.coalesce("is_copy", F.lit(False)).alias("is_copy"), "spans", "text").mapInArrow(removed, RESULT)


def op11_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
