"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, and exact verification.

A text's words (runs of word characters, lower case) give five-word shingles, each weighted 1 + ln(its count). Every
shingle sends arrivals of a Poisson process whose rate is its weight, each to a random register; a register keeps the
first. A document is done when its shingles' next arrivals are later than its last register's. Two registers agree
with the probability Jaccard similarity of the documents. A second set of registers has all weights 1, so that they
agree with the plain Jaccard similarity; it is the first one again where no shingle repeats.

1. Texts with the same words are one node, so exact copies never meet each other again.
2. Both sets of registers are hashed in bands. In each band's bucket, pairs whose registers of either set agree often
   enough to reach the threshold (four standard errors are allowed) are joined into clouds.
3. In each cloud similarity is computed exactly from the shingles: two nodes link when their Jaccard or their probability
   Jaccard similarity reaches the threshold. Pairs that are connected already are skipped.
4. Connected nodes are a class, named by its smallest doc_id.

Buckets and clouds go through in blocks of ``block`` nodes (``connected``). One of several blocks has each block compared
within itself and with a few representatives, which connects nearly all of a group of copies; what stays outside the
group's largest component is then compared with every block. So a hot group costs its size times what is outside, not
its square, and no link is left out.

Defined cases: a text without words is a class of its own; a text of fewer than five words is one shingle; a null doc_id
names a class only if no other id can; repeated rows are one document; an empty table gives an empty result. Very long
texts go in blocks of their own; their shingles are held once in a task. Columns besides those that an operator names
are not read by it, or are handed on as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, blocks, cut_lineage, mix64, ship_package, table
from .graph import components

WORD = re.compile(r"\w+")
SHINGLE = 5
REGISTERS, ROWS, BANDS = 128, 5, 25
STEP = np.uint64(0x9E3779B97F4A7C15)


def row_keys(documents: DataFrame) -> DataFrame:
    """documents' doc_id and text with a 128-bit key of both, which is never null."""
    return documents.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2")
    )


class Shingler:
    """Distinct shingle hashes and counts of texts, block by block."""

    def __init__(self):
        self.words = WordTable(lambda new: [np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in new), np.uint64, len(new))])

    def __call__(self, texts) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        split = [WORD.findall(t.lower()) for t in texts]
        ids = self.words.numbers(split)
        out, at = [], 0
        for words in split:
            own = self.words.values[0][ids[at : at + len(words)]] if words else np.zeros(0, np.uint64)
            at += len(words)
            n = max(len(own) - SHINGLE + 1, 1) if len(own) else 0
            h = np.full(n, len(own) if len(own) < SHINGLE else SHINGLE, np.uint64)
            for k in range(min(SHINGLE, len(own))):
                h = mix64((h + own[k : k + n]) * STEP)
            shingles, counts = np.unique(h, return_counts=True)
            out.append((words, shingles, counts))
        return out


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash registers (documents x REGISTERS) of (shingles, counts) lists that are not empty."""
    sizes = [len(s) for s, _ in docs]
    element = np.concatenate([s for s, _ in docs])
    rate = np.concatenate([weights_of(c) for _, c in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    first = np.full(len(docs) * REGISTERS, np.inf)
    kept = np.zeros(len(docs) * REGISTERS, np.uint64)
    time, draw = np.zeros(len(element)), element.copy()
    while len(element):
        draw = mix64(draw + STEP)
        time = time - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / (1 << 53)) / rate
        at = doc * REGISTERS + (mix64(draw ^ STEP) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        kept[at[won]] = element[won]
        going = time < first.reshape(-1, REGISTERS).max(axis=1)[doc]
        element, rate, doc, time, draw = element[going], rate[going], doc[going], time[going], draw[going]
    return kept.reshape(-1, REGISTERS)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
    for k in range(ROWS):
        bands = mix64((bands + registers[:, k : ROWS * BANDS : ROWS]) * STEP)
    return bands


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its node (a 128-bit hash of its words), band hashes, and a byte of each register; all null without words.

    Where a shingle repeats, the bands and registers with all weights 1 follow.
    """
    shingler = Shingler()
    for ids, k1, k2, texts in blocks(batches, 3_000_000):
        shingled = shingler(texts)
        found = [(i, *x) for i, x in enumerate(shingled) if x[0]]
        wordless = [i for i, x in enumerate(shingled) if not x[0]]
        if wordless:
            keys = [pa.array([c[i] for i in wordless], pa.int64()) for c in (ids, k1, k2)]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.nulls(len(wordless), t) for t in (pa.binary(), pa.list_(pa.int64()), pa.binary()))], ["doc_id", "k1", "k2", "node", "bands", "registers"])
        if not found:
            continue
        nodes = [xxhash.xxh3_128_digest(" ".join(words).encode()) for _, words, _, _ in found]
        registers = signatures([(s, c) for _, _, s, c in found])
        uneven = [k for k, (_, _, _, c) in enumerate(found) if c.max() > 1]
        keys = list(band_hashes(registers))
        small = [r.tobytes() for r in (registers & np.uint64(255)).astype(np.uint8)]
        if uneven:
            plain = signatures([(found[k][2], np.ones(len(found[k][2]))) for k in uneven])
            for k, own, small_own in zip(uneven, band_hashes(plain), (plain & np.uint64(255)).astype(np.uint8), strict=True):
                keys[k] = np.unique(np.concatenate([keys[k], own]))
                small[k] += small_own.tobytes()
        ends = np.cumsum([0, *map(len, keys)])
        own = [i for i, *_ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c[i] for i in own], pa.int64()) for c in (ids, k1, k2)]
            + [pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64))), pa.array(small, pa.binary())],
            ["doc_id", "k1", "k2", "node", "bands", "registers"],
        )


FEATURES = "doc_id long, k1 long, k2 long, node binary, bands array<long>, registers binary"


def grouped_rows(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Tables of whole groups from batches sorted by their first n_keys columns, many small groups to a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(n_keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(change):
            yield pa.Table.from_batches([*held, batch.slice(0, change[-1])]).combine_chunks()
            held = [batch.slice(change[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(rows: pa.Table, n_keys: int) -> np.ndarray:
    keys = [rows.column(i).to_numpy() for i in range(n_keys)]
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return np.concatenate([[0], change, [rows.num_rows]])


EDGES = "a binary, b binary"


def edge_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])


def cloud_finder(least_agreeing: int):
    """From bucket blocks (key, lo, hi, node, registers): edges from each node to the first of its cloud."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, 3):
            bounds = group_bounds(rows, 3)
            nodes = rows.column(3).to_pylist()
            kept = rows.column(4).to_pylist()
            both = [np.frombuffer(b"".join(r[:REGISTERS] for r in kept), np.uint8).reshape(-1, REGISTERS)]
            if any(len(r) > REGISTERS for r in kept):
                both.append(np.frombuffer(b"".join(r[-REGISTERS:] for r in kept), np.uint8).reshape(-1, REGISTERS))
            starts, sizes = bounds[:-1], np.diff(bounds)
            two = starts[sizes == 2]
            alike = np.any([(r[two] == r[two + 1]).sum(axis=1) >= least_agreeing for r in both], axis=0)
            pairs = {tuple(sorted((nodes[i], nodes[i + 1]))) for i in two[alike].tolist()}
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = [r[start : start + size] for r in both]
                root = np.arange(size)
                for i in range(size - 1):
                    rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                    if len(rest):
                        near = rest[np.any([(r[rest] == r[i]).sum(axis=1) >= least_agreeing for r in own], axis=0)]
                        if len(near):
                            roots = np.unique(np.append(root[near], root[i]))
                            root[np.isin(root, roots)] = roots[0]
                pairs.update(tuple(sorted((nodes[start + r], nodes[start + i]))) for i, r in enumerate(root.tolist()) if r != i)
            if pairs:
                yield edge_batch(list(pairs))

    return run


def probability_jaccard(a: dict, b: dict) -> float:
    """The chance that two weighted sets pick the same element: a sum over shared d of 1 / sum over e of max(ae/ad, be/bd).

    With the shared elements sorted by a's weight over b's, each inner sum splits at d into two running sums.
    """
    shared = sorted((k for k in a if k in b), key=lambda k: a[k] / b[k])
    if not shared:
        return 0.0
    only_a, only_b = sum(v for k, v in a.items() if k not in b), sum(v for k, v in b.items() if k not in a)
    wa, wb = np.array([a[k] for k in shared]), np.array([b[k] for k in shared])
    # e with ae/be at least ad/bd count by a's weight over ad, the others by b's over bd
    from_a = np.cumsum(wa[::-1])[::-1] + only_a
    from_b = np.concatenate([[0], np.cumsum(wb)[:-1]]) + only_b
    return float((1 / (from_a / wa + from_b / wb)).sum())


def linker(threshold: float):
    """From cloud blocks (cloud, lo, hi, node, text): edges from each node to the first that it is connected with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for rows in grouped_rows(batches, 3):
            bounds = group_bounds(rows, 3)
            pairs: list[tuple[bytes, bytes]] = []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                nodes = rows.column(3).slice(start, stop - start).to_pylist()
                docs = []
                for lo in range(start, stop, 100):
                    docs += [(s, c) for _, s, c in shingler(rows.column(4).slice(lo, min(100, stop - lo)).to_pylist())]
                sizes = np.array([len(s) for s, _ in docs])
                ends = np.cumsum(sizes)
                number = np.unique(np.concatenate([s for s, _ in docs]), return_inverse=True)[1]
                uneven = np.array([c.max() > 1 for _, c in docs])
                weights = [weights_of(c) for _, c in docs]
                shares = np.concatenate([w / w.sum() for w in weights])
                mark, share = np.zeros(number.max() + 1, np.int64), np.zeros(number.max() + 1)
                root = np.arange(len(docs))
                for i in range(len(docs) - 1):
                    rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                    if not len(rest):
                        continue
                    own = number[ends[i] - sizes[i] : ends[i]]
                    mark[own] = 1
                    seen = np.concatenate([[0], np.cumsum(mark[number[ends[i] :]])])
                    common = (seen[ends[i + 1 :] - ends[i]] - seen[ends[i + 1 :] - sizes[i + 1 :] - ends[i]])[rest - i - 1]
                    mark[own] = 0
                    similar = common / (sizes[rest] + sizes[i] - common)
                    linked = rest[similar >= threshold].tolist()
                    weighted = (similar < threshold) & (common > 0) & (uneven[rest] | uneven[i])
                    if weighted.any():
                        # no pair is more similar than what its weights, each as a share of its text's, have in common
                        share[own] = shares[ends[i] - sizes[i] : ends[i]]
                        both = np.concatenate([[0], np.cumsum(np.minimum(share[number[ends[i] :]], shares[ends[i] :]))])
                        share[own] = 0
                        most = (both[ends[i + 1 :] - ends[i]] - both[ends[i + 1 :] - sizes[i + 1 :] - ends[i]])[rest - i - 1]
                        for j in rest[weighted & (most > threshold - 1e-9)].tolist():
                            a, b = (dict(zip(docs[k][0].tolist(), weights_of(docs[k][1]).tolist(), strict=True)) for k in (i, j))
                            if probability_jaccard(a, b) >= threshold:
                                linked.append(j)
                    if linked:
                        roots = np.unique(np.append(root[linked], root[i]))
                        root[np.isin(root, roots)] = roots[0]
                pairs += [(nodes[r], nodes[i]) for i, r in enumerate(root.tolist()) if r != i]
            if pairs:
                yield edge_batch(pairs)

    return run


def spread(rows: DataFrame) -> DataFrame:
    """Blocks whole and in order within the partitions."""
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")


def connected(sizes: DataFrame, members: DataFrame, finder, block: int, representatives: int = 32) -> DataFrame:
    """node and label of what finder() connects in groups; sizes has key and n of each group, members key, node and one more."""
    columns = ["key", "lo", "hi", *members.columns[1:]]
    place = lambda cuts: F.pmod(F.xxhash64("node"), cuts).cast("int")
    until = lambda n: F.sequence(F.lit(0), n - 1)
    rows = members.join(sizes, "key").withColumn("cuts", F.ceil(F.col("n") / block).cast("int"))
    # about this many of a group are compared with every block; there is one in most groups
    chosen = F.pmod(F.xxhash64("node", F.lit("representative")), F.col("n")) < representatives
    sent = F.explode(F.when(chosen, until(F.col("cuts"))).otherwise(F.array(place(F.col("cuts")))))
    edges = spread(rows.withColumn("lo", sent).withColumn("hi", F.col("lo")).select(columns)).mapInArrow(finder, EDGES).distinct()
    large = sizes.filter(F.col("n") > block)
    if large.isEmpty():
        return components(edges)
    edges = cut_lineage(edges)
    labels = components(edges)
    labelled = members.join(large, "key").select("key", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = cut_lineage(labelled)
    largest = labelled.groupBy("key", "label").agg(F.count("*").alias("size"), F.max("n").alias("n")).groupBy("key").agg(F.max("n").alias("n"), F.max(F.struct("size", "label")).alias("largest"))
    # a group that is one component is done
    cuts = largest.filter(F.col("largest.size") < F.col("n")).select(
        "key", F.col("largest.label").alias("inner"), F.ceil((F.col("n") - F.col("largest.size")) / block).cast("int").alias("outer_cuts"), F.ceil(F.col("largest.size") / block).cast("int").alias("inner_cuts")
    )
    sides = labelled.drop("n").join(cuts, "key").withColumn("is_inner", F.col("label") == F.col("inner")).drop("label", "inner")
    # the blocks outside the largest component are numbered first, and everything is compared with them
    own = F.when(F.col("is_inner"), F.col("outer_cuts") + place(F.col("inner_cuts"))).otherwise(place(F.col("outer_cuts")))
    other = F.explode(until(F.when(F.col("is_inner"), F.col("outer_cuts")).otherwise(F.col("outer_cuts") + F.col("inner_cuts"))))
    rest = members.join(sides, ["key", "node"]).withColumn("own", own).withColumn("other", other)
    rest = rest.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(columns)
    return components(edges.unionByName(spread(rest).mapInArrow(finder, EDGES)).distinct())


def near_duplicates(documents: DataFrame, *, threshold: float = 0.8, block: int = 1000) -> DataFrame:
    """A row for each document row: doc_id, k1, k2 (its key), class_id, is_first (the class's own document)."""
    ship_package(documents.sparkSession)
    docs = row_keys(documents)
    features = cut_lineage(docs.mapInArrow(featured_columns, FEATURES))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    # texts with the same words have the same bands and registers
    nodes = cut_lineage(features.filter("node is not null").groupBy("node").agg(F.min(order).alias("first"), F.min("bands").alias("bands"), F.min("registers").alias("registers")))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = banded.join(shared.select("key"), "key").join(nodes.select("node", "registers"), "node").select("key", "node", "registers")
    least = int(REGISTERS * (threshold - 4 * sqrt(threshold * (1 - threshold) / REGISTERS)))
    clouds = connected(shared, members, cloud_finder(least), block).withColumn("key", F.xxhash64("label"))  # node, label
    first = nodes.select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"))
    texts = clouds.join(first, "node").join(docs.select("k1", "k2", "text"), ["k1", "k2"]).select("key", "node", "text")
    classes = connected(clouds.groupBy("key").agg(F.count("*").alias("n")), texts, linker(threshold), block)
    of_node = nodes.select("node", "first").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = of_node.join(of_node.groupBy("label").agg(F.min("first").alias("class_first")), "label").select("node", "class_first")
    found = features.select("doc_id", "k1", "k2", "node").join(named, "node")
    is_first = (F.col("k1") == F.col("class_first.k1")) & (F.col("k2") == F.col("class_first.k2"))
    with_words = found.select("doc_id", "k1", "k2", F.col("class_first.doc_id").alias("class_id"), is_first.alias("is_first"))
    wordless = features.filter("node is null").select("doc_id", "k1", "k2", F.col("doc_id").alias("class_id"), F.lit(True).alias("is_first"))
    return with_words.unionByName(wordless)


def featured_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """featured() on batches of (doc_id, text, k1, k2)."""
    return featured(pa.RecordBatch.from_arrays([b.column(i) for i in (0, 2, 3, 1)], ["doc_id", "k1", "k2", "text"]) for b in batches)


def without_near_duplicates(documents: DataFrame, **settings) -> DataFrame:
    """The documents, with all their columns, one of each class: that of the smallest doc_id."""
    keep = near_duplicates(documents, **settings).filter("is_first").select("k1", "k2").distinct()
    keyed = documents.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("k2"))
    return keyed.join(keep, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")


def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")
