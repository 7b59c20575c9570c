"""Language ID: one interpolated Kneser-Ney character model for each language, in sorted hash arrays.

Learning counts five-character grams of words (letters only, lower case, padded at both ends) in Spark, for every
document. Counts of the lower orders, contexts and interpolated probabilities are aggregations and joins, an order at a
time, over all grams and all languages; the driver gets a few numbers for each language. The language with the lowest
cross-entropy per character wins. Its entropy is held against a band calibrated on documents of that language that the
model was not fitted to: beyond it a text is ``rejected``, as no learnt language fits it.

The result is a table of every gram of the corpus with a log-probability for each language. Its most frequent grams are
broadcast as a sorted hash array; a document's other grams are joined with the table. How many are broadcast changes no
result: log-probabilities are integers (in units of 1 / SCALE), so their sums do not depend on the order.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be
learnt; a null lang is not learnt from, a null doc_id counts as held out; ties go to the first language in order;
repeated rows are predicted alike; an empty table gives an empty result. Very long texts are scored word by word, each
word once, and count with all their words. Columns besides those that an operator names are not read by it, or are
handed on as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, blocks, cut_lineage, mix64, ship_package, table

ORDER = 5
START, END = 1, 2  # code points that no text has as letters
PRIME = np.uint64(0x9E3779B97F4A7C15)
SCALE = 1 << 24


def letter_runs(word: bytes) -> list[str]:
    text = word.decode().lower()
    return [text] if text.isalpha() else "".join(c if c.isalpha() else " " for c in text).split()


def positions(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter and end of the runs the ORDER code points that end there (a row each), and its run's number."""
    pad = chr(START) * (ORDER - 1)
    flat = np.frombuffer((pad + (chr(END) + pad).join(runs) + chr(END)).encode("utf-32-le"), np.uint32)
    grams = np.lib.stride_tricks.sliding_window_view(flat, ORDER)
    real = flat[ORDER - 1 :] != START
    sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
    return grams[real], np.repeat(np.arange(len(runs)), sizes)


def gram_hash(grams: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the last ``order`` code points of each row."""
    h = np.full(len(grams), order, np.uint64)
    for k in range(grams.shape[1] - order, grams.shape[1]):
        h = (h ^ grams[:, k].astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return mix64(h)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, is_fit, gram, n); words are counted first, so that each distinct one is cut up once."""
    seen: dict[tuple, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, is_fit), counter in seen.items():
            runs, weights = [], []
            for word, n in counter.items():
                for run in letter_runs(word):
                    runs.append(run)
                    weights.append(n)
            if runs:
                grams, owner = positions(runs)
                _, first, inverse = np.unique(gram_hash(grams, ORDER), return_index=True, return_inverse=True)
                n = np.bincount(inverse, np.asarray(weights, np.float64)[owner], len(first)).astype(np.int64)
                texts = pa.array([g.tobytes().decode("utf-32-le") for g in np.ascontiguousarray(grams[first])])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array([is_fit] * len(first)), texts, pa.array(n)], ["lang", "is_fit", "gram", "n"])
        seen.clear()

    for langs, fits, texts in blocks(batches, 3_000_000):
        for lang, is_fit, text in zip(langs, fits, texts, strict=True):
            seen.setdefault((lang, is_fit), Counter()).update(text.encode().split())
        if sum(map(len, seen.values())) > 300_000:
            yield from flush()
    yield from flush()


def dense(column: pa.ListArray, width: int, *fields: str) -> list[np.ndarray]:
    """Matrices (rows x width) of the fields of lists of structs, placed by their number; no list and -1 leave zeros."""
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    inner = column.flatten()
    number = inner.field("number").to_numpy(zero_copy_only=False)
    known = number >= 0
    out = [np.zeros((len(column), width), np.float64 if f != "total_logp" else np.int64) for f in fields]
    for matrix, f in zip(out, fields, strict=True):
        matrix[row[known], number[known]] = inner.field(f).to_numpy(zero_copy_only=False)[known]
    return out


def lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, 1_000_000 // max(width, 1))
    for batch in batches:
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def interpolation(discounts: np.ndarray, alphabet: int, is_last: bool):
    """From (gram, n, own, contexts, below) the probability of each gram's last letter in each language."""
    width = len(discounts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width):
            (times,) = dense(batch.column("own"), width, "times")
            total, kinds = dense(batch.column("contexts"), width, "total", "kinds")
            back = np.where(total > 0, discounts * kinds / np.maximum(total, 1), 1.0)
            below = batch.column("below").flatten().to_numpy().reshape(-1, width) if "below" in batch.schema.names else 1 / alphabet
            p = np.maximum(times - discounts, 0) / np.maximum(total, 1) + back * below
            if is_last:
                p = np.rint(np.log(np.maximum(p, 1e-50)) * SCALE).astype(np.int32)  # down to what 32 bits take
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("n"), lists(p)], ["gram", "n", "p"])

    return run


def gram_table(counts: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The languages in order, and for every gram: gram, n (its occurrences), p (a log-probability for each language).

    counts has lang (null: not learnt from), gram, n and fit_n; a language with no fit_n at all is learnt from its n.
    """
    spark = counts.sparkSession
    counts = cut_lineage(counts)
    found = sorted((r.lang, r.fit_n > 0) for r in counts.filter("lang is not null").groupBy("lang").agg(F.sum("fit_n").alias("fit_n")).collect())
    langs = [k for k, _ in found]
    if not langs:
        return [], None
    numbered = spark.createDataFrame([(k, i, fit) for i, (k, fit) in enumerate(found)], "lang string, number int, has_fit boolean")
    raw = F.coalesce(F.when(F.col("has_fit"), F.col("fit_n")).otherwise(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0))
    rows = counts.join(numbered, "lang", "left").select("gram", "n", "number", raw.alias("raw"))
    # number -1: occurrences that nothing is learnt from, whose grams need probabilities as well
    rows = rows.withColumn("number", F.when(F.col("raw") > 0, F.col("number")).otherwise(-1))
    levels = {ORDER: cut_lineage(rows.groupBy("gram", "number").agg(F.sum("raw").alias("raw"), F.sum("n").alias("n"), F.lit(0).cast("long").alias("before")))}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, order).alias("gram")
        levels[order] = cut_lineage(levels[order + 1].groupBy(shorter, "number").agg(F.sum("raw").alias("raw"), F.sum("n").alias("n"), F.count("*").alias("before")))
    # what has no letter before it is counted as it occurs, other grams by the letters before them
    times: dict[int, Column] = {o: F.when(F.col("gram").startswith(chr(START)) | F.lit(o == ORDER), F.col("raw")).otherwise(F.col("before")) for o in levels}
    learnt = {o: level.filter("number >= 0").select("gram", "number", times[o].alias("times")) for o, level in levels.items()}
    discounts = {o: np.full(len(langs), 0.5) for o in levels}
    rare = [learnt[o].groupBy("number").agg(F.lit(o).alias("o"), F.count_if(F.col("times") == 1).alias("ones"), F.count_if(F.col("times") == 2).alias("twos")) for o in levels]
    for part in rare:
        for r in part.collect():
            if r.ones + r.twos:
                discounts[r.o][r.number] = min(0.95, max(0.1, r.ones / (r.ones + 2 * r.twos)))
    alphabet = learnt[1].select("gram").distinct().count() + 1
    below = None
    for order in range(1, ORDER + 1):
        own = levels[order].withColumn("times", times[order]).groupBy("gram").agg(F.sum("n").alias("n"), F.collect_list(F.struct("number", "times")).alias("own"))
        contexts = learnt[order].groupBy(F.substring("gram", 1, order - 1).alias("context"), "number").agg(F.sum("times").alias("total"), F.count("*").alias("kinds"))
        contexts = contexts.groupBy("context").agg(F.collect_list(F.struct("number", "total", "kinds")).alias("contexts"))
        joined = own.withColumn("context", F.substring("gram", 1, order - 1)).join(contexts, "context", "left")
        columns = ["gram", "n", "own", "contexts"]
        if below is not None:
            joined = joined.withColumn("suffix", F.substring("gram", 2, order - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
            columns.append("below")
        is_last = order == ORDER
        below = cut_lineage(joined.select(columns).mapInArrow(interpolation(discounts[order], alphabet, is_last), f"gram string, n long, p array<{'int' if is_last else 'double'}>"))
    return langs, below


def frequent(grams: DataFrame, most: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and log-probabilities of the ``most`` most frequent grams."""
    found = grams.orderBy(F.col("n").desc(), "gram").limit(most).select("gram", "p").toArrow().combine_chunks()
    rows = np.frombuffer("".join(found.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    logp = pc.list_flatten(found.column("p")).to_numpy().astype(np.int32).reshape(-1, width)
    hashes, first = np.unique(gram_hash(rows, ORDER), return_index=True)
    return hashes, logp[first]


PARTS = "row long, doc_id long, held_out boolean, lang string, n_letters long, common array<long>, others array<struct<gram:string,n:long>>"


def summing(shared, width: int):
    """Of each document the sums over the grams that are broadcast, and the other grams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, logp = shared.value

        def derive(words: list[bytes]) -> list[np.ndarray]:
            cut = [letter_runs(w) for w in words]
            runs = [r for rs in cut for r in rs]
            sums, sizes, others = np.zeros((len(words), width), np.int64), np.zeros(len(words), np.int64), np.empty(len(words), object)
            if runs and width:
                grams, owner = positions(runs)
                word = np.repeat(np.arange(len(words)), [len(rs) for rs in cut])[owner]
                sizes = np.bincount(word, minlength=len(words))
                h = gram_hash(grams, ORDER)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                for i in range(width):
                    sums[:, i] = np.bincount(word[hit], logp[at[hit], i], len(words))  # far below 2 ** 53, so exact
                for w, g in zip(word[~hit].tolist(), np.ascontiguousarray(grams[~hit]), strict=True):
                    if others[w] is None:
                        others[w] = []
                    others[w].append(g.tobytes().decode("utf-32-le"))
            return [sums, sizes, others, np.array([o is not None for o in others], bool)]

        words = WordTable(derive)
        row = TaskContext.get().partitionId() << 40
        for doc_ids, held_out, langs, texts in blocks(batches, 3_000_000):
            split = [t.encode().split() for t in texts]
            ids = words.numbers(split)
            sums, sizes, others, at = np.zeros((len(texts), width), np.int64), [], [], 0
            for k, s in enumerate(split):
                own = ids[at : at + len(s)]
                at += len(s)
                sizes.append(int(words.values[1][own].sum()) if len(own) else 0)
                rest: Counter = Counter()
                if len(own):
                    sums[k] = words.values[0][own].sum(axis=0)
                    for i in own[words.values[3][own]].tolist():
                        rest.update(words.values[2][i])
                others.append([{"gram": g, "n": n} for g, n in rest.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), pa.array(doc_ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), lists(sums)]
                + [pa.array(others, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))],
                ["row", "doc_id", "held_out", "lang", "n_letters", "common", "others"],
            )
            row += len(texts)

    return run


def deciding(langs: list[str]):
    """From a document's sums over both kinds of grams: the best language."""
    width = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, "und"], object)
        for batch in slices(batches, width):
            size = batch.column("n_letters").to_numpy()
            real = (size > 0) & (width > 0)
            best, score, entropy = np.full(len(size), width), np.zeros(len(size)), np.full(len(size), np.nan)
            if real.any():
                sums = batch.column("common").flatten().to_numpy().reshape(-1, width) + dense(batch.column("rest"), width, "total_logp")[0]
                entropies = -sums[real] / SCALE / size[real, None]
                best[real] = entropies.argmin(axis=1)
                entropy[real] = entropies.min(axis=1)
                # the posterior of as many characters as are likely to be independent evidence
                score[real] = 1 / np.exp(-(entropies - entropy[real, None]) * np.minimum(size[real], 40)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "held_out", "lang")] + [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(entropy, mask=~real)],
                ["doc_id", "held_out", "lang", "lang_pred", "score", "cross_entropy"],
            )

    return run


def language_id(documents: DataFrame, *, held_out=None, width: float = 6.0, least_calibration: int = 8, most_broadcast: int = 8_000_000) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    ``held_out`` is a column of documents that are never learnt from; by default crc32(doc_id) mod 4 = 2.
    ``most_broadcast`` bounds the log-probabilities that are broadcast; it changes no result.
    """
    ship_package(documents.sparkSession)
    if held_out is None:
        held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    docs = documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("lang").cast("string"), F.coalesce("text", F.lit("")).alias("text"))
    # a quarter of what may be learnt from is kept apart to calibrate the rejection on texts that the models haven't seen
    is_fit = F.shiftright(F.crc32(F.col("doc_id").cast("string")), 2) % 4 != 0
    learnable = F.when(~F.col("held_out"), F.col("lang"))
    counts = docs.select(learnable.alias("lang"), (is_fit & learnable.isNotNull()).alias("is_fit"), "text").mapInArrow(count_grams, "lang string, is_fit boolean, gram string, n long")
    langs, grams = gram_table(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_fit"), F.col("n")).otherwise(0)).alias("fit_n")))
    common = frequent(grams, min(500_000, most_broadcast // len(langs)), len(langs)) if langs else (np.zeros(0, np.uint64), np.zeros((0, 0), np.int32))
    parts = cut_lineage(docs.mapInArrow(summing(documents.sparkSession.sparkContext.broadcast(common), len(langs)), PARTS))
    rest = parts.select("row", F.explode("others").alias("o")).select("row", "o.gram", "o.n")
    rest = rest.join(grams.select("gram", "p"), "gram") if langs else rest.withColumn("p", F.array().cast("array<int>"))
    rest = rest.select("row", "n", F.posexplode("p").alias("number", "logp")).groupBy("row", "number").agg(F.sum(F.col("logp") * F.col("n")).alias("total_logp"))
    rest = rest.groupBy("row").agg(F.collect_list(F.struct("number", "total_logp")).alias("rest"))
    joined = parts.drop("others").join(rest, "row", "left")
    scored = cut_lineage(joined.mapInArrow(deciding(langs), "doc_id long, held_out boolean, lang string, lang_pred string, score double, cross_entropy double"))
    spread = lambda c: F.percentile_approx(F.when(c, F.col("cross_entropy")), F.array(F.lit(0.5), F.lit(0.75)), 10_000)
    calibrated = (
        scored.filter(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")) & F.col("cross_entropy").isNotNull())
        .groupBy("lang_pred")
        .agg(F.count_if(~is_fit).alias("apart"), spread(~is_fit).alias("unseen"), spread(F.lit(True)).alias("all"))
        .withColumn("at", F.when(F.col("apart") >= least_calibration, F.col("unseen")).otherwise(F.col("all")))
        .select("lang_pred", (F.col("at")[0] + F.greatest(width * 1.4826 * (F.col("at")[1] - F.col("at")[0]), F.lit(0.15))).alias("most"))
    )
    # one row for each learnt language
    out = scored.join(F.broadcast(calibrated), "lang_pred", "left")
    return out.withColumn("rejected", F.coalesce(F.col("cross_entropy") > F.col("most"), F.lit(True))).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op3_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
