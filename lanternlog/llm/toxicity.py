"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it.

The models are logistic regressions with an L1 penalty over the words that a text has, so a text's length does not
weigh. A later category learns from out-of-fold probabilities of the earlier ones: each labelled row is scored by models
that did not see its fold, as an unlabelled row will be. Learning takes at most ``most_labelled`` labelled rows, chosen
by a hash of doc_id; as they and their words are bounded, each model is one task's work, and a category's models (one a
fold, and one of all rows) are learnt side by side. Scoring is one pass over all documents, without a shuffle.

Defined cases: a null or wordless text has no words and gets the models' base rates; labelled rows with a null label or
without a document are not learnt from; of labels of one document that conflict the larger of each category holds, so a
rerun learns the same; repeated documents are learnt from as often as they occur; without labelled rows of both kinds a
category's rate is the labels' mean (0 without labels); repeated rows are scored alike; an empty table gives an empty
result. Very long texts count by their distinct words. Columns besides those that an operator names are not read by it,
or are handed on as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ship_package, table

#: The categories in the order of the chain; labels has quality (1: good) and a column of its own for every other.
CATEGORIES = ("low_quality", "toxic")


def label_of(category: str) -> Column:
    return (F.lit(1) - F.col("quality") if category == "low_quality" else F.col(category)).cast("double")


def words() -> Column:
    """The distinct words of a text: runs of letters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))


class Rows:
    """A sparse matrix of zeros and ones with some dense columns after it, each scaled by its standard deviation."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, width: int, dense: np.ndarray):
        self.ids, self.n, self.width = ids, len(sizes), width
        self.row = np.repeat(np.arange(self.n), sizes)
        share = np.bincount(ids, minlength=width) / max(self.n, 1)
        spread = np.concatenate([np.sqrt(share * (1 - share)), dense.std(axis=0)])
        self.scale = np.divide(1, spread, out=np.zeros_like(spread), where=spread > 1e-12)  # a constant column tells nothing
        self.dense = dense * self.scale[width:]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, (w[: self.width] * self.scale[: self.width])[self.ids], self.n) + self.dense @ w[self.width :]

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.ids, r[self.row], self.width) * self.scale[: self.width], self.dense.T @ r])


def fitted(rows: Rows, label: np.ndarray, penalty: float, most_steps: int = 300, tolerance: float = 1e-7, memory: int = 10) -> tuple[np.ndarray, float]:
    """Weights of the rows' own columns and the intercept that minimise mean log loss + penalty * |scaled weights|.

    A quasi-Newton descent that keeps to one orthant in each step, where the penalty is linear (OWL-QN).
    """
    limit = np.append(np.full(rows.width + rows.dense.shape[1], penalty), 0.0)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = rows.times(x[:-1]) + x[-1]
        loss = np.logaddexp(0, margin) - label * margin
        residual = (1 / (1 + np.exp(-margin)) - label) / rows.n
        return float(loss.mean() + (limit * np.abs(x)).sum()), np.append(rows.transposed_times(residual), residual.sum())

    mean = label.mean()
    x = np.zeros(len(limit))
    x[-1] = np.log(mean / (1 - mean))
    now, slope = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    calm = 0
    for _ in range(most_steps):
        downhill = -np.where(x != 0, slope + limit * np.sign(x), np.sign(slope) * np.maximum(np.abs(slope) - limit, 0))
        direction, factors = downhill.copy(), []
        for s, y in reversed(steps):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(factors), strict=True):
            direction += (a - (y @ direction) / (s @ y)) * s
        direction[direction * downhill <= 0] = 0
        orthant = np.where(x != 0, np.sign(x), np.sign(downhill))
        size = 1.0 if steps else 1 / max(np.abs(direction).sum(), 1e-12)
        for _ in range(40):
            moved = x + size * direction
            moved[moved * orthant < 0] = 0
            then, slope_then = value(moved)
            if then <= now - 1e-4 * (downhill @ (moved - x)):
                break
            size /= 2
        else:
            break
        s, y = moved - x, slope_then - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        calm = calm + 1 if now - then <= tolerance * max(abs(now), 1e-12) else 0
        x, now, slope = moved, then, slope_then
        if calm == 3:
            break
    return x[:-1] * rows.scale, float(x[-1])


def probability(words_of: pa.ListArray, before: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Of rows with word numbers (null: not known) and earlier probabilities."""
    weights, intercept = model
    width = len(weights) - before.shape[1]
    row = np.repeat(np.arange(len(words_of)), pc.list_value_length(words_of).to_numpy(zero_copy_only=False))
    ids = pc.fill_null(words_of.flatten(), width).to_numpy(zero_copy_only=False)
    sums = np.bincount(row, np.append(weights[:width], 0.0)[ids], len(words_of)) + before @ weights[width:] + intercept
    return 1 / (1 + np.exp(-sums))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def learner(category: int, n_words: int, penalty: float):
    """The model of one group of rows (model, ids, labels, before), as a row: model, weights, intercept."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, before = (group.column(c).combine_chunks() for c in ("ids", "labels", "before"))
        label = labels.flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)[:, category]
        mean = float(label.mean())
        weights = np.zeros(n_words + category)
        if mean in (0.0, 1.0):  # all alike: the rate itself
            intercept = np.inf if mean else -np.inf
        else:
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            weights, intercept = fitted(Rows(ids.flatten().to_numpy(zero_copy_only=False), sizes, n_words, matrix(before, category)), label, penalty)
        return pa.table({"model": group.column("model").slice(0, 1), "weights": pa.array([weights]), "intercept": pa.array([intercept])})

    return run


def scored_by_fold(models: dict, category: int):
    """Each row's probability by the model that did not see its fold, after those it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, before = batch.column("fold").to_numpy(), matrix(batch.column("before"), category)
            p = np.zeros(len(fold))
            for f in np.unique(fold).tolist():
                own = np.flatnonzero(fold == f)
                # the model of all rows stands in where there is no other fold to learn from
                p[own] = probability(batch.column("ids").take(pa.array(own)), before[own], models.get(f, models[-1]))
            after = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * (category + 1), pa.int32()), pa.array(np.column_stack([before, p]).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fold", "ids", "labels")), after], ["fold", "ids", "labels", "before"])

    return run


class Chain:
    """The words that count, and a model (weights of words and earlier categories, intercept) for each category, in order."""

    def __init__(self, vocabulary: list[str], models: dict[str, tuple[np.ndarray, float]]):
        self.vocabulary, self.models = vocabulary, models

    def score(self, df: DataFrame) -> DataFrame:
        """doc_id and p_<category> for each category, of rows with doc_id and words."""
        shared = df.sparkSession.sparkContext.broadcast((self.vocabulary, list(self.models.values())))
        names = [f"p_{c}" for c in self.models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, models = shared.value
            known = pa.array(vocabulary, pa.string())
            for batch in batches:
                found = batch.column("words")
                numbers = pc.index_in(found.flatten(), known)
                ids = pa.ListArray.from_arrays(pc.subtract(found.offsets, found.offsets[0]), numbers)
                p = np.zeros((len(found), 0))
                for model in models:
                    p = np.column_stack([p, probability(ids, p, model)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, p.T)], ["doc_id", *names])

        return df.select(F.col("doc_id").cast("long"), "words").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in names)]))


TRAIN = "fold int, ids array<int>, labels array<double>, before array<double>"


def fit_chain(documents: DataFrame, labels: DataFrame, *, categories=CATEGORIES, most_labelled: int = 20_000, folds: int = 3, least_docs: int = 3, most_words: int = 1 << 17, penalty: float = 0.002) -> Chain:
    """Learn from at most ``most_labelled`` labelled rows, by the ``most_words`` most frequent words of ``least_docs`` of them at least."""
    ship_package(documents.sparkSession)
    usable = labels.select("doc_id", *(label_of(c).alias(f"is_{c}") for c in categories)).dropna()
    usable = usable.groupBy("doc_id").agg(F.array(*(F.max(f"is_{c}") for c in categories)).alias("labels"))
    # at most most_labelled rows of a few numbers, so the broadcast is bounded; documents are not moved
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).cast("int")
    train = cut_lineage(documents.select("doc_id", words().alias("words")).join(F.broadcast(chosen), "doc_id").select(fold.alias("fold"), "words", "labels"))
    n = train.count()
    if not n:
        return Chain([], {c: (np.zeros(i), -np.inf) for i, c in enumerate(categories)})
    counts = train.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = least_docs if n >= 10 * least_docs else 1
    vocabulary = [r.word for r in counts.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most_words).collect()]
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            found = batch.column("words")
            numbers = pc.index_in(found.flatten(), known)
            row = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            sizes = np.bincount(row[numbers.is_valid().to_numpy(zero_copy_only=False)], minlength=len(found))
            own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), numbers.drop_null())
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(found) + 1, np.int32)), pa.array([], pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("fold"), own, batch.column("labels"), none], ["fold", "ids", "labels", "before"])

    train = cut_lineage(train.mapInArrow(numbered, TRAIN))
    models = {}
    for i, category in enumerate(categories):
        is_last = i + 1 == len(categories)
        # -1 is the model of all rows, the others are those that leave a fold out
        groups = F.array(F.lit(-1)) if is_last else F.filter(F.array(F.lit(-1), *map(F.lit, range(folds))), lambda m: m != F.col("fold"))
        learnt = train.select(F.explode(groups).alias("model"), "ids", "labels", "before").groupBy("model").applyInArrow(learner(i, len(vocabulary), penalty), "model int, weights array<double>, intercept double")
        found = {r.model: (np.array(r.weights), r.intercept) for r in learnt.toLocalIterator()}
        models[category] = found[-1]
        if not is_last:
            train = cut_lineage(train.mapInArrow(scored_by_fold(found, i), TRAIN))
    return Chain(vocabulary, models)


def toxicity(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **settings) -> DataFrame:
    """Per document: doc_id, p_low_quality, p_toxic, and is_toxic where the last probability reaches the threshold."""
    chain = fit_chain(documents, labels, **settings)
    out = chain.score(documents.select("doc_id", words().alias("words")))
    return out.withColumn("is_toxic", F.col(f"p_{list(chain.models)[-1]}") >= threshold)


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
