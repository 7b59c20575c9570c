"""Repeated windows against a plain count of all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import DOCUMENTS, corpus, sentence

from lanternlog.llm import substring_dedup as sd
from lanternlog.llm.substring_dedup import WINDOW, substring_dedup


def plain(rows):
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    seen = Counter(tuple(w[k : k + WINDOW]) for _, w in docs for k in range(len(w) - WINDOW + 1))
    out = Counter()
    for i, w in docs:
        gone = set()
        for k in range(len(w) - WINDOW + 1):
            if seen[tuple(w[k : k + WINDOW])] > 1:
                gone.update(range(k, k + WINDOW))
        spans = [(k, next(j for j in range(k, len(w) + 1) if j not in gone)) for k in sorted(gone) if k - 1 not in gone]
        out[i, len(w), len(gone), tuple(spans), b" ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    return out


def got(df, **sizes):
    return Counter((r.doc_id, r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in substring_dedup(df, **sizes).collect())


def planted():
    """Passages at other places, with other white space, in one document twice, of a short period, and just too short."""
    rng = random.Random(11)
    passage = sentence(rng, 90).split(" ")
    rows = [(200, " ".join([*sentence(rng, 40).split(" "), *passage, *sentence(rng, 7).split(" ")]))]
    rows += [(201, "\t".join([*passage[10:60], "end"])), (202, "\n".join([*passage[20:54], "x"])), (203, " ".join([*passage[55:], *sentence(rng, 20).split(" "), *passage[55:]]))]
    period = sentence(rng, 10).split(" ")
    rows += [(204, " ".join(period * 5)), (205, " ".join((period * 5)[:45])), (206, " ".join((period * 5)[:44])), (207, " ".join(["la"] * 34)), (208, " ".join(["lo"] * 35)), (209, " ".join(["li"] * 36))]
    rows += [(300 + k, " ".join([*sentence(rng, 30).split(" "), *passage[:50], *sentence(rng, 30).split(" ")])) for k in range(30)]  # one passage, other surroundings
    return [(i, t, "en", "s", len(t)) for i, t in rows]


@pytest.mark.parametrize("sizes", [{}, {"most_runs": 3, "most_words": 400, "most_leaves": 20}, {"most_known": 2, "most_words": 1, "most_leaves": 1}])
def test_windows_equal_a_plain_count(spark, sizes):
    rows = corpus() + planted()
    want = plain(rows)
    assert got(spark.createDataFrame(rows, DOCUMENTS).repartition(6), **sizes) == want
    assert sum(n for (*_, spans, _), n in want.items() if spans) > 60


def test_clashing_empty_and_long(spark, docs, clashing, empty):
    assert got(clashing) == got(docs) and not got(empty)
    rng = random.Random(12)
    prose = sentence(rng, 60_000)
    rows = [(1, prose), (2, "start " + " ".join(prose.split(" ")[30_000:30_100]) + " end"), (3, "same " * 100_000), (None, None)]
    out = {r.doc_id: (r.n_removed, [tuple(s) for s in r.spans]) for r in substring_dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)).collect()}
    assert out == {1: (100, [(30_000, 30_100)]), 2: (100, [(1, 101)]), 3: (100_000, [(0, 100_000)]), None: (0, [])}


def test_subtrees_of_random_words():
    rng = np.random.default_rng(13)
    for most in (1, 7, 1000):
        runs = sorted({b" ".join(b"%d" % x for x in (np.repeat(rng.integers(0, 2, 20), 5)[: rng.integers(WINDOW, 90)])) for _ in range(60)})
        several = rng.random(len(runs)) < 0.1
        repeats, n_starts = sd.repeated_starts(runs, several, most)
        seen = Counter()
        for r, s in zip(runs, several, strict=True):
            w = r.split()
            seen.update([tuple(w[k : k + WINDOW]) for k in range(len(w) - WINDOW + 1)] * (1 + s))
        want = [seen[tuple(r.split()[k : k + WINDOW])] > 1 for r in runs for k in range(len(r.split()) - WINDOW + 1)]
        assert repeats.tolist() == want and n_starts.tolist() == [len(r.split()) - WINDOW + 1 for r in runs]


def test_common_prefixes_are_exact():
    rng = np.random.default_rng(14)
    words = rng.integers(1, 3, 500).astype(np.int64)
    words[250:300] = words[20:70]
    ranks = sd.prefix_ranks(words)
    a, b = np.meshgrid(np.arange(0, 460, 3), np.arange(200, 460, 5))
    a, b = a.ravel(), b.ravel()
    plainly = [next((k for k in range(WINDOW) if words[x + k] != words[y + k]), WINDOW) for x, y in zip(a, b, strict=True)]
    assert sd.common_prefixes(a, b, ranks).tolist() == plainly
