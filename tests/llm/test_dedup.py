"""Line, suffix and near-duplicate removal against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import CLASHING

from lanternlog.llm import line_dedup, minhash, suffix_dedup
from lanternlog.llm.minhash import probability_jaccard

import corpus_pipeline



def rows_by_text(docs):
    return sorted({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def test_lines(docs):
    got = defaultdict(set)
    for r in line_dedup.line_dedup(docs).collect():
        got[r.doc_id, r.n_chars].add((r.text, r.n_lines, r.n_removed))
    # which of the rows with one id comes first is decided by a hash; ids here are unique but for 5 and null
    own = [(i, t) for i, t in rows_by_text(docs)]
    windows = defaultdict(list)
    for i, t in own:
        ls = t.split("\n") if t is not None else []
        for k in range(len(ls) - 2):
            windows[tuple(ls[k : k + 3])].append((i, t, k))
    for i, t in own:
        if i in (5, None):
            continue
        ls = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(ls) - 2):
            places = windows[tuple(ls[k : k + 3])]
            first = min(((-1 if a is None else a), c) for a, _, c in places)
            if (i, k) > first:
                gone |= {k, k + 1, k + 2}
        want = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
        assert got[i, None if t is None else len(t)] == {(want, len(ls), len(gone))}


def test_lines_keep_all_rows_and_other_columns(docs, clashing, empty):
    out = line_dedup.line_dedup(clashing)
    assert out.columns == [*(c for c in clashing.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"] and out.count() == docs.count()
    assert out.agg({"n_lines": "max"}).first()[0] > 100  # the operator's own, not the 1 that was there
    assert line_dedup.line_dedup(empty).count() == 0


def test_collection_index_is_the_sorted_list_of_suffixes(tmp_path):
    rng = random.Random(3)
    for turn in range(40):
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 9))]
        texts += texts[: turn % 3]  # copies are in the list like any other text
        files = suffix_dedup.ColumnFiles(f"file://{tmp_path}/{turn}", rng.choice([1, 2, 3, 7, 1000]))
        index = suffix_dedup.CollectionIndex(texts, files)
        # one round a column, each a pass from one pair of files to the other
        assert files.round == 1 + max(map(len, texts))
        assert sorted(p.name for p in next((tmp_path / str(turn)).iterdir()).iterdir()) == ["0.bwt", "0.lcp", "1.bwt", "1.lcp"]
        symbol, common = index.read()
        want = sorted(((t[len(t) - n :] + b"\0", i, n) for i, t in enumerate(texts) for n in range(len(t) + 1)), key=lambda x: (x[0], x[1]))
        got = sorted((p, i, n) for n, own, at in index.walk(symbol) for i, p in zip(own.tolist(), at.tolist(), strict=True))
        assert [(i, n) for _, i, n in got] == [(i, n) for _, i, n in want] and [p for p, _, _ in got] == list(range(len(want)))
        alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0), 0)
        assert common.tolist() == [0, *(alike(a[0], b[0]) for a, b in zip(want, want[1:], strict=False))]
        before = [texts[i][len(texts[i]) - n - 1] if n < len(texts[i]) else None for _, i, n in want]
        assert [x is None for x in before] == (symbol == 0).tolist()
        files.delete()
        assert not list((tmp_path / str(turn)).iterdir())


def suffix_want(rows):
    owner = {}
    for i, t in rows:
        key = -(2**63) if i is None else i
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            owner[s] = min(owner.get(s, key), key)
    want = Counter()
    for i, t in rows:
        key, b = -(2**63) if i is None else i, (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if owner[b[k : k + 50]] < key:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return want


def test_strings(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == suffix_want(rows)
    small = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.suffix_dedup(docs, most_pieces=30, chunk=100).collect())
    assert small == got
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def settled(texts, folder, most_pieces=20_000):
    """What settled_runs covers of texts with ids 0, 1, ... by document, and for each collection its runs and rounds."""
    keys, doc, start, count = suffix_dedup.runs_of(texts)
    runs = [texts[d][a : a + n + 49] for d, a, n in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True)]
    made, texts_in = [], []

    def new_files():
        made.append(suffix_dedup.ColumnFiles(f"file://{folder}", 1000))
        return made[-1]

    plain = suffix_dedup.CollectionIndex.__init__

    def noted(self, texts, files):
        texts_in.append(len(texts))
        plain(self, texts, files)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_dedup.CollectionIndex, "__init__", noted)
        ids, _, begin, end = suffix_dedup.settled_runs(keys, doc, np.zeros(len(doc), np.int32), start, runs, most_pieces, new_files)
    gone = [np.zeros(len(t), bool) for t in texts]
    for i, a, b in zip(ids.tolist(), begin.tolist(), end.tolist(), strict=True):
        gone[i][a:b] = True
    return [g.tolist() for g in gone], texts_in, [f.round for f in made], runs


def covered(texts):
    """The same by every string."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        out.append(gone.tolist())
    return out


def test_runs_that_only_share_a_phrase_are_in_no_collection(tmp_path):
    """A phrase of 30 bytes in other surroundings gives runs of one key, but no string of 50."""
    rng = random.Random(5)
    own = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    phrase, passage = own(30), own(90)
    apart = [own(60) + phrase + own(60) for _ in range(30)]
    gone, collected, _, runs = settled(apart, tmp_path)
    assert len({r for r in runs if phrase[5:25] in r}) >= 30 and not np.any(np.concatenate(gone))
    assert sum(collected) == 0
    alike = [*apart, own(60) + passage + own(60), own(60) + passage + own(60)]
    gone, collected, _, runs = settled(alike, tmp_path)
    assert gone == covered(alike) and np.sum(gone[-1]) == 90 and 0 < sum(collected) < 40
    # a run that two documents have goes through a collection too
    gone, collected, _, runs = settled([apart[0], apart[1], apart[0]], tmp_path)
    assert gone == covered([apart[0], apart[1], apart[0]]) and sum(collected) == len({*runs}) - len({*settled([apart[1]], tmp_path)[3]})


def test_common_strings_are_found_at_every_edge(tmp_path):
    rng = random.Random(6)
    for turn in range(60):
        own = lambda n: bytes(rng.choice(b"abcdefghijklmnop"[: 2 + turn % 13]) for _ in range(n))
        passage = own(120)
        texts = []
        for _ in range(12):  # 49 to 60 bytes of a passage, and repeated words, at the edges and inside
            a, n = rng.randint(0, 60), rng.randint(49, 60)
            texts.append(own(rng.choice([0, 1, 20, 40])) + passage[a : a + n] + own(rng.choice([0, 1, 20, 40])))
        word = own(rng.randint(1, 30))
        texts += [word * rng.randint(2, 20), own(10) + word * 9 + own(10), texts[0], texts[3] + texts[4]]
        rng.shuffle(texts)
        texts = [t for t in texts if len(t) >= 50]
        assert settled(texts, tmp_path, rng.choice([1, 5, 20_000]))[0] == covered(texts)


def test_short_runs_take_few_rounds(tmp_path):
    """Keys are in collections by their longest runs, so only one of these has as many rounds as the longest of all."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(4000)) for _ in range(2)]
    texts.append(texts[0])
    gone, collected, rounds, runs = settled(texts, tmp_path, most_pieces=50)
    assert gone == covered(texts)
    sizes = sorted(map(len, {r for r in runs if runs.count(r) > 1}))
    assert sum(collected) == len(sizes) and len(collected) > 3
    assert sorted(rounds) == rounds and rounds[0] < 60 < max(rounds) == 1 + sizes[-1]


def similar(a: Counter, b: Counter) -> bool:
    common = len(a.keys() & b.keys())
    if common / (len(a) + len(b) - common) >= 0.8:
        return True
    weigh = lambda c: {k: 1 + math.log(v) for k, v in c.items()}
    return probability_jaccard(weigh(a), weigh(b)) >= 0.8


def classes_want(rows):
    shingles = {}
    for i, t in rows:
        words = re.findall(r"\w+", (t or "").lower())
        if words:
            shingles[i, t] = Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1)))
    parent = {r: r for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(shingles, 2):
        if similar(shingles[a], shingles[b]):
            parent[find(a)] = find(b)
    out = defaultdict(set)
    for r in rows:
        out[find(r)].add(r)
    return len(out), {r: min((i for i, _ in out[find(r)] if i is not None), default=None) for r in rows}


def test_near_duplicates(docs, empty):
    rows = rows_by_text(docs)
    _, want = classes_want(rows)
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert set(got) == {(i, c) for (i, _), c in want.items()}
    assert sum(got.values()) == docs.count()
    assert minhash.near_duplicates(empty).count() == 0


def test_small_blocks_find_the_same_classes(docs):
    rows = lambda n: sorted((str(r.doc_id), str(r.class_id)) for r in minhash.near_duplicates(docs, block=n).collect())
    assert rows(2) == rows(1000) == rows(7)


def test_a_hot_group_keeps_every_link(spark):
    """A chain of texts, each like the next but not like those further on, between many copies with one word changed."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(150):
        own = list(words)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(12):  # each step changes seven words for good
        for k in range(7):
            words[i * 30 + 4 * k] = f"y{i}x{k}"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, " ".join(f"z{i}x{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = classes_want(rows)
    for block in (8, 60, 1000):
        assert {(r.doc_id, r.class_id) for r in minhash.near_duplicates(df, block=block).collect()} == {(i, c) for (i, _), c in want.items()}


def test_one_document_of_each_class_stays(docs, clashing):
    kept = minhash.without_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == classes_want(rows_by_text(docs))[0]


def test_every_text_is_a_row_whatever_its_words_are(spark):
    odd = ["\u2764\ufe0f", "\u200d", "\u203f", "\u0301", "\u00bd", "\u00b2", "\u2460", "", None, "plain"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(minhash.near_duplicates(df).select("doc_id", "class_id", "is_first").collect())
    assert out == [(i, i, True) for i in range(len(odd))]
    assert minhash.without_near_duplicates(df).count() == len(odd)


def test_copies_with_a_repeated_block_are_found(spark):
    rows = []
    for i, times in enumerate((5, 30, 5, 30, 2000)):
        words = [f"w{i}x{k}" for k in range(404)]
        block = [f"b{i}x{k}" for k in range(60)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(words + block * times))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert found == {i: i - i % 10 for i, _ in rows}


def test_probability_jaccard_by_its_definition():
    a, b = {1: 1.0, 2: 2.0, 3: 0.5}, {2: 1.0, 3: 3.0, 4: 1.0}
    want = 0.0
    for d in a.keys() & b.keys():
        want += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    assert probability_jaccard(a, b) == pytest.approx(want)
    assert probability_jaccard({1: 1.0, 2: 1.0}, {2: 1.0, 3: 1.0}) == pytest.approx(1 / 3)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(5)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    docs = [(np.concatenate([shared, x]), np.ones(900)) for x in (a, b)]
    found = [float((x[0] == x[1]).mean()) for x in (minhash.signatures([(s * np.uint64(2 * k + 1), c) for s, c in docs]) for k in range(20))]
    assert np.mean(found) == pytest.approx(0.8, abs=0.03)


def test_names_that_clash_are_kept(clashing):
    assert set(CLASHING) <= set(clashing.columns)
    out = corpus_pipeline.line_stage(None, clashing, "")
    assert out.columns == clashing.columns
    assert out.filter(" AND ".join(f"`{c}` = 1" for c in CLASHING)).count() == out.count() > 0
