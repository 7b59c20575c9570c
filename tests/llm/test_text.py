"""Language ID, quality rules, toxicity, decontamination, packing, secrets, archives: brute force and held-out checks."""

import gzip
import hashlib
import itertools
import math
import random
import re
from base64 import b32encode
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DOCUMENTS, sentence
from pyspark.sql import functions as F

from lanternlog.llm import decontaminate, langid, packing, quality, secrets, tokens, toxicity, warc

# --- language ------------------------------------------------------------------------------------------------------

LATE = "ka mu shi to ra ne yo wi zu".split()


def late(rng, n):
    return " ".join("".join(rng.choice(LATE) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(1)
    rows = [(i, (sentence if i % 2 else late)(rng, 40), "a" if i % 2 else "b", "s", 0) for i in range(120)]
    rows += [(200, None, "a", "s", 0), (201, "123 !!", "a", "s", 0), (None, sentence(rng, 20), "a", "s", 0), (202, sentence(rng, 30), None, "s", 0), (203, "zzzqqqxxx " * 30, None, "s", 0)]
    return spark.createDataFrame(rows, DOCUMENTS)


def test_held_out_texts_get_their_language(two_languages):
    from zlib import crc32

    truth = {r.doc_id: r.lang for r in two_languages.collect()}
    out = langid.language_id(two_languages).collect()
    assert len(out) == two_languages.count()
    for r in out:
        if r.doc_id is None:
            assert r.held_out and r.lang_pred == "a"
            continue
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.doc_id in (200, 201):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id < 200:
            assert r.lang_pred == truth[r.doc_id] and not r.rejected
    assert next(r for r in out if r.doc_id == 203).rejected


class PlainKneserNey:
    """Interpolated Kneser-Ney by its definitions, in dictionaries: from {(language, five letters): count}."""

    def __init__(self, counts):
        self.langs = sorted({lang for lang, _ in counts})
        self.times, self.total, self.kinds, self.discount = {}, Counter(), Counter(), {}
        for order in range(5, 0, -1):
            raw, before = Counter(), defaultdict(set)
            for (lang, gram), n in counts.items():
                raw[lang, gram[-order:]] += n
                if order < 5:
                    before[lang, gram[-order:]].add(gram[-order - 1])
            for key, n in raw.items():
                self.times[key] = n if order == 5 or key[1][0] == "\x01" else len(before[key])
            for lang in self.langs:
                own = [n for (k, g), n in self.times.items() if k == lang and len(g) == order]
                ones, twos = own.count(1), own.count(2)
                self.discount[lang, order] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        for (lang, gram), n in self.times.items():
            self.total[lang, len(gram), gram[:-1]] += n
            self.kinds[lang, len(gram), gram[:-1]] += 1
        self.alphabet = len({g for _, g in self.times if len(g) == 1}) + 1

    def p(self, lang, gram):
        if not gram:
            return 1 / self.alphabet
        total, kinds = self.total[lang, len(gram), gram[:-1]], self.kinds[lang, len(gram), gram[:-1]]
        below = self.p(lang, gram[1:])
        if not total:
            return below
        d = self.discount[lang, len(gram)]
        return max(self.times.get((lang, gram), 0) - d, 0) / total + d * kinds / total * below


def plain_grams(text):
    runs = re.findall(r"[^\W\d_]+", text.lower())
    return [("\x01" * 4 + r + "\x02")[k : k + 5] for r in runs for k in range(len(r) + 1)]


def test_language_and_entropy_by_the_definitions(spark, two_languages):
    from zlib import crc32

    rows = two_languages.unionByName(two_languages.limit(9)).collect()  # with repeated rows
    crc = lambda i: crc32(str(i).encode())
    counts = Counter()
    for r in rows:
        if r.doc_id is not None and crc(r.doc_id) % 4 != 2 and (crc(r.doc_id) >> 2) % 4 and r.lang and r.text:
            counts.update((r.lang, g) for g in plain_grams(r.text))
    model = PlainKneserNey(counts)
    for context in ("\x01\x01\x01\x01", "\x01\x01\x01t", "then"):
        for lang in model.langs:
            p = sum(model.p(lang, context + c) for c in {g for _, g in model.times if len(g) == 1})
            assert 0.9 < p <= 1.0001  # the rest is for letters that were never seen
    found = {}
    for out in langid.language_id(spark.createDataFrame(rows, DOCUMENTS)).collect():
        assert found.setdefault((out.doc_id, out.held_out, out.cross_entropy), out) == out
    by_id = defaultdict(list)
    for out in found.values():
        by_id[out.doc_id].append(out)
    for r in rows:
        grams = plain_grams(r.text or "")
        if grams:
            entropy = {lang: -sum(math.log(model.p(lang, g)) for g in grams) / len(grams) for lang in model.langs}
            best = min(model.langs, key=entropy.get)
            assert any(o.lang_pred == best and o.cross_entropy == pytest.approx(entropy[best], abs=1e-5) for o in by_id[r.doc_id])
            want = 1 / sum(math.exp(-(e - entropy[best]) * min(len(grams), 40)) for e in entropy.values())
            assert any(o.score == pytest.approx(want, abs=1e-4) for o in by_id[r.doc_id])


def test_tied_languages_go_to_the_first(spark):
    rows = [(i, "same words in both", "b" if i % 2 else "a", "s", 0) for i in range(40)]
    out = langid.language_id(spark.createDataFrame(rows, DOCUMENTS)).collect()
    learnt = {k: sum(r.lang_pred == k for r in out) for k in ("a", "b")}
    assert len(out) == 40 and sorted(learnt.values()) == [0, 40]


def test_nothing_to_learn_from(spark, empty):
    assert langid.language_id(empty).count() == 0
    one = spark.createDataFrame([(1, "some text", None, "s", 0)], DOCUMENTS)
    assert langid.language_id(one).first().lang_pred == "und"


def test_every_language_and_gram_is_learnt(spark):
    # a letter range and a few words of its own for each of 70 languages
    rng = random.Random(5)
    rows = [(100 * i + j, " ".join("".join(chr(0x4E00 + 20 * i + rng.randrange(20)) for _ in range(5)) for _ in range(30)), f"l{i:02}", "s", 0) for i in range(70) for j in range(6)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    out = {r.doc_id: r for r in langid.language_id(df).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang, *_ in rows)
    # what is broadcast changes nothing
    assert {r.doc_id: r for r in langid.language_id(df, most_broadcast=700).collect()} == out


def test_gram_table_has_the_models_probabilities(spark):
    rng = random.Random(6)
    counted = Counter()
    for lang, make in (("a", sentence), ("b", late)):
        counted.update((lang, g) for g in plain_grams(make(rng, 200)))
    unseen = "\x01\x01qqq"
    df = spark.createDataFrame([*((lang, g, n, n) for (lang, g), n in counted.items()), (None, unseen, 1, 0)], "lang string, gram string, n long, fit_n long")
    langs, table = langid.gram_table(df)
    model = PlainKneserNey(counted)
    found = {r.gram: r.p for r in table.collect()}
    assert langs == ["a", "b"] and unseen in found and len(found) == len({g for _, g in counted}) + 1
    assert all(p / langid.SCALE == pytest.approx(math.log(model.p(lang, g)), abs=1e-5) for g, ps in found.items() for lang, p in zip(langs, ps, strict=True))


# --- quality -------------------------------------------------------------------------------------------------------


def base_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = defaultdict(list)
    for k in range(len(words) - 2):
        where[tuple(words[k : k + 3])].append(k)
    covered = {k + j for ks in where.values() if len(ks) > 1 for k in ks for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(docs, empty):
    want = Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
    out = quality.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert quality.quality_rules(empty).count() == 0


def test_texts_outside_their_band_go(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 200), "en", "s", 0) for i in range(60)] + [(100, " ".join("".join(rng.choice("☃⚘☙✂✆✌") for _ in range(5)) for _ in range(120)), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r.doc_id for r in quality.kept_documents(df).collect()}
    assert 100 not in kept and len(kept) == 60


def plain_measures(model, text):
    """Characters a token, share of fallback bytes, and token entropy over the most that so many tokens can have."""
    ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in model.encode(w)]
    if not ids:
        return 0.0, 0.0, 0.0
    shares = [n / len(ids) for n in Counter(ids).values()]
    entropy = -sum(p * math.log(p) for p in shares) / math.log(len(ids)) if len(ids) > 1 else 0.0
    return sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", text))) / len(ids), sum(model.is_byte(i) for i in ids) / len(ids), entropy


def test_measures_and_verdicts_by_their_definitions(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path(quality.VOCABULARY))
    rng = random.Random(14)
    rows = [(1000 + i, (sentence if i % 2 else late)(rng, rng.choice([60, 70, 130, 260])) + " ☃" * (rng.randrange(3) if i % 10 else 40), ["a", "b", None][i % 3], "s", 0) for i in range(200)]
    df = docs.unionByName(spark.createDataFrame(rows, DOCUMENTS))
    out = quality.quality_rules(df).collect()
    texts = {(r.doc_id, r.n_chars, r.lang): r.text or "" for r in df.collect()}
    measured = {}
    for key, t in texts.items():
        measured.setdefault((key[0], key[2], len(re.findall(r"[^\x20\x09-\x0D]+", t))), []).append(plain_measures(model, t))
    for r in out:
        assert any((r.chars_per_token, r.byte_share, r.entropy) == pytest.approx(x, abs=1e-9) for x in measured[r.doc_id, r.lang, r.n_words])
    usable = [r for r in out if not r.base_failed]

    def band(keys, names):
        groups = defaultdict(list)
        for r in usable:
            if all(r[k] is not None for k in keys):
                groups[tuple(r[k] for k in keys)].append(r)
        found = {}
        for key, own in groups.items():
            if len(own) >= 20:
                at = lambda m, q, own=own: sorted(x[m] for x in own)[max(math.ceil(q * len(own)) - 1, 0)]
                found[key] = {m: (at(m, 0.5), max(6 * 1.4826 * (at(m, 0.75) - at(m, 0.25)) / 2, quality.LEAST_WIDTH[m])) for m in names}
        return found

    kinds = [(k, band(k, names)) for k, names in ((("lang", "length_class"), quality.MEASURES), (("lang",), quality.MEASURES[:2]), (("script", "length_class"), quality.MEASURES), (("script",), quality.MEASURES[:2]))]
    for r in out:
        limits = next((f[tuple(r[k] for k in keys)] for keys, f in kinds if tuple(r[k] for k in keys) in f), {})
        assert set(r.rejected_by) == {m for m, (middle, half) in limits.items() if abs(r[m] - middle) > half}
        assert r.kept == (not r.base_failed and not r.rejected_by)
    assert sum(bool(r.rejected_by) for r in out) >= 10
    # joined or broadcast, the bands are the same
    verdicts = lambda rows: Counter((r.doc_id, r.n_words, r.kept, *r.rejected_by) for r in rows)
    assert verdicts(quality.quality_rules(df, most_broadcast=0).collect()) == verdicts(out)


def test_more_languages_than_are_broadcast(spark):
    rng = random.Random(15)
    rows = [(20 * i + j, sentence(rng, 60) if j else "☃⚘☙ " * 60, f"l{i}", "s", 0) for i in range(30) for j in range(21)]
    out = quality.quality_rules(spark.createDataFrame(rows, DOCUMENTS), most_broadcast=10, min_docs=20).collect()
    by_own = [r for r in out if not r.base_failed]
    assert len(by_own) == 600 and all(r.kept for r in by_own)


def test_repeat_words_with_large_numbers():
    ids = np.array([5, 3 << 21, 7, 1, 5, 3 << 21, 7, 2])
    assert quality.repeat_words(ids) == 6


# --- toxicity ------------------------------------------------------------------------------------------------------


def test_chain_finds_toxic_texts_that_it_did_not_see(spark, empty):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = sentence(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["badword", "worseword"])
        rows.append((i, " ".join(words), "en", "s", 0))
        if i < 200:
            labels.append((i, 0 if i % 7 == 0 else 1, int(toxic)))
    df = spark.createDataFrame(rows, DOCUMENTS)
    lab = spark.createDataFrame([*labels, (300, None, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert len(out) == 400
    assert all(out[i].is_toxic == (i % 5 == 0) for i in range(200, 400))
    none = toxicity.toxicity(df, lab.limit(0))
    assert none.filter("is_toxic").count() == 0 and none.count() == 400
    assert toxicity.toxicity(empty, lab).count() == 0


def test_words_of_three_labelled_rows_are_learnt(spark):
    rng = random.Random(9)
    rare = ["rarest" + a + b for a in "abcd" for b in "efgh"]
    rows = [(i, sentence(rng, 40) + (" " + rare[i // 3] if i < 48 else ""), "en", "s", 0) for i in range(240)]
    rows += [(1000 + i, sentence(rng, 40) + " " + w, "en", "s", 0) for i, w in enumerate(rare)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    labels = spark.createDataFrame([(i, 1, int(i < 48)) for i in range(240)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(df, labels)
    assert set(rare) <= set(chain.vocabulary)
    out = {r.doc_id: r.p_toxic for r in toxicity.toxicity(df, labels).collect()}
    assert min(out[1000 + i] for i in range(len(rare))) > 0.3  # the base rate is 0.2


def test_models_are_the_minimum_that_they_should_be():
    """At the minimum of mean log loss + penalty * |scaled weights|, slopes balance the penalty, and none is over it."""
    rng = np.random.default_rng(6)
    n, width = 400, 60
    x = rng.random((n, width)) < rng.random(width) ** 2
    dense = rng.random((n, 1))
    z = x[:, :5] @ np.array([2.0, -2.0, 1.5, 1.0, -1.0]) + 2 * dense[:, 0] - 1
    label = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(float)
    row, ids = np.nonzero(x)
    penalty = 0.01
    rows = toxicity.Rows(ids, x.sum(axis=1), width, dense)
    weights, intercept = toxicity.fitted(rows, label, penalty, most_steps=2000, tolerance=1e-12)
    both = np.column_stack([x, dense]).astype(float)
    std = both.std(axis=0)
    residual = 1 / (1 + np.exp(-(both @ weights + intercept))) - label
    slope = (both / np.where(std > 0, std, 1)).T @ residual / n
    own = (std > 1e-12) & (weights != 0)
    assert abs(residual.mean()) < 1e-5 and 3 <= own.sum() < width
    assert np.allclose(slope[own], -penalty * np.sign(weights[own]), atol=1e-4)
    assert (np.abs(slope[(std > 1e-12) & (weights == 0)]) <= penalty + 1e-4).all()
    assert (weights[std <= 1e-12] == 0).all()


def test_conflicting_labels_repeated_rows_and_wordless_texts(spark, docs):
    rng = random.Random(16)
    rows = [(i, sentence(rng, 30) + (" badword" if i % 4 == 0 else ""), "en", "s", 0) for i in range(160)]
    rows += [(500, None, None, None, None), (501, " 12 ☃ ", "en", "s", 0), (502, "badword " * 200_000, "en", "s", 0), rows[0], rows[0], (None, "badword here", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    labels = [(i, i % 2, int(i % 4 == 0)) for i in range(120)]
    make = lambda more: spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int")
    report = lambda lab: sorted((str(r.doc_id), r.p_low_quality, r.p_toxic) for r in toxicity.toxicity(df, lab).collect())
    # a second label that says less changes nothing, whichever comes first; one that says more holds
    once = report(make([]))
    assert report(make([(i, 1, 0) for i in range(0, 120, 4)])) == once == report(make([(None, 1, 1), (7, None, 1), (9999, 1, 1)]).repartition(7))
    assert report(make([(i, 1, 1) for i in range(1, 120, 4)])) != once
    out = {i: p for i, _, p in once}
    assert len(once) == len(rows) and out["500"] == out["501"] < 0.5 < min(out["502"], out["None"])
    assert sum(i == "0" for i, *_ in once) == 3 and len({x for x in once if x[0] == "0"}) == 1


def test_probabilities_of_the_chain_by_hand(spark):
    """The later model's input is what models of the other folds gave; a plain chain has the same probabilities."""
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(6)), "en", "s", 0) for i in range(300)]
    labels = [(i, int("ab" not in t.split() or i % 9 == 0), int("cd" in t.split() and i % 7 > 0)) for i, t, *_ in rows[:200]]
    df, lab = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.toxicity(df, lab).collect()}
    fold = {r[0]: r[1] for r in lab.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fold'), 3)").collect()}
    words = sorted({w for _, t, *_ in rows for w in t.split()})
    x = np.array([[w in t.split() for w in words] for _, t, *_ in rows], float)
    low, toxic = np.array([1.0 - q for _, q, _ in labels]), np.array([float(t) for *_, t in labels])

    def fit(which, label, dense):
        ids = np.concatenate([np.flatnonzero(x[i]) for i in which])
        w, b = toxicity.fitted(toxicity.Rows(ids, x[which].sum(axis=1).astype(int), len(words), dense[which]), label[which], 0.002)
        return lambda rows, d: 1 / (1 + np.exp(-(np.column_stack([x[rows], d]) @ w + b)))

    none, known, every = np.zeros((300, 0)), np.arange(200), np.arange(300)
    apart = np.zeros((200, 1))
    for f in range(3):
        own = np.array([i for i in known if fold[i] == f])
        apart[own, 0] = fit(np.setdiff1d(known, own), low, none)(own, none[own])
    p_low = fit(known, low, none)(every, none)
    p_toxic = fit(known, toxic, apart)(every, p_low[:, None])
    assert np.allclose(np.array([got[i] for i in range(300)]), np.column_stack([p_low, p_toxic]), atol=0.01)


# --- decontamination -----------------------------------------------------------------------------------------------


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(4)
    for _ in range(60):
        item = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 40)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        got = decontaminate.best_place(item, masks, text, len(item))
        assert (got[0] if got else len(item)) == edit_distance_within(item, text)


def test_items_within_their_errors_are_found(spark, empty):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randint(12, 40)).capitalize() + ".") for i in range(12)] + [(50, None), (51, " ... "), (52, "ab")]
    rows = []
    for d in range(60):
        body = sentence(rng, 80).split()
        if d % 3 == 0:
            own = list(items[d % 12][1])
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice("xyz")
            body[40:40] = "".join(own).split()
        rows.append((d, " ".join(body), "en", "s", 0))
    rows += [(70, None, "en", "s", 0), (71, "", "en", "s", 0), rows[0]]
    df, bench = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for d, t, *_ in rows:
        for i, x in items:
            item = decontaminate.normal(x)
            if item and t:
                n = edit_distance_within(item, decontaminate.normal(t))
                if n <= int(len(item) * 0.06):
                    want[d, i] = n
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated_pairs(df, bench).collect()}
    assert got == want and len(want) >= 8
    assert {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated_pairs(df, bench, most_chars=500).collect()} == want
    clean = decontaminate.decontaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.contaminated_pairs(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(empty, bench).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


#: What the tokenizer treats in a way of its own: marks, white space, letters that fall apart, literals of whole tokens.
ATOMS = [*"abcXYZ019'.,!#$%&*|<>?;:-_=()\"/ \t\n\r\x0b\x0c\x1c\x85\xa0", "\u2003", "\u3000", "\u0130", "\u00e9", "e\u0301", "\u0301", "\u0307", "\u0338", "\u00df", "\u03a3", "\u00bd", "\u00b2", "\u65e5\u672c", "\u3002", "\ufb01", "\u2163",
         "\u01c5", "\u200d", "\U0001f600", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "\u212b", "\u1e9e", "\uff21", "\xad", "\u212a", "\u037e", "the", "Hello", "world. "]


def test_ids_are_the_tokenizers_own(docs):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(packing.VOCABULARY)
    plain = Tokenizer.from_file(path)
    rng = random.Random(10)
    odd = ["", "a-b!c... that's 'tis I'll <|endoftext|> x=y; (foo). \"bar\"!", "É. ÉA! İ. İstanbul ΣΑΣ. ́a! é. ½! ²x 日本語。テスト! foo-! ≮ a≮!", "!!! ??? ..."]
    texts = odd + [r.text or "" for r in docs.collect()] + ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 24))) for _ in range(100_000)]
    encoder = tokens.WordEncoder(path, most_words=3_000, most_pieces=5_000)
    for at in range(0, len(texts), 200):
        some = texts[at : at + 200]
        ids, ends = encoder.encode(some)
        for text, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
            assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    from zlib import crc32

    encoder = tokens.word_encoder(tokens.vocabulary_path(packing.VOCABULARY))
    want, total = Counter(), 0
    for r in docs.collect():
        ids = np.append(encoder.encode([r.text or ""])[0], 0).astype("<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[r.doc_id, k, at, len(own), crc32(own.tobytes())] += 1
    out = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.1 * total / 2048 + 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("most_items", [40, 200_000])
def test_packing_comes_near_the_bound_at_every_size_of_a_task(spark, most_items):
    """Texts of over half a sequence, which do not fit together, and short ones that fill them up."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(39 + i % 3 if i % 4 else 3)), "en", "s", 0) for i in range(800)]
    out = packing.pack(spark.createDataFrame(rows, DOCUMENTS).repartition(16), length=64, most_items=most_items).collect()
    assert len(out) == 800 and sum(r.length for r in out) == sum(len(t.split()) + 1 for _, t, *_ in rows)
    assert len({r.sequence_id for r in out}) == 600  # the long ones need one each, and all the short ones fit beside them


def test_best_fit_fills_the_fullest_bin():
    assert [sorted(b) for b in packing.best_fit([6, 5, 4, 3, 2], 10)] == [[0, 2], [1, 3, 4]]


# --- secrets -------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_secrets(spark, empty):
    rng = random.Random(6)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [
        f"token = \"{hexed(40)}\" and password: short", "token=token:abcdefgh secret=secret=abcdefgh", f"😀 AKIA{'A1' * 8} é PASSWORD='{mixed(12)}'", f"AKIAAKIA{'B' * 12} AKIA12",
        f"{hexed(23)} {hexed(24)}", f"key {mixed(44)} end", "thisisaverylongordinarywordindeed", None, "", "aaaaaaaaaaaaaaaaaaaaaaaa1B", "api_key : x api-key=abcdefgh apikey=abc.def-g", f"a{mixed(30)}\n{mixed(30)}",
    ]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, texts[2], None, None, 0)]
    out = secrets.secret_report(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert len(out) == len(rows)
    for r in out:
        t = texts[2] if r.doc_id is None else texts[r.doc_id]
        want = base_spans(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, _, _ in want) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [f"{k}:{s}:{e}" for k, s, e in want]
    spans = {r.doc_id: r.spans for r in out}
    assert spans[5] == "random:4:48" and spans[6] == "" and "random" not in spans[9]
    assert secrets.secret_report(spark.createDataFrame([], DOCUMENTS)).count() == 0


def plain_p(token):
    """The battery by its definitions, one token at a time."""
    bare = token.rstrip("=")
    alphabet = next((a for _, a, pattern in secrets.ENCODINGS if re.match(pattern, bare)), None)
    if alphabet is None:
        return None
    n, k = len(bare), len(alphabet)
    codes = [alphabet.index(c) for c in bare]
    tail = lambda z: math.erfc(min(z, 12) / math.sqrt(2)) / 2
    agreeing = sum(x == y for x, y in itertools.combinations(codes, 2))
    above = [c >= k / 2 for c in codes]
    a = sum(above)
    spread = 2 * a * (n - a)
    variance = spread * (spread - n) / (n * n * (n - 1))
    runs = 1 + sum(x != y for x, y in zip(above, above[1:], strict=False))
    mean = sum(codes) / n
    total = sum((c - mean) ** 2 for c in codes)
    serial = sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:], strict=False)) / total if total else None
    if n <= 64:
        tails = secrets.repeat_tails(k)[n]
        ps = [tails[agreeing] if agreeing < len(tails) else 1e-17]
    else:
        m, v = math.comb(n, 2) / k, math.comb(n, 2) / k * (1 - 1 / k)
        skew = (v * (1 - 2 / k) + 6 * math.comb(n, 3) * (1 - 1 / k) / k**2) / v**1.5
        ps = [tail((max(1 + skew * (agreeing - 0.5 - m) / math.sqrt(v) / 2, 0) ** (1 / 3) - 1 + skew**2 / 36) * 6 / skew)]
    ps.append(2 * tail(abs(runs - 1 - spread / n) / math.sqrt(variance) if variance > 0 else 12))
    ps.append(2 * tail(abs(serial + 1 / n) * math.sqrt(n) if total else 12))
    return -math.expm1(3 * math.log1p(-min(min(ps), 1 - 1e-12)))


def partitions(n, most):
    """The ways to write n as a sum, greatest first."""
    if n == 0:
        yield []
    for first in range(min(n, most), 0, -1):
        for rest in partitions(n - first, first):
            yield [first, *rest]


@pytest.mark.parametrize("n, k", [(1, 16), (2, 16), (9, 62), (20, 16), (20, 62), (33, 32), (40, 64), (40, 16)])
def test_chances_of_repeats_by_counting_all_texts(n, k):
    texts = Counter()
    for counts in partitions(n, n):
        if len(counts) <= k:
            same = math.prod(math.factorial(m) for m in Counter(counts).values())
            texts[sum(math.comb(c, 2) for c in counts)] += math.factorial(n) // math.prod(map(math.factorial, counts)) * (math.perm(k, len(counts)) // same)
    assert sum(texts.values()) == k**n
    got = secrets.repeat_tails(k)[n]
    for r in range(len(got) + 1):
        p = sum(m for pairs, m in texts.items() if pairs >= r) / k**n
        assert got[r] == pytest.approx(p, rel=1e-6) if r < len(got) else p < 1.01e-17


def test_normal_tails_to_their_last_digits(spark):
    zs = [z / 16 for z in range(-192, 193)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets.upper_tail(F.col("z")).alias("p")).collect()
    assert len(got) == len(zs) and all(r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-9) for r in got)


def test_tails_beyond_the_table_join_on(spark):
    """The gamma's tail beside the exact one where both are there: within a half for 1 in 1000 and more likely."""
    for k in (16, 32, 62, 64):
        n, tails = 64, secrets.repeat_tails(k)[64]
        m, v = math.comb(n, 2) / k, math.comb(n, 2) / k * (1 - 1 / k)
        skew = (v * (1 - 2 / k) + 6 * math.comb(n, 3) * (1 - 1 / k) / k**2) / v**1.5
        rows = [((r - 0.5 - m) / math.sqrt(v), skew, p) for r, p in enumerate(tails) if 1e-3 <= p <= 0.5]
        for r in spark.createDataFrame(rows, "z double, skew double, p double").select("p", secrets.gamma_tail(F.col("z"), F.col("skew")).alias("q")).collect():
            assert r.p / 1.5 <= r.q <= r.p * 1.5


def made_tokens():
    rng = random.Random(12)
    letters = secrets.UPPER + secrets.LOWER
    make = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    keys = [make(letters + secrets.DIGITS, rng.randint(24, 60)) for _ in range(150)] + [make(letters, rng.randint(24, 60)) for _ in range(100)] + [make("0123456789abcdef", 40) for _ in range(50)]
    words = sorted({w for w in sentence(rng, 3000).split() if len(w) > 3})
    names = ["".join(rng.choice(words).capitalize() for _ in range(rng.randint(4, 7))) + rng.choice(["", "2", "11"]) for _ in range(300)]
    names = [x for x in names if len(x) >= secrets.LEAST]
    paths = ["/".join(rng.choice(words) for _ in range(6)) + "_v2-" + rng.choice(words) for _ in range(100)]
    inner = [f"{rng.choice(words)}/api_v2/my-{rng.choice(words)}/{make(letters + secrets.DIGITS, 40)}" for _ in range(100)]
    return keys, names, paths, inner


def test_battery_by_its_definitions_and_what_it_reports(spark):
    keys, names, paths, inner = made_tokens()
    every = keys + names
    df = spark.createDataFrame([(i, 0, "random", t, 0, len(t)) for i, t in enumerate(every)], "doc_id long, text_hash long, kind string, match string, start long, end long")
    got = {r.doc_id: r.p for r in secrets.battery(df).collect()}
    want = {i: p for i, t in enumerate(every) if (p := plain_p(t)) is not None}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)
    texts = [f"see {t} here" for t in every + paths + inner]
    out = {r.doc_id: r.spans for r in secrets.secret_report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    found = lambda first, n: sum("random" in out[i] or "hex" in out[i] for i in range(first, first + n))
    a, b, c = len(keys), len(names), len(paths)
    assert found(0, a) >= 0.95 * a and found(a, b) <= 0.1 * b and found(a + b, c) <= 0.05 * c
    # the key within a path, and not the path
    for i, t in enumerate(inner):
        at = 4 + len(t) - 40
        assert out[a + b + c + i] in ("", f"random:{at}:{at + 40}")
    assert found(a + b + c, len(inner)) >= 0.95 * len(inner)


def plain_dismissed(ps, q):
    """Benjamini-Hochberg at q over one class: which p-values are dismissed."""
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    most = max((r for r, i in enumerate(order, 1) if ps[i] <= q * r / len(ps)), default=0)
    return {i for r, i in enumerate(order, 1) if r <= most}


def test_false_discovery_step(spark):
    rng = random.Random(13)
    bins = [rng.choice([0, 1, 2, 5, 20, 30, 60, 100]) for _ in range(200)]
    ps = [10 ** (-b * secrets.BIN_WIDTH) for b in bins]
    df = spark.createDataFrame([("hex", 9, b) for b in bins], "encoding string, length_class int, p_bin int")
    limit = secrets.dismissed_below(df, 0.05).first()
    assert {i for i, b in enumerate(bins) if limit and b >= limit.from_bin} == plain_dismissed(ps, 0.05)


# --- archives ------------------------------------------------------------------------------------------------------


def test_ranges_follow_the_input_alone():
    count = lambda gb: warc.range_count(gb * (1 << 30), 256 << 20, 4 << 20, 200)
    assert [count(x) for x in (0, 0.05, 10, 30_000)] == [1, 13, 200, 120_001]


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"http://x/{i}", sentence(rng, 200)) for i in range(60)]
    rows += [(100 + i, f"http://y/{i}", rows[i][2]) for i in range(20)] + [(200 + i, None, "copied") for i in range(30)]
    rows += [(300, "http://n", None), (301, "http://n\r\nX: y", ""), (None, "http://z", "copied"), (None, "http://zz", "alone"), rows[0], ("ü" and 302, "http://ü", "☃ " * 5000)]
    rows += [(400, "http://long", sentence(rng, 300_000)), (401, "http://long", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, refers_to string, size int")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, folder, roll_bytes=4_000)
    assert manifest.count() > 2 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert not [p for p in (tmp_path / "w/archive").iterdir() if p.name.endswith(".tmp")]
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in rows:
        payload, target = (h or "").encode(), last[h or ""]
        same = target == (-1 if i is None else i)
        want[i, len(payload), b32encode(hashlib.sha1(payload).digest()).decode(), "response" if same else "revisit", None if same else target] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect())
    assert got == want
    again = warc.write_warc(pages, f"{folder}2", roll_bytes=4_000)
    assert sorted((r.path, r.sha1) for r in again.collect()) == sorted((r.path, r.sha1) for r in manifest.collect())
    ids = [line for p in (tmp_path / "w/archive").iterdir() for line in gzip.decompress(p.read_bytes()).split(b"\r\n") if line.startswith(b"WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count()
    # a job that is run again finds its files there and leaves them
    (tmp_path / "w/manifest").rename(tmp_path / "w/old")
    assert sorted((r.path, r.sha1) for r in warc.write_warc(pages, folder, roll_bytes=4_000).collect()) == sorted((r.path, r.sha1) for r in again.collect())
    first = sorted(p for p in (tmp_path / "w2/archive").iterdir() if p.name.endswith(".gz"))[0]
    whole = first.read_bytes()
    first.write_bytes(whole[:-1] + b"?")
    with pytest.raises(Exception, match="not the file that the manifest has"):
        warc.read_warc(spark, f"{folder}2").count()
    first.unlink()
    with pytest.raises(Exception, match="in the manifest and missing"):
        warc.read_warc(spark, f"{folder}2").count()
    none = warc.write_warc(pages.limit(0), f"{folder}3")
    assert none.count() == 0 and warc.read_warc(spark, f"{folder}3").count() == 0
