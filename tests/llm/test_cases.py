"""Columns with clashing names, very long texts, and the pipeline by plain versions."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from conftest import CLASHING, DOCUMENTS, corpus, sentence
from test_dedup import classes_want
from test_text import edit_distance_within

import corpus_pipeline
from lanternlog.llm import decontaminate, langid, line_dedup, minhash, packing, quality, secrets, suffix_dedup, tokens, toxicity, warc


@pytest.fixture(scope="module")
def bench(spark):
    rng = random.Random(20)
    return spark.createDataFrame([(i, sentence(rng, 12)) for i in range(5)] + [(9, corpus()[3][1].split("\n")[2])], "item_id long, text string")


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")


RESULTS = {
    "suffix_dedup": lambda df, bench, labels: suffix_dedup.suffix_dedup(df).drop("spans"),
    "language_id": lambda df, bench, labels: langid.language_id(df),
    "quality_rules": lambda df, bench, labels: quality.quality_rules(df).select("doc_id", "n_words", "kept", "chars_per_token"),
    "near_duplicates": lambda df, bench, labels: minhash.near_duplicates(df).select("doc_id", "class_id", "is_first"),
    "toxicity": lambda df, bench, labels: toxicity.toxicity(df, labels),
    "contaminated_pairs": lambda df, bench, labels: decontaminate.contaminated_pairs(df, bench),
    "pack": lambda df, bench, labels: packing.pack(df).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "secret_report": lambda df, bench, labels: secrets.secret_report(df),
}


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_clashing_columns_change_no_result(name, docs, clashing, bench, labelled):
    rows = lambda df: Counter(map(str, RESULTS[name](df, bench, labelled).collect()))
    assert rows(clashing) == rows(docs)


KEEPERS = {
    "kept_documents": lambda df, bench: quality.kept_documents(df),
    "without_repeated_lines": lambda df, bench: line_dedup.without_repeated_lines(df),
    "without_near_duplicates": lambda df, bench: minhash.without_near_duplicates(df),
    "decontaminated": lambda df, bench: decontaminate.decontaminated(df, bench),
}


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_clashing_columns_are_handed_on(name, clashing, bench, empty):
    out = KEEPERS[name](clashing, bench)
    assert out.columns == clashing.columns
    assert out.filter(" AND ".join(f"`{c}` = 1" for c in CLASHING)).count() == out.count() > 0
    assert KEEPERS[name](empty, bench).count() == 0


def test_very_long_texts(spark, bench):
    rng = random.Random(21)
    prose = sentence(rng, 150_000)
    item = bench.filter("item_id = 2").first().text
    rows = [(1, "same line\n" * 200_000), (2, prose[:1_000_000] + " " + item + " " + prose[1_000_000:]), (3, "q" * 1_500_000), (4, "AKIA" + "Z" * 500_000 + " token=" + "k1" * 200_000)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    lines = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
    assert lines[1].n_lines == 200_001 and lines[1].n_removed == 199_999 and lines[2].text == rows[1][1]
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated_pairs(df, bench).collect()] == [(2, 2, 0)]
    found = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in secrets.secret_report(df).collect()}
    assert found == {1: (0, 0, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 1, 0)}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(df).collect()} == dict.fromkeys((1, 2, 3, 4), 0)


def plain_pipeline(spark, rows, items):
    """The pieces of what every stage keeps, by loops. Verdicts of the quality rules are theirs, which have tests of their own."""
    from tokenizers import Tokenizer

    df = spark.createDataFrame(rows, DOCUMENTS)
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(df).collect()}
    left = {i: t for i, t, *_ in rows if verdict[i]}
    windows = defaultdict(list)
    for i in sorted(left):
        ls = left[i].split("\n")
        for k in range(len(ls) - 2):
            windows[tuple(ls[k : k + 3])].append((i, k))
    for i in left:
        ls = left[i].split("\n")
        gone = {k + j for k in range(len(ls) - 2) if windows[tuple(ls[k : k + 3])][0] != (i, k) for j in range(3)}
        left[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone) if len(gone) < len(ls) else None
    left = {i: t for i, t in left.items() if t is not None}
    _, classes = classes_want(sorted(left.items()))
    left = {i: left[i] for i in left if classes[i, left[i]] == i}
    wanted = [decontaminate.normal(x) for _, x in items]
    left = {i: t for i, t in left.items() if not any(edit_distance_within(w, decontaminate.normal(t)) <= int(0.06 * len(w)) for w in wanted)}
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path(packing.VOCABULARY))
    out = Counter()
    for i, t in left.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            out[i, k, at, len(own), crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
    return out


def test_pipeline_by_plain_versions(spark, tmp_path, bench):
    rows, seen = [], set()
    for r in corpus():
        if r[0] is not None and r[0] not in seen and len(r[1] or "") < 20_000:
            seen.add(r[0])
            rows.append(r)
    spark.createDataFrame(rows, DOCUMENTS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_pipeline(spark, rows, [(r.item_id, r.text) for r in bench.collect()])
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 20 < len(want) < len(rows) and 3 not in {i for i, *_ in want}


def test_pages_with_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "same" if i % 2 else f"own {i}", *[1] * len(CLASHING)) for i in range(20)], "page_id long, url string, html string, " + ", ".join(f"`{c}_` int" for c in CLASHING))
    pages = pages.toDF("page_id", "url", "html", *(c if c not in ("page_id", "url", "html") else f"{c}_" for c in CLASHING))
    warc.write_warc(pages, f"file://{tmp_path}/w")
    out = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert Counter(r.record_type for r in out) == {"response": 11, "revisit": 9} and not re.search("None", str([r.url for r in out]))
