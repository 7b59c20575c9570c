"""The manifest against a plain tree of digests, its proofs, and what tampering does to them."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from conftest import DOCUMENTS, corpus
from oracle import assert_same

from lanternlog.llm import merkle
from lanternlog.llm.merkle import Manifest, folded, tampered


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes):
    """(root, proofs): a proof is what stands left and right, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            begin = p - p % 8
            proofs[i].append(("".join(nodes[begin:p]), "".join(nodes[p + 1 : begin + 8])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], proofs


def plain(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    ordered = [(i, s, lang, n, t) for i, t, lang, s, n in rows]
    trees = {}
    for lang in sorted({r[2] for r in ordered}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted((r for r in ordered if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *plain_tree([leaf(r) for r in own]))
    root, above = plain_tree([t[1] for t in trees.values()])
    out = Counter()
    for (own, subroot, proofs), upper in zip(trees.values(), above, strict=True):
        for r, p in zip(own, proofs, strict=True):
            p, shown = p + upper, r
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                shown = (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))
            end = folded(leaf(shown), p)
            out[r[0], leaf(r), subroot, root, h(*(x for pair in p for x in pair)), end, end == root] += 1
    return out


def many(n, langs):
    return [(i, f"Text {i % 7} Of {i}", None if i % langs == 0 else f"l{i % langs}", "s" if i % 3 else None, i % 11 or None) for i in range(n)]


@pytest.mark.parametrize(("rows", "every"), [(corpus(), 3), (corpus(), 1), (many(700, 3), 1), (many(1300, 1), 2), (many(130, 90), 1), (many(1, 1), 3), (many(9, 1), 1)])
def test_manifest_equals_a_plain_tree(spark, rows, every):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    got = Manifest(df, tampered(), every=every).audit().collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_proofs_fold_to_the_root_and_only_for_their_leaf(spark):
    df = spark.createDataFrame(many(300, 4), DOCUMENTS)
    manifest = Manifest(df, every=1)
    (root,) = (r.digest.hex() for r in manifest.root().collect())
    rows = manifest.proofs().collect()
    assert len(rows) == 300 and {r.root for r in rows} == {root}
    for r in rows:
        proof = [tuple(p) for p in r.proof]
        assert folded(r.leaf, proof) == root and folded(h("other"), proof) != root


def test_a_copy_that_was_changed_is_found(spark):
    rows = many(100, 3)
    df = spark.createDataFrame(rows, DOCUMENTS)
    out = Manifest(df, tampered(), every=2).audit().collect()
    changed = {i for i, *_ in rows if crc32(str(i).encode()) % 3 == 0}
    assert {r.doc_id for r in out if not r.verified} == changed and 20 < len(changed) < 50


def test_empty_table_long_text_repeated_rows_and_clashing_columns(spark, docs, clashing, empty):
    assert Manifest(empty, tampered()).audit().collect() == [] and Manifest(empty).root().collect() == []
    rows = lambda df: Counter(map(tuple, Manifest(df, tampered()).audit().collect()))
    assert rows(clashing) == rows(docs)
    odd = spark.createDataFrame([(1, "Long " * 400_000, "en", "s", 2_000_000), *[(2, "Same", "en", "s", 4)] * 40, (None, None, None, None, None)], DOCUMENTS)
    assert rows(odd) == plain([tuple(r) for r in odd.collect()])


def test_sql_states_the_same(spark):
    con = duckdb.connect()
    for n, langs in ((700, 3), (130, 90)):
        df = spark.createDataFrame(many(n, langs), DOCUMENTS)
        con.register("documents", df.toArrow())
        assert_same(Manifest(df, tampered(), every=1).audit(), merkle.ORACLE, con)
        con.unregister("documents")
