"""Merkle manifest of a dataset: trees of SHA-256 digests that store every few levels and make the others again.

A leaf is the digest of a row's fields. The leaves of a language are a tree, the roots of all languages another one on
top. In a tree every ``ARITY`` neighbours become their digest, level by level, until one node is left.

Only every ``every``-th level is written (a checkpoint): nodes are dealt by aligned subtree, that is ``ARITY ** every``
neighbours of a stored level, whose top is a node of the next stored one. A proof is made from the top down: each
subtree makes its missing levels again from its stored nodes, emits what stands left and right of each node, and drops
the levels. Leaves get what is above their subtree from its top's proof, so nothing is made again twice.

1. One pass over the rows makes leaves; only ids and digests go on from there.
2. They are sorted by range and written; a row's number in its tree is its number in its partition and what the
   partitions before it have, so that no tree, however large, is in one task.
3. Subtrees go up (``subtree_tops``) and proofs come down (``proven``), a group of ``ARITY ** every`` rows at most at a time.

Defined cases: null fields are ``-``; null ids come first, ids that repeat in the order of their leaves; a null lang is a
tree of its own, the first; a tree of one leaf has it as its root; very long texts are hashed where they are read and
never move; an empty table gives an empty result; columns besides the five named ones are neither read nor handed on,
whatever their names are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, ship_package, table

ARITY, EVERY = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """The digest of fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def joined(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], whole: bool, every: int) -> list[list[str]]:
    """A subtree's levels from its stored nodes up to its top; ``whole`` if it has all nodes of its tree's level."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= every:
        out.append([joined(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


def siblings(made: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a subtree's node in its run, level by level."""
    out = []
    for level in made[:-1]:
        begin = at - at % ARITY
        out.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + ARITY])))
        at //= ARITY
    return out


def folded(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof give."""
    for left, right in proof:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def numbered(rows: DataFrame, order: list[str], folder: str, every: int) -> DataFrame:
    """rows, stored in the order of tree and ``order``, with pos and n, the number of a row in its tree and of its tree's rows."""
    spark = rows.sparkSession
    columns = ["tree", *order]
    # rows that agree in everything may be very many: they are dealt over tasks by where they were read
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*columns, "uid").sortWithinPartitions(*columns).drop("uid")
    schema = dealt.withColumn("row", F.monotonically_increasing_id())
    schema.write.parquet(f"{folder}/sorted")
    stored = spark.read.schema(schema.schema).parquet(f"{folder}/sorted").withColumn("part", F.shiftright("row", 33))
    counts = stored.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("here"))
    own = W.partitionBy("tree")
    before = F.coalesce(F.sum("here").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("here").over(own).alias("n"))
    placed = stored.join(starts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")
    return placed.withColumn("block", F.floor(F.col("pos") / ARITY**every).cast("long"))


NODES = "tree string, block long, pos long, n long, digest binary"


def subtree_tops(every: int):
    """Of each aligned subtree of one stored level its top, a node of the next stored level."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n, block = group["n"][0].as_py(), group["block"][0].as_py()
        size = ARITY**every
        top = levels([d.hex() for d in group["digest"].to_pylist()], n <= size, every)[-1][0]
        values = [group["tree"][0].as_py(), block // size, block, -(-n // size), bytes.fromhex(top)]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), *[pa.int64()] * 3, pa.binary()), strict=True)], NODES.replace(",", "").split()[::2])

    return run


class Tree:
    """The stored levels of all trees of ``rows`` (tree, order columns, digest, and more that a leaf carries)."""

    def __init__(self, rows: DataFrame, order: list[str], folder: str, every: int = EVERY):
        self.every, self.size, self.folder = every, ARITY**every, folder
        self.carried = [c for c in rows.columns if c not in ("tree", "digest")]
        self.stored = [numbered(rows, order, folder, every)]
        most = self.stored[0].agg(F.max("n")).first()[0] or 0
        while most > self.size:
            nodes = self.stored[-1].filter(F.col("n") > self.size).select("tree", "block", "pos", "n", "digest")
            path = f"{folder}/level={self.every * len(self.stored)}"
            nodes.groupBy("tree", "block").applyInArrow(subtree_tops(every), NODES).write.parquet(path)
            self.stored.append(rows.sparkSession.read.schema(NODES).parquet(path))
            most = -(-most // self.size)

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree's root."""
        out = None
        for level in self.stored:
            whole = level.filter(F.col("n") <= self.size).select("tree", "block", "pos", "n", "digest")
            one = whole.groupBy("tree", "block").applyInArrow(subtree_tops(self.every), NODES).select("tree", "digest")
            out = one if out is None else out.unionByName(one)
        return out

    def proven(self, above: DataFrame, emit, schema: str) -> DataFrame:
        """What ``emit`` makes of each leaf; ``above`` has (tree, subroot, root, proof), how each root goes on."""
        known = above.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "proof")
        suffix = None
        for k in reversed(range(len(self.stored))):
            level, last = self.stored[k], k == 0
            whole = known if last and len(self.stored) == 1 else known.join(level.filter((F.col("n") <= self.size) & (F.col("pos") == 0)).select("tree"), "tree", "left_semi")
            suffix = whole if suffix is None else whole.unionByName(suffix)
            run = proof_maker(self.every, emit if last else node_rows)
            made = level.groupBy("tree", "block").cogroup(suffix.groupBy("tree", "block")).applyInArrow(run, schema if last else PROOFS)
            suffix = None if last else made
        return made


PROOFS = "tree string, block long, subroot binary, root binary, proof array<struct<left:string,right:string>>"
PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def proof_maker(every: int, emit):
    """For each aligned subtree and its top's proof: its nodes' proofs, as ``emit`` wants them."""

    def run(group: pa.Table, top: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        nodes = [d.hex() for d in group["digest"].to_pylist()]
        made = levels(nodes, group["n"][0].as_py() <= ARITY**every, every)
        above = [(x["left"], x["right"]) for x in top["proof"][0].as_py()]
        proofs = ([*siblings(made, i), *above] for i in range(len(nodes)))
        return emit(group, nodes, proofs, top["subroot"][0].as_py(), top["root"][0].as_py())

    return run


def pairs(proof: list[tuple[str, str]]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in proof]


def node_rows(group: pa.Table, nodes: list[str], proofs: Iterator, subroot: bytes, root: bytes) -> pa.Table:
    """Proofs of the nodes of a stored level, each the top of a subtree below it."""
    n = len(nodes)
    columns = [group["tree"].combine_chunks(), group["pos"].combine_chunks(), pa.array([subroot] * n, pa.binary()), pa.array([root] * n, pa.binary()), pa.array([pairs(p) for p in proofs], PROOF)]
    return pa.table(columns, ["tree", "block", "subroot", "root", "proof"])


def top_rows(group: pa.Table, nodes: list[str], proofs: Iterator, subroot: bytes, root: bytes) -> pa.Table:
    """Proofs of the upper tree's leaves, each the root of a tree below."""
    n = len(nodes)
    columns = [group["below"].combine_chunks(), pa.array([0] * n, pa.int64()), group["digest"].combine_chunks(), pa.array([root] * n, pa.binary()), pa.array([pairs(p) for p in proofs], PROOF)]
    return pa.table(columns, ["tree", "block", "subroot", "root", "proof"])


FULL = "doc_id long, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>"


def full_proofs(group: pa.Table, nodes: list[str], proofs: Iterator, subroot: bytes, root: bytes) -> pa.Table:
    n = len(nodes)
    columns = [group["doc_id"].combine_chunks(), pa.array(nodes, pa.string()), pa.array([subroot.hex()] * n, pa.string()), pa.array([root.hex()] * n, pa.string()), pa.array([pairs(p) for p in proofs], PROOF)]
    return pa.table(columns, ["doc_id", "leaf", "subroot", "root", "proof"])


AUDIT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def audit_rows(group: pa.Table, nodes: list[str], proofs: Iterator, subroot: bytes, root: bytes) -> pa.Table:
    """Each leaf's proof as a digest, and the root that the presented leaf gives with it."""
    rows = []
    for doc_id, leaf, shown, proof in zip(group["doc_id"].to_pylist(), nodes, group["presented"].to_pylist(), proofs, strict=True):
        found = folded(leaf if shown is None else shown.hex(), proof)
        rows.append((doc_id, leaf, subroot.hex(), root.hex(), joined([x for p in proof for x in p]), found, found == root.hex()))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], AUDIT.replace(",", "").split()[::2])


class Manifest:
    """The stored digests of a table of documents, and what can be asked of them."""

    def __init__(self, documents: DataFrame, presented: Column | None = None, *, every: int = EVERY):
        """``presented``: another digest for a row, null where it is its own, which ``audit`` holds against the manifest."""
        spark = documents.sparkSession
        ship_package(spark)
        # a level's nodes are held by the job that reads them; the folder goes by the shared folder's retention
        self.folder = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
        tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # a null lang is before the empty one
        shown = F.lit(None).cast("binary") if presented is None else presented
        rows = documents.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*(F.col(f"`{c}`") for c in FIELDS)).alias("digest"), shown.alias("presented"))
        self.lower = Tree(rows, ["doc_id", "digest"], f"{self.folder}/leaves", every)
        tops = self.lower.roots().select(F.lit("").alias("tree"), F.col("tree").alias("below"), "digest")
        self.upper = Tree(tops, ["below"], f"{self.folder}/subroots", every)

    def root(self) -> DataFrame:
        """(tree, digest): the one root of all, or no row for an empty table."""
        return self.upper.roots()

    def _above(self) -> DataFrame:
        root = self.root()
        ends = root.select("tree", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
        return self.upper.proven(ends, top_rows, PROOFS)

    def proofs(self) -> DataFrame:
        """Every leaf with what stands left and right of it and of the nodes above it, up to the root."""
        return self.lower.proven(self._above(), full_proofs, FULL)

    def audit(self) -> DataFrame:
        """Every leaf, its proof's digest, and whether the presented leaf gives the root."""
        return self.lower.proven(self._above(), audit_rows, AUDIT)


def tampered() -> Column:
    """The digest of a row whose text has its capitals made small, where 3 divides the checksum of its id; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf_digest(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(f"`{c}`") for c in FIELDS))
    return F.when(chosen, changed)


def op12_merkle_manifest(spark, sf_dir):
    return Manifest(table(spark, sf_dir, "documents"), tampered()).audit()


def crc32_sql(text: str) -> str:
    """An unsigned CRC-32 of an ASCII text's bytes, bit by bit."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda c, k: {bit})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {byte}), 4294967295)"


def oracle(deep: int = 7, high: int = 3) -> str:
    """The contract in SQL: ``deep`` levels of a language's tree and ``high`` levels above them, a step of each at a time."""
    coded = lambda text: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*FIELDS[:-1], text])
    small = f"translate(text, '{UPPER}', '{LOWER}')"
    steps = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({coded('text')}) AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({coded(small)}) END AS shown FROM documents)",
        "x0 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, coalesce(shown, leaf) AS f, '' AS proof FROM d)",
        "a0 AS (SELECT t, p, leaf AS d, count(*) OVER (PARTITION BY t) AS n FROM x0)",
    ]

    def climb(prefix: str, k: int) -> None:
        steps.append(f"r{prefix}{k} AS (SELECT t, p // 8 AS p, max(n) AS n, list(d ORDER BY q) AS run FROM (SELECT *, p AS q FROM {prefix}{k}) GROUP BY t, p // 8)")
        steps.append(f"{prefix}{k + 1} AS (SELECT t, p, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d, (n + 7) // 8 AS n FROM r{prefix}{k})")

    def fold(rows: str, prefix: str, k: int, out: str) -> None:
        beside = "array_to_string(run[1:x.p % 8], '') AS l, array_to_string(run[x.p % 8 + 2:], '') AS r"
        steps.append(f"{out} AS (SELECT * EXCLUDE (l, r, n) REPLACE (p // 8 AS p, CASE WHEN n = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof) FROM (SELECT x.*, n, {beside} FROM {rows} x JOIN r{prefix}{k} g ON g.t = x.t AND g.p = x.p // 8))")

    for k in range(deep):
        climb("a", k)
        fold(f"x{k}", "a", k, f"x{k + 1}")
    steps.append(f"b0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS p, d, count(*) OVER () AS n, t AS low FROM a{deep})")
    steps.append(f"y0 AS (SELECT x.* REPLACE ('' AS t, b.p AS p), b.d AS subroot FROM x{deep} x JOIN b0 b ON b.low = x.t)")
    for k in range(high):
        climb("b", k)
        fold(f"y{k}", "b", k, f"y{k + 1}")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM y{high}, (SELECT d AS root FROM b{high})"


ORACLE = oracle()
