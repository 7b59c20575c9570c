"""Line dedup: overlapping three-line windows, repeated anywhere in the corpus, with DataFrame functions only.

Lines are cut at \\n and compared exactly. Every run of three consecutive lines is a window. Of equal windows the
first by (doc_id, text hash, position) stays; every line that a later one covers goes, even where it overlaps the
first (of one line repeated five times, one line stays).

Defined cases: a null text has no lines and stays null; texts of fewer than three lines stay whole; a text that loses
every line becomes ''; a null doc_id comes first; repeated rows are one document and get the same result. Very long
texts are rows of lines like others: a text is split in its task, and lines, not texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, table, unpacked


def windows(docs: DataFrame) -> DataFrame:
    """A row for each three-line window: a 128-bit hash of its lines, and its place."""
    lines = F.split("text", "\n", -1)
    three = F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.size(lines)).alias("b"), F.slice(lines, 3, F.size(lines)).alias("c"))
    return (
        docs.filter(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= 2)
        .select("doc_id", "text_hash", F.posexplode(F.slice(three, 1, F.size(lines) - 2)).alias("pos", "w"))
        .select(
            F.xxhash64("w.a", "w.b", "w.c").alias("h1"),
            F.xxhash64(F.lit("second"), "w.c", "w.b", "w.a").alias("h2"),
            F.struct("doc_id", "text_hash", "pos").alias("place"),
        )
    )


def marked(documents: DataFrame) -> DataFrame:
    """packed() documents with text deduplicated, and n_lines and n_removed beside them.

    One aggregation finds each repeated window's first place (hot windows are combined before the shuffle), one
    join finds the later ones, and one join brings the covered positions back to their documents.
    """
    docs = packed(documents)
    found = windows(docs)
    first = found.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter(F.col("first") < F.col("last"))
    later = found.join(first.drop("last"), ["h1", "h2"]).filter(F.col("place") > F.col("first"))
    covered = later.groupBy(F.col("place.doc_id").alias("covered_id"), F.col("place.text_hash").alias("covered_hash")).agg(F.collect_set("place.pos").alias("starts"))
    # texts go into the join as lines, which the functions below then read by their place
    lined = docs.select("doc_id", "text_hash", "rest", F.split("text", "\n", -1).alias("lines"))
    joined = lined.join(covered, F.col("doc_id").eqNullSafe(F.col("covered_id")) & (F.col("text_hash") == F.col("covered_hash")), "left")
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + 2))))
    # a set difference of the positions, so a text's work is in proportion to its lines
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce(gone, F.array().cast("array<int>")))
    stay = F.transform(left, lambda i: F.get("lines", i))
    return joined.select(
        "doc_id",
        F.array_join(F.when(F.col("starts").isNull(), F.col("lines")).otherwise(stay), "\n").alias("text"),
        "rest",
        F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def line_dedup(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text and any other columns) with text deduplicated, and n_lines, n_removed (long).

    A column of documents that has one of these two names is replaced; without_repeated_lines() keeps it.
    """
    return unpacked(marked(documents), documents, "n_lines", "n_removed")


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """documents, all their columns kept, with text deduplicated; those that lose every line are gone."""
    return unpacked(marked(documents).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), documents)


def op1_line_dedup(spark, sf_dir):
    """Per document: doc_id, n_lines, n_removed and what is left of the text."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM w) WHERE rn > 1),
cov AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (VALUES (0), (1), (2)) v(d)),
lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept_text
         FROM lines LEFT JOIN cov USING (doc_id, pos) WHERE cov.doc_id IS NULL GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept_text, '') END AS kept_text
FROM l LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
