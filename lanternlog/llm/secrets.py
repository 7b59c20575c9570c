"""Secret scans, with DataFrame functions only: base patterns, and a battery of randomness tests on token-like strings.

Token-like runs of at least ``LEAST`` characters are cut out and an encoding is inferred for each: the smallest of hex,
base32, base36, letters, base62 and base64 whose characters it keeps to and whose kinds of characters it mixes (words
in letters of one case are no encoding). A run without one, such as a path with a key in it, is cut at its marks, and
its parts of ``LEAST`` characters are tokens of their own. Three tests then ask whether its symbols could be uniformly random: chi-squared
over the alphabet, runs above and below the alphabet's middle, and serial correlation of neighbours. Chi-squared over
equally likely symbols says how many pairs of places agree, and its chance is exact up to ``EXACT`` characters, from a
table of all lengths; beyond, it is that of a gamma with the same three moments (Wilson and Hilferty). The other two are
normal deviates with the moments for the token's own length; normal tails keep ten digits however small they are. The
smallest of the three p-values, corrected for three tests, is the token's. Within each encoding and length class the Benjamini-Hochberg rule then dismisses tokens as not random, so
that of those dismissed at most a share ``q`` were random; what is not dismissed is reported.

p-values are counted in a fixed grid of bins, so the false-discovery step is one aggregation over all tokens and a
table of bounded size, whatever the corpus is. Positions come from the lengths of the parts between the matches.

Defined cases: a null text is empty; an empty table gives an empty result; repeated rows are one document and get the
same spans; positions are code points, ends exclusive. Very long texts and tokens are matched as they are, in columns.
Columns besides those that an operator names are not read by it, or are handed on as they are, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from numpy.polynomial import Chebyshev, Polynomial
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, table, text_key

#: FIXED VALUES: the base kinds in order, their patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # at least one character after AKIA and 20 in all: a run is taken whole either way
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ["assign", "access", "hex", "random"]

LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding, alphabet, what a whole token must match; the first that fits is inferred.
ENCODINGS = [
    ("hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    ("base32", UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", DIGITS + LOWER, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("BASE36", DIGITS + UPPER, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    ("letters", UPPER + LOWER, r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$"),
    ("base62", UPPER + LOWER + DIGITS, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$"),
    ("base64", UPPER + LOWER + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$"),
    ("base64url", UPPER + LOWER + DIGITS + "-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$"),
]
EXACT = 64  # characters up to which chances of repeated symbols are exact
LEAST_P = 1e-17
BINS, BIN_WIDTH = 320, 0.05  # of -log10 p


def matches(kind: str, pattern: str) -> Column:
    """The matches of one pattern: kind, the number of code points since the one before, and the text."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split("text", pattern, -1), 1, F.size(found))
    rows = F.zip_with(gaps, found, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), m.alias("match")))
    # texts without a match are most; they are searched once
    return F.when(F.col("text").rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,gap:int,match:string>>"))


def spans_of(docs: DataFrame) -> DataFrame:
    """A row for each match of each pattern, with its place; base matches that are too short are gone."""
    rows = docs.select("doc_id", "text_hash", F.explode(F.array(*(F.transform(matches(k, p), lambda x, i: F.struct(i.alias("i"), x.alias("x"))) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)))).alias("m"))
    flat = rows.select("doc_id", "text_hash", F.explode("m").alias("m")).select("doc_id", "text_hash", "m.x.kind", "m.i", "m.x.gap", "m.x.match").distinct()
    before = W.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("match")
    end = F.sum(F.col("gap") + size).over(before)
    placed = flat.select("doc_id", "text_hash", "kind", "match", (end - size).alias("start"), end.alias("end"))
    return placed.filter((F.col("kind") != "assign") | (F.length(F.regexp_extract("match", f"^{ASSIGN}$", 1)) >= LEAST_ASSIGNED))


@lru_cache
def repeat_tails(k: int, longest: int = EXACT) -> list[list[float]]:
    """For each length up to ``longest``: the chances that at least 0, 1, 2, ... pairs of its places agree, of k equally likely symbols.

    Symbols are added one by one: with c places of its own, one adds c (c - 1) / 2 pairs, and 1 / c! ways. Chances under
    LEAST_P are left out.
    """
    most = max(longest * longest // 5, 50)  # more pairs have no chance that a double shows beside LEAST_P
    ways = np.zeros((longest + 1, most))
    ways[0, 0] = 1
    for _ in range(k):
        more = np.zeros_like(ways)
        for c in range(longest + 1):
            pairs = c * (c - 1) // 2
            if pairs < most:
                more[c:, pairs:] += ways[: longest + 1 - c, : most - pairs] / math.factorial(c)
        ways = more
    tails = np.cumsum((ways / ways.sum(axis=1, keepdims=True))[:, ::-1], axis=1)[:, ::-1]
    return [[float(p) for p in row[row >= LEAST_P]] for row in tails]


@lru_cache
def tail_terms(degree: int = 14) -> list[float]:
    """Powers of t = 1 / (1 + x / 2) that give ln(erfc(x) / t) + x^2, fitted where a double has erfc(x), to x = 9."""
    of = np.vectorize(lambda t: math.log(math.erfc(2 / t - 2) / t) + (2 / t - 2) ** 2)
    return [float(a) for a in Chebyshev.interpolate(of, degree, domain=[1 / 5.5, 1]).convert(kind=Polynomial).coef]


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to ten digits of its value, and not under that of 12."""

    def half(x: Column) -> Column:
        t = F.lit(1.0) / (1 + x / 2)
        power = F.aggregate(F.array(*map(F.lit, reversed(tail_terms()))), F.lit(0.0), lambda s, a: s * t + a)
        return t * F.exp(power - x * x) / 2

    # within the function a deviate is a name; written out, its expression would stand in the plan for each use of it
    tail = lambda z: F.when(z > 0, half(F.least(z, F.lit(12.0)) / math.sqrt(2))).otherwise(1 - half(F.least(-z, F.lit(12.0)) / math.sqrt(2)))
    return F.get(F.transform(F.array(z), tail), F.lit(0))


def gamma_tail(z: Column, skewness: Column) -> Column:
    """The tail of a gamma with deviate z and a skewness, by Wilson and Hilferty's cube root."""
    root = F.pow(F.greatest(1 + skewness * z / 2, F.lit(0.0)), F.lit(1 / 3))
    return upper_tail((root - 1 + skewness * skewness / 36) * 6 / skewness)


def exact_tails(spark) -> DataFrame:
    """repeat_tails as rows (k, n, tails), a row for each size of alphabet and length."""
    sizes = sorted({len(symbols) for _, symbols, _ in ENCODINGS})
    rows = [(float(k), float(n), tails) for k in sizes for n, tails in enumerate(repeat_tails(k)) if n >= LEAST]
    return spark.createDataFrame(rows, "k double, n double, tails array<double>")


def inferred(tokens: DataFrame) -> DataFrame:
    """tokens with bare (the match without padding), encoding and its alphabet, both null where none fits."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    bare = F.rtrim(F.col("match"), F.lit("="))
    for name, symbols, pattern in reversed(ENCODINGS):
        encoding = F.when(bare.rlike(pattern), F.lit(name)).otherwise(encoding)
        alphabet = F.when(bare.rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    return tokens.withColumns({"encoding": encoding, "alphabet": alphabet, "bare": bare})


def parts_of(tokens: DataFrame) -> DataFrame:
    """The parts of LEAST characters or more between a token's marks, with their places."""
    cut = tokens.withColumn("token_start", F.col("start")).select("doc_id", "text_hash", "kind", "token_start", F.posexplode(F.regexp_extract_all("match", F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))).alias("i", "match"))
    before = W.partitionBy("doc_id", "text_hash", "token_start").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("token_start") + F.sum(F.length("match")).over(before)
    placed = cut.select("doc_id", "text_hash", "kind", "match", (end - F.length("match")).alias("start"), end.alias("end"))
    return placed.filter(F.length("match") >= LEAST)


def tokens_of(tokens: DataFrame) -> DataFrame:
    """Tokens with an encoding: those that have one as they stand, and the parts of the others that do."""
    found = inferred(tokens)
    whole = found.filter("encoding IS NOT NULL")
    rest = found.filter(F.col("encoding").isNull() & F.col("bare").rlike("[^A-Za-z0-9]")).drop("encoding", "alphabet", "bare")
    return whole.unionByName(inferred(parts_of(rest)).filter("encoding IS NOT NULL"))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (match, ...) with encoding, n and p, the chance that random symbols look as uneven."""
    known = tokens_of(tokens)
    codes = F.transform(F.split("bare", ""), lambda c: (F.instr(F.col("alphabet"), c) - 1).cast("double"))
    known = known.withColumns({"codes": codes, "n": F.length("bare").cast("double"), "k": F.length("alphabet").cast("double")})
    n, k = F.col("n"), F.col("k")
    zero = F.lit(0.0)
    # symbols and their counts: a symbol's count is what its removal takes from the length
    squares = F.aggregate(F.array_distinct(F.split("bare", "")), zero, lambda s, c: s + F.pow(n - F.length(F.replace(F.col("bare"), c, F.lit(""))), F.lit(2.0)))
    # chi-squared is k - n + 2 k / n x the pairs of places that agree; their first three moments are exact
    agreeing = ((squares - n) / 2).cast("long")  # of a long token more than an int holds
    all_pairs, one = n * (n - 1) / 2, 1 / k
    spread_of = all_pairs * one * (1 - one)
    third = spread_of * (1 - 2 * one) + n * (n - 1) * (n - 2) * one * one * (1 - one)
    z_chi = (F.col("agreeing") - 0.5 - all_pairs * one) / F.sqrt(spread_of)
    # one row for each size of alphabet and length: a few hundred, whatever the corpus is
    known = known.withColumn("agreeing", agreeing).join(F.broadcast(exact_tails(tokens.sparkSession)), ["k", "n"], "left")
    p_chi = F.when(n <= EXACT, F.coalesce(F.get("tails", F.col("agreeing").try_cast("int")), F.lit(LEAST_P))).otherwise(gamma_tail(z_chi, third / F.pow(spread_of, F.lit(1.5))))
    above = F.aggregate("codes", zero, lambda s, c: s + F.when(c >= k / 2, 1.0).otherwise(0.0))
    following = F.slice("codes", 2, F.length("bare"))
    pairs = F.slice(F.zip_with("codes", following, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, F.length("bare") - 1)
    half = k / 2
    changes = F.aggregate(pairs, zero, lambda s, p: s + F.when((p["a"] >= half) != (p["b"] >= half), 1.0).otherwise(0.0))
    mean = F.aggregate("codes", zero, lambda s, c: s + c) / n
    known = known.withColumns({"p_chi": p_chi, "above": above, "changes": changes, "mean": mean, "pairs": pairs})
    below = n - F.col("above")
    spread = 2 * F.col("above") * below
    variance = spread * (spread - n) / (n * n * (n - 1))
    z_runs = F.when(variance > 0, F.abs(F.col("changes") + 1 - (spread / n + 1)) / F.sqrt(variance)).otherwise(12.0)
    products = F.aggregate("pairs", zero, lambda s, p: s + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    total = F.aggregate("codes", zero, lambda s, c: s + (c - F.col("mean")) * (c - F.col("mean")))
    z_serial = F.when(total > 0, F.abs(products / total + 1 / n) * F.sqrt(n)).otherwise(12.0)
    least = F.least(F.col("p_chi"), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial))
    p = -F.expm1(3 * F.log1p(-F.least(least, F.lit(1 - 1e-12))))
    return known.withColumn("p", p).drop("codes", "pairs", "alphabet", "p_chi", "agreeing", "tails", "above", "changes", "mean", "bare")


def dismissed_below(tested: DataFrame, q: float) -> DataFrame:
    """For each encoding and length class the p-bin from which on tokens are dismissed (Benjamini-Hochberg at q)."""
    counts = tested.groupBy("encoding", "length_class", "p_bin").agg(F.count("*").alias("n_bin"))
    kinds = W.partitionBy("encoding", "length_class")
    ranked = counts.withColumns({"rank": F.sum("n_bin").over(kinds.orderBy(F.col("p_bin").desc()).rowsBetween(W.unboundedPreceding, 0)), "m": F.sum("n_bin").over(kinds)})
    largest_p = F.pow(F.lit(10.0), -F.col("p_bin") * BIN_WIDTH)
    return ranked.filter(largest_p <= q * F.col("rank") / F.col("m")).groupBy("encoding", "length_class").agg(F.min("p_bin").alias("from_bin"))


def find_secrets(documents: DataFrame, *, q: float = 0.05) -> DataFrame:
    """All spans: doc_id, text_hash, kind, start, end, match. Of equal ranges the base kind stays."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_hash"))
    placed = spans_of(docs)
    tested = battery(placed.filter(F.col("kind") == "random")).withColumns(
        {
            "length_class": F.least(F.floor(F.log2("n") * 2), F.lit(40)).cast("int"),
            "p_bin": F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-16))) / BIN_WIDTH), F.lit(BINS)).cast("int"),
        }
    )
    # at most one row for each of eight encodings and forty length classes
    limits = F.broadcast(dismissed_below(tested, q))
    random = tested.join(limits, ["encoding", "length_class"], "left").filter(F.col("from_bin").isNull() | (F.col("p_bin") < F.col("from_bin")))
    columns = ["doc_id", "text_hash", "kind", "start", "end", "match"]
    everything = placed.filter(F.col("kind") != "random").select(columns).unionByName(random.select(columns))
    taken = W.partitionBy("doc_id", "text_hash", "start", "end")
    return everything.withColumn("base", F.max(F.when(F.col("kind") != "random", 1)).over(taken)).filter((F.col("kind") != "random") | F.col("base").isNull()).drop("base")


def secret_report(documents: DataFrame, *, q: float = 0.05) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (as kind:start:end)."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("o"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("said"))
    spans = find_secrets(documents, q=q).groupBy(F.col("doc_id").alias("span_doc"), F.col("text_hash").alias("span_hash")).agg(F.array_sort(F.collect_list(item)).alias("all"))
    docs = packed(documents).select("doc_id", "text_hash")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("span_doc")) & F.col("text_hash").eqNullSafe(F.col("span_hash")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,o:bigint,end:bigint,said:string>>"))
    joined = joined.withColumn("all", every)
    count = lambda o: F.size(F.filter("all", lambda x: x["o"] == o)).cast("long")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), ",")
    base = F.filter("all", lambda x: x["o"] < len(KINDS))
    return joined.select("doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))


def op10_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))
