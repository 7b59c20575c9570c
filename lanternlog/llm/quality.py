"""Quality rules by tokeniser fertility: what a public vocabulary makes of a text, with rejection bands per language.

For each text a public subword vocabulary with byte fallback gives characters per token, the share of tokens that are
fallback bytes, and the entropy of its tokens over the most that so many tokens can have. Robust bands (median and
median absolute deviation over all documents that pass the base rules) are kept for each language and, for documents
without a usable language, for each script, by length class; a text outside its band in any measure is rejected.

Defined cases: a null or blank text has no words and fails the base rules; a null lang, and a language
with fewer than ``min_docs`` documents, goes by script; a script with fewer keeps all; repeated rows are judged alike;
an empty table gives an empty result. Words are cut at the six ASCII white-space characters and encoded one by one, so a
task holds one block of texts and a bounded table of words, however long the texts are. Columns besides those that an operator names are not read by it, or
are handed on as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, WordTable, blocks, cut_lineage, ship_package, table
from .tokens import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
#: FIXED VALUES: the base rules of the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: First code points of scripts' main blocks, in order; below the first: Latin.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0xAC00, 0xD7B0]
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "indic", "thai", "hangul", "latin", "greek", "other", "cjk", "hangul", "other"]

MEASURES = ("chars_per_token", "byte_share", "entropy")
#: The least half-width of a band in each measure: bands of a very even language must not reject ordinary texts.
LEAST_WIDTH = {"chars_per_token": 0.08, "byte_share": 0.02, "entropy": 0.02}

SCHEMA = (
    "doc_id long, k1 long, k2 long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more, the first time included."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
        keys = (pair[:-1] << 32) | ids[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(keys, twice)
    cover = np.zeros(len(ids), bool)
    for k in range(3):
        cover[k : k + len(hit)] |= hit
    return int(cover.sum())


def measurer(path: str):
    """A function of batches for mapInArrow; the vocabulary is loaded once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])

        def derive(new: list[bytes]) -> list[np.ndarray]:
            texts = [w.decode() for w in new]
            tokens = model.encode(texts, num_threads=1)
            flat = np.fromiter((x for t in tokens for x in t), np.int32)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            owner = np.repeat(np.arange(len(tokens)), sizes)
            points = np.fromiter((ord(next((c for c in t if c.isalpha()), "\x00")) for t in texts), np.int64, len(texts))
            script = np.where(points == 0, -1, np.searchsorted(SCRIPT_STARTS, points, "right") - 1)
            kept = held[0] if words.values else np.zeros(0, np.int32)  # starts anew with the table
            held[0] = np.concatenate([kept, flat])
            return [sizes, np.bincount(owner, is_byte[flat], len(tokens)), script, len(kept) + np.cumsum(sizes) - sizes]

        held = [np.zeros(0, np.int32)]
        words = WordTable(derive)
        for doc_ids, k1, k2, langs, texts in blocks(batches, 3_000_000):
            raw = [t.encode() for t in texts]
            split = [b.split() for b in raw]
            ids = words.numbers(split)
            ends = np.cumsum([len(s) for s in split])
            rows = []
            for *own_keys, lang, text, b, start, end in zip(doc_ids, k1, k2, langs, texts, raw, [0, *ends[:-1]], ends, strict=True):
                own = ids[start:end]
                spaces = len(b) - len(b.translate(None, WORD_SPACE.encode()))
                lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
                n_tokens, entropy, share, script = 0, 0.0, 0.0, -1
                if len(own):
                    sizes, n_bytes, scripts, starts = (v[own] for v in words.values)
                    n_tokens = int(sizes.sum())
                    tokens = held[0][np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(n_tokens)]
                    share = float(n_bytes.sum() / n_tokens) if n_tokens else 0.0
                    counts = np.bincount(tokens)
                    counts = counts[counts > 0]
                    if n_tokens > 1:
                        entropy = float(1 - (counts * np.log(counts)).sum() / n_tokens / np.log(n_tokens))
                    letters = scripts[scripts >= 0]
                    script = int(np.bincount(letters).argmax()) if len(letters) else -1
                chars = len(text) - spaces
                rows.append(
                    (*own_keys, lang, SCRIPT_NAMES[script] if script >= 0 else "none", len(own), chars, len(b) - len(b.translate(None, SYMBOLS)),
                     len(lines) - len(set(lines)), repeat_words(own), n_tokens, chars / n_tokens if n_tokens else 0.0, share, entropy)
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

    return run


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def row_key(lang) -> list:
    """128 bits, never null, that name what a document's verdict depends on."""
    return [F.xxhash64("doc_id", "text", lang).alias("k1"), F.xxhash64(F.lit("second"), "text", lang, "doc_id").alias("k2")]


def quality_features(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a document, without a shuffle: the base counts and the three fertility measures."""
    ship_package(documents.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(F.col("doc_id").cast("long"), *row_key(lang), lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.mapInArrow(measurer(vocabulary_path(vocabulary)), SCHEMA).withColumns({"base_failed": base_failed, "length_class": F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")})


def bands(features: DataFrame, keys: list[str], measures: tuple[str, ...], width: float, min_docs: int) -> DataFrame:
    """For every value of keys that min_docs documents have: the lower and upper bound of the measures; others have none."""
    usable = features.filter(~F.col("base_failed")).dropna(subset=keys)
    middle = usable.groupBy(*keys).agg(F.count("*").alias("n"), *(F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000).alias(m) for m in measures))
    # half the distance between the quartiles is the median absolute deviation of an even distribution
    half = {m: F.greatest(width * 1.4826 * (F.col(m)[2] - F.col(m)[0]) / 2, F.lit(LEAST_WIDTH[m])) for m in measures}
    none = F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    limits = F.struct(*((F.struct((F.col(m)[1] - half[m]).alias("low"), (F.col(m)[1] + half[m]).alias("high")) if m in measures else none).alias(m) for m in MEASURES))
    return middle.filter(F.col("n") >= min_docs).select(*keys, limits.alias("_".join([*keys, "band"])))


def quality_rules(documents: DataFrame, *, vocabulary: str = VOCABULARY, width: float = 6.0, min_docs: int = 20, most_broadcast: int = 5000) -> DataFrame:
    """Per document the features, base_failed, kept, and the measures that rejected it.

    A band holds for texts of one language (or script) whose token counts have the same power of two, as short texts
    scatter more. Where there are too few of a length, the language's band over all lengths holds, without the entropy,
    which falls with length. Up to ``most_broadcast`` bands of a kind are broadcast, more are joined by their keys, with
    the same result.
    """
    features = cut_lineage(quality_features(documents, vocabulary))
    kinds = [(["lang", "length_class"], MEASURES), (["script", "length_class"], MEASURES), (["lang"], MEASURES[:2]), (["script"], MEASURES[:2])]
    joined = features
    for keys, measures in kinds:
        own = cut_lineage(bands(features, keys, measures, width, min_docs))
        joined = joined.join(F.broadcast(own) if own.count() <= most_broadcast else own.hint("shuffle_merge"), keys, "left")
    by_lang, by_script, all_lang, all_script = ("_".join([*keys, "band"]) for keys, _ in kinds)
    joined = joined.withColumn("band", F.coalesce(by_lang, all_lang, by_script, all_script))
    outside = [F.when(~F.col(m).between(F.col(f"band.{m}.low"), F.col(f"band.{m}.high")), F.lit(m)) for m in MEASURES]
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return joined.withColumn("rejected_by", F.array_compact(F.array(*outside))).withColumn("kept", kept).drop(by_lang, by_script, all_lang, all_script, "band")


def kept_documents(documents: DataFrame, **settings) -> DataFrame:
    """The documents that are kept, with all their columns."""
    keep = quality_rules(documents, **settings).filter("kept").select("k1", "k2").distinct()
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.struct("*").alias("row"), *row_key(lang)).join(keep, ["k1", "k2"], "left_semi").select("row.*")


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "byte_share", "entropy"
    )
