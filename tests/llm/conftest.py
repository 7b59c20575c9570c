import random

import pytest

SYLLABLES = "the an in er on re ti es or ed nd at en ha is st th ou ly".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def text(rng, lines=6, words=14):
    return "\n".join(sentence(rng, words) for _ in range(lines))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators might use themselves.
CLASHING = [
    "row", "rest", "k1", "k2", "gone", "lines", "words", "keys", "id", "slot", "p", "pos", "node", "label", "first", "text_hash", "band", "features", "n_lines", "n_removed", "starts", "place", "script", "kept",
    "class_id", "is_first", "key", "n", "spans", "is_copy", "held_out", "fold", "labels", "ids", "before", "fill", "pieces", "kind", "match", "start", "end", "encoding", "item_id", "distance", "page_id", "url", "html", "hex", "gz",
]


def corpus():
    """Prose in two invented languages with exact and near copies, shared passages, ties, repeated rows, nulls, blanks."""
    rng = random.Random(7)
    rows = [(i, text(rng), "en" if i % 3 else "xx", "s0") for i in range(40)]
    rows += [(40 + i, rows[i][1], rows[i][2], "s1") for i in range(6)]  # exact copies
    for i in range(8):  # near copies: one word changed
        words = rows[10 + i][1].split(" ")
        words[5] = "changed"
        rows.append((50 + i, " ".join(words), "en", "s2"))
    passage = sentence(rng, 60)
    rows += [(60 + i, text(rng, 2) + "\n" + passage + "\n" + text(rng, 2), "en", "s3") for i in range(8)]  # one shared passage
    rows += [(70, None, None, None), (71, "", "en", "s4"), (72, "  \n\t ", None, "s4"), (None, text(rng), "en", None), (None, rows[3][1], None, "s5")]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(5, text(rng), "en", "s6")]  # one id with two texts
    rows += [(80, " ".join(["again"] * 3000), "en", "s7"), (81, text(rng, 400, 20), "en", "s7")]  # one word, and a long text
    rows += [(82, "Ünïcödé ☃ 日本語テスト 😀 " * 20, "ja", "s8"), (83, "a\r\nb\r\nc\r\na\r\nb\r\nc", None, "s8"), (84, "one two", "en", "s8")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(1).alias(c) for c in CLASHING))
