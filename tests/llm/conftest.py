import random

import pytest
from pyspark.sql import functions as F


def words(rng, n, lang="en"):
    """Invented words of a language's syllables."""
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ing"], "de": ["sch", "ein", "ung", "ich", "tz", "ver", "keit", "ü", "ß", "pf"], "fr": ["eau", "oi", "é", "è", "tion", "que", "ai", "ment", "eux", "ou"]}[lang]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, n, lang="en"):
    w = words(rng, n, lang)
    return " ".join(x + (".\n" if k % 11 == 10 else "") for k, x in enumerate(w))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank and very long texts, ties, repeated rows, a clash of names, an extra column."""
    rng = random.Random(1)
    long = prose(rng, 40_000)
    rows = [(1, None, None, None), (None, "the words of nobody", "en", "s"), (2, "", "en", "s"), (3, " \n\t ", "fr", "s"), (4, long, "en", "s"), (5, "twice", "en", "s"), (5, "twice", "en", "s"), (6, "x" * 300_000, "de", None), (7, "1 2 3", None, "s"), (8, prose(rng, 80, "de"), "de", "s"), (9, "\x00\x1c é", "fr", "s")]
    clash = ["quality", "toxic", "__kept", "kept", "held_out", "lang_pred", "key", "class_id", "label", "known", "lot", "words", "word", "item_id", "times", "a.b", "grade"]
    d = spark.createDataFrame([(*r, 9.5, "clash", "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, score double, id string, row string, n_chars long")
    return d.select("*", *[F.lit("clash").alias(c) for c in clash])
