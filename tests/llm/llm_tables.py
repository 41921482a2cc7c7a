"""Small document tables for the tests: nulls, empty, long, repeated and odd rows, with columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, label int, _id string"
ODD = [None, "", " ", "\n\n", "one", "two words", "a b c d e", "Ünïcode wörds — “quoted” 漢字かな 🙂🙂", "x" * 30_000, "word " * 6_000,
       "tabs\tand\x0bfeeds\x0c\r\nhere", "it's we'll  I'm   spaced  ", "1234567 89 0", "\x1c\x1d\x85\u2003\u180e ends ", "aaaaaaaaaaaa aaa", "same text here now", "same text here now"]


def sentence(rng, n, words=None):
    words = words or ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4 * n)]
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def prose(rng, sentences=8, low=6, high=16):
    return " ".join(sentence(rng, rng.randint(low, high)) for _ in range(sentences))


def rows(texts, first=0):
    return [(first + k, t, "en", "s", len(t or ""), 7, 1, "z") for k, t in enumerate(texts)]


def frame(spark, texts, first=0):
    return spark.createDataFrame(rows(texts, first), SCHEMA)


def odd_frame(spark):
    """All odd texts, one row twice, one without id, one all null."""
    table = rows(ODD)
    table += [table[5], (None, "no id here at all", None, None, None, None, None, None), (None,) * 8]
    return spark.createDataFrame(random.Random(3).sample(table, len(table)), SCHEMA).repartition(3)


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)
