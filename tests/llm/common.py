"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, rule string, n int, component string, _size int"


def table(spark, rows, parts=3):
    """Documents of (doc_id, text, lang, source), with columns beside them whose names the operators use too."""
    full = [(i, t, g, s, None if t is None else len(t), "x", "y", "z", 1, "c", 7) for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd(long=30_000):
    """Rows that any operator must survive."""
    big = words(long, 99)
    return [
        (None, "no id here but some words to read", "en", "a"), (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, "one", "en", "b"),
        (5, big, "en", "b"), (6, words(60, 1), "en", "c"), (6, words(60, 1), "en", "c"), (7, words(60, 1), "fr", None), (8, "é" * 50 + " ÄÖ  x", "de", "c"), (8, "other text of the same id", "de", "c"),
        (9, "x" * 5000, "en", "a"), (10, "\x00\x01 odd bytes \U0001f600", "en", "a"), (11, "... !!! ,,,", "en", "a"),
    ]
