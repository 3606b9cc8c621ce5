"""Rows with nulls, ties, copies, very long texts and clashing names."""

import random

from pyspark.sql import types as T

WORDS = [f"w{i}" for i in range(400)]
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("key", T.StringType()), T.StructField("_stats", T.StringType()), T.StructField("bucket", T.LongType()),
    T.StructField("tokens", T.StringType()), T.StructField("_row", T.IntegerType())])


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def edited(text: str, at: int, word: str = "zzz") -> str:
    words = text.split(" ")
    words[at] = word
    return " ".join(words)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing names."""
    base = prose(1, 120)
    extra = ("k", "s", 7, "t", 3)
    rows = [
        (1, base, "en", "a", 10, *extra), (2, base, "en", "a", 10, *extra), (3, edited(base, 60), "en", "b", 10, *extra),
        (4, prose(2, 90), None, None, None, None, None, None, None, None), (5, None, "en", "a", 0, *extra), (6, "", "en", "a", 0, *extra),
        (7, " \n\t ", "de", "b", 3, *extra), (8, prose(3, 30_000), "de", "b", 1, *extra), (9, "one two", "de", "c", 7, *extra),
        (9, "one two", "de", "c", 7, *extra), (9, prose(4, 70), "de", "c", 7, *extra), (None, prose(5, 80), "en", "c", 5, *extra),
        (None, prose(6, 80), "en", "c", 5, *extra), (10, "é " * 200, "fr", "c", 400, *extra), (11, "x" * 50_000, "fr", "c", 9, *extra)]
    return rows + [(100 + i, prose(100 + i, 60 + i), "en" if i % 2 else "de", "a" if i % 3 else "d", 1, *extra) for i in range(20)]
