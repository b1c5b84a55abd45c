"""Awkward documents that every operator must take, and plain versions to hold results against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ("row_id", "size", "place", "key", "cell", "hash", "bytes", "digest", "kept", "base", "added", "fp", "component", "score", "votes", "block", "component_id", "copies", "dims", "rank", "vec_id2")


def awkward():
    long = "word " * 30_000 + "token = 'Abcdefghijklmnop123' x@y.example.com"
    return [
        (1, "the same text here again and more", "en", "s1", 33),
        (2, "The Same TEXT here again and more", "en", "s2", 33),
        (3, None, "en", "s1", None),
        (4, "", None, "s1", 0),
        (5, "   \t\n ", "en", None, 6),
        (6, long, "en", "s2", len(long)),
        (7, "ünï çødé 😀 ÀB \x00 end", "de", "s3", 20),
        (7, "ünï çødé 😀 ÀB \x00 end", "de", "s3", 20),
        (None, "no id at all", "en", "s1", 12),
        (None, "no id at all", "en", "s1", 12),
        (None, None, None, None, None),
        (8, "x", "en", "s4", 1),
        (9, "a b", "en", "s4", 3),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(spark, rows=None):
    df = frame(spark, rows)
    for name in CLASHES:
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def plain_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def prose(seed, n):
    rng = random.Random(seed)
    words = ["an", "ther", "ing", "on", "the", "re", "st", "ou", "lich", "ción"]
    return [" ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))) + "." for _ in range(n)]
