"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows,
and extra columns whose names clash with those an operator makes."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # clashes
        T.StructField("score", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("cls", T.StringType()),
        T.StructField("place", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("found", T.StringType()),
        T.StructField("lang_pred", T.StringType()),
    ]
)


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def odd_rows():
    shared = " ".join(words(1, 70))
    near = words(2, 300)
    changed = [*near]
    changed[150] = "other"
    texts = [
        (0, " ".join(words(3, 40))),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "x " + shared + " y"),
        (5, shared + "  \n z"),
        (6, " ".join(near)),
        (7, " ".join(changed)),
        (8, " ".join(near)),
        (8, " ".join(near)),  # a repeated row
        (9, "short"),
        (10, "Reach me at ann.lee@example.com or 10.0.0.300, 10.0.0.3; card 4111 1111 1111 1111."),
        (11, "call +1 (310) 555-4510 a@b.c%x@d.e 4111111111111112 1.2.3.4.5.6.7.8 ü@é.com ÄÖ@q.org"),
        (12, " ".join(words(4, 30_000)) + " " + shared),  # very long
        (13, "中文 текст ½ ² á ß × ÷ a×b  c d İstanbul \U0001f600."),
        (14, "12345 !!! ###"),
        (15, "word " * 200),
        (None, "no id, CC-BY; all RIGHTS reserved. GNU General Public License"),
        (None, None),
    ]
    return [
        (i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), *["x"] * 7)
        for k, (i, t) in enumerate(texts)
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
