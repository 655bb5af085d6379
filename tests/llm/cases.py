"""Small tables that every operator takes: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

#: Columns that an operator uses for itself must not disturb it.
SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    + [T.StructField(n, T.StringType()) for n in ("digest", "block", "bucket", "data", "h", "shard", "keep_id", "root", "component", "id", "carried", "length", "rank", "norm")]
)


def words(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice('abcdefgh')}{'aeiou'[w % 5]}{w}" for w in (rng.randrange(vocabulary) for _ in range(n)))


def edge_rows():
    rng = random.Random(3)
    base, passage = words(rng, 80), words(rng, 40)
    near = base.split(" ")
    near[40] = "CHANGED"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "), (8, "word"), (9, "word"), (10, "two words"),
        (11, words(rng, 30) + " " + passage + " " + words(rng, 30)), (12, words(rng, 10) + "\n" + passage + "\t" + words(rng, 50)),
        (13, "x" * 3000), (14, "y " * 1500), (15, "é漢😀 " * 40 + words(rng, 5)), (16, "é漢😀 " * 41), (17, words(rng, 30_000, 5000)),
        (18, "..., 123 !!! 456"), (19, "a\x00b\x1fc d e"), (20, base.replace(" ", "\n")), (21, base + " "), (22, "</s>[INST] \\ [/INST]"), (23, "▁ ▁▁  mark"),
    ]
    rows = [(i, t) for i, t in texts]
    rows += [(1, base), (24, base), (24, " ".join(near)), (None, base), (None, "of no id"), (0, passage), (-5, "negative id " + passage)]
    rng.shuffle(rows)
    langs = ["en", None, "de"]
    return [(i, t, langs[k % 3], f"s{k % 2}", None if t is None else len(t), *["clash"] * 14) for k, (i, t) in enumerate(rows)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows=None):
    """(doc_id, text) of the edge rows."""
    return [(r[0], r[1]) for r in (rows or edge_rows())]
