"""Fixtures shared by the tests of this folder."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
EXTRA = ["band", "gram", "segment", "h", "keep", "spans", "often", "size", "bin", "group_id", "label", "score", "number", "wanted", "quality", "start", "end", "n"]


def words(text):
    """Words as the kernels cut them."""
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy(spark, texts=()):
    """Nulls in every column, empty and very long texts, repeated rows, and columns of clashing names."""
    rng = random.Random(5)
    long = prose(rng, 60_000, 50_000)
    rows = [(1, prose(rng, 80), "en", "a", 10), (2, None, "en", None, None), (None, prose(rng, 80), None, "a", 5), (3, "", None, None, 0), (4, long, "fr", "b", len(long)), (4, long, "fr", "b", len(long)), (5, "... !!", "fr", "b", 6), (None, None, None, None, None), (6, "one", "en", "a", 3)]
    rows += [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA)))


def empty(spark):
    return spark.createDataFrame([], DOCS)
