from __future__ import annotations

import pytest
from pyspark.sql import functions as F

CLASHING = ["shard", "slot", "part", "row", "th", "hits", "items", "k", "bands", "low", "g", "found",
            "removed_lines", "line_no", "held_out", "length", "rank", "first", "Span"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with the given table's columns and clashing ones."""
    def make(rows, lang="en"):
        df = spark.createDataFrame(list(rows), "doc_id long, text string").select(
            "doc_id", "text", F.lit(lang).alias("lang"), F.lit("s").alias("source"),
            F.length("text").cast("long").alias("n_chars"))
        return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    return make


@pytest.fixture(scope="session")
def messy(make_docs):
    words = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return make_docs([(1, words), (1, words), (2, words), (3, None), (3, None), (4, ""), (None, words + " z"),
                      (None, None), (5, " \n\t "), (6, "…!?"), (7, long), (8, "ok"), (9, "\n\n" + words)])
