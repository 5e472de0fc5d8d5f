"""Row-level cleaning: keys, masking, kinds, deduplication. Nothing is deleted but copies."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import dedup_key, hash_reference, mask_handles, scrub_merchant
from ..runtime import broadcast_if_small, spread
from ..schema import SOURCE_ORDER


def add_keys(rows: DataFrame) -> DataFrame:
    """Dedup key, from the unmasked name."""
    return rows.withColumn("dedup_key", dedup_key(
        F.col("txn_date"), F.col("amount"), F.col("direction"),
        F.col("counterparty_raw"), F.col("reference_id")))


def add_reference_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reference_hash", hash_reference(F.col("reference_id")))


def add_scrubbed(rows: DataFrame, mask_first: bool = True) -> DataFrame:
    return rows.withColumn(
        "counterparty_normalized", scrub_merchant(F.col("counterparty_raw"), mask_first))


def mask_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("counterparty_raw", mask_handles(F.col("counterparty_raw")))


def apply_overrides(rows: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Replace canonical names by hand-made ones (``pattern``, ``merchant``); they win."""
    if overrides is None:
        return rows
    table = overrides.select(F.upper("pattern").alias("_name"), "merchant")
    joined = rows.join(
        broadcast_if_small(table), F.upper("counterparty_normalized") == F.col("_name"), "left")
    return joined.withColumn(
        "counterparty_normalized", F.coalesce("merchant", "counterparty_normalized")
    ).drop("_name", "merchant")


def read_overrides(spark, path: str) -> DataFrame | None:
    """Two-column CSV (pattern, merchant); a missing file means no overrides."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return None
    return spark.read.csv(path, header=True, schema="pattern string, merchant string")


def rule_kinds(
    rows: DataFrame, owner_terms: Sequence[str] = fv.OWNER_TERMS, whole_word: bool = False
) -> DataFrame:
    """``txn_kind`` by rule: owner terms first, then credit as refund or income."""
    terms = [re.escape(t.upper()) for t in owner_terms if t]
    pattern = "|".join(terms)
    if whole_word:
        pattern = rf"\b(?:{pattern})\b"
    credit = F.col("direction") == "credit"
    kind = (
        F.when(credit & F.lower("counterparty_raw").contains(fv.REFUND_WORD), "refund")
        .when(credit, "income")
        .otherwise("spend")
    )
    if terms:
        is_owner = F.col("counterparty_normalized").rlike(f"(?iu){pattern}")
        kind = F.when(is_owner, "self_transfer").otherwise(kind)
    return rows.withColumn("txn_kind", kind)


def first_of_each(
    rows: DataFrame, key: str = "dedup_key", order: Sequence[str] = tuple(SOURCE_ORDER),
    dealt: bool = False,
) -> DataFrame:
    """The first row per key in source order.

    Spark keeps only each task's first row per key before the shuffle, so a key with
    very many copies sends one row per task. It sorts a task's rows for that: they are
    spread before, unless they are ``dealt`` over tasks already, as those of a join are.
    """
    rows = rows if dealt else spread(rows, key, *order)
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
