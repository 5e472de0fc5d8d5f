"""Score one reading of a statement period against another, as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv

KEY = ["day", "amount", "direction"]


def keyed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.to_date("txn_date").alias("day"),
        F.col("amount").cast("decimal(14,2)").alias("amount"), "direction")


def key_counts(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    """How often each key occurs on either side: one union, one aggregation, no join, so a
    key that fills a third of the rows is summed before it moves."""
    sides = keyed(truth).withColumns({"t": F.lit(1), "p": F.lit(0)}).unionByName(
        keyed(parsed).withColumns({"t": F.lit(0), "p": F.lit(1)}))
    return sides.groupBy(*KEY).agg(
        F.sum("t").cast("bigint").alias("n_truth"), F.sum("p").cast("bigint").alias("n_parsed"))


def reconcile_summary(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    t, p = F.col("n_truth"), F.col("n_parsed")
    zero = F.lit(0)
    sums = key_counts(truth, parsed).agg(*[
        F.coalesce(F.sum(c), zero).cast("bigint").alias(n) for c, n in [
            (t, "total_truth"), (p, "total_parsed"), (F.least(t, p), "matched"),
            (F.greatest(t - p, zero), "misses"), (F.greatest(p - t, zero), "false_positives")]])
    rate = F.coalesce(F.try_divide(F.col("matched"), F.col("total_truth")), F.lit(0.0))
    return sums.withColumn("match_rate", rate).withColumn(
        "meets_target", F.col("match_rate") >= fv.RECONCILE_TARGET)


def reconcile_misses(truth: DataFrame, parsed: DataFrame, limit: int = fv.SAMPLE_MISSES) -> DataFrame:
    """First keys of the truth that the other side lacks, and how often."""
    lacking = key_counts(truth, parsed).withColumn(
        "n_missing", F.col("n_truth") - F.col("n_parsed")).filter("n_missing > 0")
    return lacking.select(*KEY, "n_missing").orderBy(*KEY).limit(limit)


def common_rows(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    return keyed(truth).intersectAll(keyed(parsed))


def missing_rows(truth: DataFrame, parsed: DataFrame) -> DataFrame:
    return keyed(truth).exceptAll(keyed(parsed))
