"""Behaviour features of spend rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import any_of, micros
from ..runtime import durable


def calendar_features(rows: DataFrame) -> DataFrame:
    """log amount, weekday on the circle (Monday first), position in the month."""
    angle = F.weekday("txn_date") * F.lit(2 * math.pi / 7)
    return rows.withColumns({
        "log_amount": F.log1p(F.col("amount").cast("double")),
        "dow_sin": F.sin(angle),
        "dow_cos": F.cos(angle),
        "day_of_month_norm": F.day("txn_date") / F.day(F.last_day("txn_date")),
    })


def merchant_days(rows: DataFrame, merchant: str, id_col: str) -> DataFrame:
    """One row per merchant and calendar day, with the merchant's totals beside it.

    Two rows of one day are never a whole day apart, so gaps between days carry every
    recency and every cadence; a merchant with very many rows shrinks to its active days
    before it meets in one task.
    """
    amount = F.col("amount").cast("double")
    ts = F.col("txn_date")
    per_day = rows.groupBy(merchant, F.to_date("txn_date").alias("day")).agg(
        F.count("*").alias("n"),
        F.avg(amount).alias("mean"),
        F.var_pop(amount).alias("var"),
        F.min(F.struct(micros(ts).alias("t"), F.col(id_col).alias("id"))).alias("first"),
        F.max(micros(ts)).alias("last_t"),
    )
    by_merchant = Window.partitionBy(merchant)
    in_order = by_merchant.orderBy("day")
    day_us = F.lit(86_400_000_000)
    gap = F.floor((F.col("first.t") - F.lag("last_t").over(in_order)) / day_us)
    per_day = per_day.withColumns({
        "gap": gap,
        "total_n": F.sum("n").over(by_merchant),
        "total_mean": F.sum(F.col("n") * F.col("mean")).over(by_merchant)
        / F.sum("n").over(by_merchant),
    })
    drift = F.col("mean") - F.col("total_mean")
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    return per_day.withColumns({
        "total_std": F.sqrt(
            F.sum(F.col("n") * (F.col("var") + drift * drift)).over(by_merchant) / F.col("total_n")),
        "n_gaps": F.count(positive).over(by_merchant),
        "gap_mean": F.avg(positive).over(by_merchant),
        "gap_std": F.stddev_pop(positive).over(by_merchant),
    })


def _recurring():
    mean = F.col("gap_mean")
    near = any_of([
        F.abs(mean - F.lit(float(p))) <= F.lit(fv.RECURRING_TOLERANCE * p)
        for p in fv.RECURRING_PERIODS])
    regular = (
        (F.col("total_n") >= fv.RECURRING_MIN_ROWS)
        & (F.col("n_gaps") >= fv.RECURRING_MIN_GAPS)
        & (F.col("gap_std") / mean <= fv.RECURRING_CV_MAX)
        & near
    )
    return F.coalesce(regular, F.lit(False))


def _stability():
    cv = F.when(F.col("total_mean") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("total_std"), F.col("total_mean")))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))


def _recency(gap):
    days = F.least(F.coalesce(gap, F.lit(fv.RECENCY_CAP)), F.lit(fv.RECENCY_CAP))
    return F.log1p(days.cast("double")) / F.lit(math.log1p(fv.RECENCY_CAP))


def recency(
    rows: DataFrame, merchant: str = "counterparty_normalized", id_col: str = "id"
) -> DataFrame:
    """Add ``gap_days``, whole days since the merchant's previous row (null on its first),
    and ``recency_days``, its log scale in 0..1.

    Only the first row of a merchant's day can be a whole day after its predecessor. The rows
    are stored first, as the days and the join back both read them.
    """
    rows = durable(rows)
    days = merchant_days(rows, merchant, id_col).select(
        merchant, "day", F.col("first.id").alias("_first"), F.col("gap").alias("_gap"))
    gap = F.when(F.col(id_col) == F.col("_first"), F.col("_gap")).otherwise(F.lit(0))
    return (
        rows.withColumn("day", F.to_date("txn_date"))
        .join(days, [merchant, "day"])
        .withColumn("gap_days", gap)
        .withColumn("recency_days", _recency(F.col("gap_days")))
        .drop("day", "_first", "_gap")
    )


def merchant_profile(rows: DataFrame, merchant: str = "counterparty_normalized") -> DataFrame:
    """Per merchant: count, frequency, amount stability and the recurring flag."""
    id_col = "id" if "id" in rows.columns else "dedup_key"
    days = merchant_days(rows, merchant, id_col)
    per_merchant = days.groupBy(merchant).agg(
        *[F.any_value(c).alias(c)
          for c in ("total_n", "total_mean", "total_std", "n_gaps", "gap_mean", "gap_std")])
    return per_merchant.select(
        merchant,
        F.col("total_n").alias("n_transactions"),
        F.col("total_mean").alias("mean_amount"),
        "n_gaps", "gap_mean", "gap_std",
        F.log1p(F.col("total_n").cast("double")).alias("merchant_frequency"),
        _stability().alias("amount_stability"),
        _recurring().cast("double").alias("is_recurring"),
    )


def build_features(
    ledger: DataFrame, merchant: str = "counterparty_normalized", id_col: str = "id", is_stored: bool = False
) -> DataFrame:
    """The eight features of every spend row, keyed by ``transaction_id``.

    One aggregation to merchant days and one join back serve recency, frequency,
    stability and recurrence together. The rows are stored first, as both read them, unless
    the caller's ``ledger`` ``is_stored``.
    """
    needed = ledger.select(id_col, "txn_date", "amount", merchant, "txn_kind")
    spend = (needed if is_stored else durable(needed)).filter(F.col("txn_kind") == "spend").drop("txn_kind")
    days = merchant_days(spend, merchant, id_col).select(
        merchant, "day",
        F.col("first.id").alias("_first"), F.col("gap").alias("_gap"),
        F.log1p(F.col("total_n").cast("double")).alias("merchant_frequency"),
        _stability().alias("amount_stability"),
        _recurring().cast("double").alias("is_recurring"),
    )
    joined = spend.withColumn("day", F.to_date("txn_date")).join(days, [merchant, "day"])
    gap = F.when(F.col(id_col) == F.col("_first"), F.col("_gap")).otherwise(F.lit(0))
    return (
        calendar_features(joined)
        .withColumn("recency_days", _recency(gap))
        .select(F.col(id_col).alias("transaction_id"), *fv.FEATURE_COLUMNS)
    )
