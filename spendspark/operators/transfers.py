"""Debit/credit pairs of equal amount close in time: money moved, not spent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import micros
from ..runtime import spread
from ..schema import SOURCE_ORDER

MINUTE = 60_000_000
DAY = 86_400_000_000


def next_credit(events: DataFrame, reach_minutes: int) -> DataFrame:
    """For each probe, the earliest credit at or after it (same amount).

    ``events``: amount, at (microseconds), credit (struct, null on probes), probe (null on
    credits); at most one of each per amount and instant. The look-up is a sort inside one
    minute, then over the minutes of a span twice ``reach_minutes``; no pair is formed, and
    no sort holds more than one minute of instants or one span of minutes.
    """
    minute = F.floor(F.col("at") / F.lit(MINUTE))
    events = events.withColumn("minute", minute)
    backward = (
        Window.partitionBy("amount", "minute")
        .orderBy(F.desc("at"), F.isnull("credit"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = events.withColumn("hit", F.last("credit", ignorenulls=True).over(backward))

    bucket = F.floor(F.col("minute") / F.lit(2 * reach_minutes))
    minutes = (
        events.groupBy("amount", "minute")
        .agg(F.min("credit").alias("first_credit"), F.bool_or(F.isnotnull("probe")).alias("asked"))
        # a credit is looked up from its own span of minutes and from the one before
        .withColumn("bucket", F.explode(F.when(
            F.isnotnull("first_credit"), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))
    )
    later = (
        Window.partitionBy("amount", "bucket")
        .orderBy(F.desc("minute"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    following = (
        minutes.withColumn("next_hit", F.last("first_credit", ignorenulls=True).over(later))
        .filter(F.col("asked") & (F.col("bucket") == bucket))
        .select("amount", "minute", "next_hit")
    )
    return (
        placed.filter("probe is not null")
        .join(following, ["amount", "minute"], "left")
        .select("amount", "probe", F.coalesce("hit", "next_hit").alias("credit"))
    )


def tag_offsets(
    rows: DataFrame, order: Sequence[str] = tuple(SOURCE_ORDER), days: int = fv.OFFSET_DAYS
) -> DataFrame:
    """Add ``is_offset``: debits with a credit of equal amount within ``days``, and the
    earliest such credit of each debit.

    Rows are first reduced to instants per amount (one of the credits, one of the debits),
    which is all the pairing needs, however many rows share an amount and a time. Credits are
    spread before, as Spark sorts a task's rows for their smallest key; debits bring no key
    and are not sorted. The join back always deals the rows out by amount and time.
    """
    span = days * DAY
    key = F.struct(*order)
    t = micros(F.col("txn_date"))
    credits = spread(rows.filter(F.col("direction") == "credit").select("amount", "txn_date", *order),
                     "amount", "txn_date", *order).groupBy("amount", t.alias("t")).agg(F.min(key).alias("credit_key"))
    debits = rows.filter((F.col("direction") == "debit") & F.isnotnull("txn_date")).select("amount", t.alias("t")).distinct()
    credit = F.struct(F.col("t"), F.col("credit_key"))
    events = credits.select(
        "amount", F.col("t").alias("at"), credit.alias("credit"), F.lit(None).cast("bigint").alias("probe"),
    ).unionByName(debits.select(
        "amount", (F.col("t") - span).alias("at"), F.col("t").alias("probe")), allowMissingColumns=True)
    pairs = next_credit(events, reach_minutes=2 * days * 24 * 60).filter(
        F.col("credit.t") <= F.col("probe") + span)
    tags = pairs.select("amount", F.explode(F.array(
        F.struct(F.col("probe").alias("t"), F.lit(True).alias("debit"),
                 F.when(F.lit(False), F.col("credit.credit_key")).alias("credit_key")),
        F.struct(F.col("credit.t").alias("t"), F.lit(False).alias("debit"),
                 F.col("credit.credit_key").alias("credit_key")),
    )).alias("x")).groupBy("amount", F.col("x.t").alias("_t")).agg(
        F.bool_or("x.debit").alias("_debit"), F.min("x.credit_key").alias("_credit"))
    hit = F.when(F.col("direction") == "debit", F.col("_debit")).otherwise(
        F.col("_credit") == key)
    return (
        rows.withColumn("_t", micros(F.col("txn_date")))
        .join(tags.hint("merge"), ["amount", "_t"], "left")
        .withColumn("is_offset", F.coalesce(hit, F.lit(False)))
        .drop("_t", "_debit", "_credit")
    )


def offset_kinds(tagged: DataFrame) -> DataFrame:
    """Pairing overrides every rule-made kind."""
    return tagged.withColumn(
        "txn_kind", F.when(F.col("is_offset"), "self_transfer").otherwise(F.col("txn_kind"))
    ).drop("is_offset")
