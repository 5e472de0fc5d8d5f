"""Read queries over the stored tables; filters and columns reach the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import month_of
from ..runtime import durable


class NoRunError(LookupError):
    """No clustering run is stored yet."""


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(1).select("id")


def resolve_run(runs: DataFrame, run_id: str | None = None, required: bool = False) -> str | None:
    """The given run, or the newest; one small value that then prunes partitions."""
    if run_id is None:
        row = latest_run(runs).first()
        run_id = row["id"] if row else None
    if run_id is None and required:
        raise NoRunError("no clustering run yet")
    return run_id


def list_runs(runs: DataFrame, latest: bool = False) -> DataFrame:
    ordered = runs.orderBy(F.desc("created_at"), "id")
    return ordered.limit(1) if latest else ordered


def list_clusters(runs: DataFrame, clusters: DataFrame, run_id: str | None = None) -> DataFrame:
    run = resolve_run(runs, run_id, required=True)
    return clusters.filter(F.col("run_id") == run).orderBy("cluster_index")


def _run_rows(transactions, assignments, clusters, run: str) -> DataFrame:
    """Transactions of a run with their cluster. A run has at most a few clusters."""
    of_run = F.col("run_id") == run
    mine = assignments.filter(of_run).drop("run_id")
    labels = clusters.filter(of_run).select("cluster_index", "label")
    return mine.join(
        transactions.withColumnRenamed("id", "transaction_id"), "transaction_id"
    ).join(F.broadcast(labels), "cluster_index")


def scatter_points(runs, transactions, assignments, clusters, run_id: str | None = None) -> DataFrame:
    run = resolve_run(runs, run_id, required=True)
    return _run_rows(transactions, assignments, clusters, run).select(
        "transaction_id", "pca_x", "pca_y", "amount",
        F.col("counterparty_normalized").alias("counterparty"),
        "txn_date", "cluster_index", "is_anomaly", "anomaly_reason",
    )


def spend_over_time(runs, transactions, assignments, clusters, run_id: str | None = None) -> DataFrame:
    """Totals per month and cluster, 0 where a cluster has no rows in a month."""
    run = resolve_run(runs, run_id, required=True)
    totals = (
        _run_rows(transactions, assignments, clusters, run)
        .groupBy(month_of(F.col("txn_date")).alias("month"), "cluster_index", "label")
        .agg(F.sum("amount").alias("total"))
    )
    return zero_fill(totals)


def zero_fill(totals: DataFrame) -> DataFrame:
    """Every cluster in every month: each month carries the list of clusters.

    ``totals`` holds months times clusters, a small table that is read three times.
    """
    totals = durable(totals)
    by_label = totals.groupBy("label", "cluster_index").agg(F.lit(1).alias("_one"))
    series = by_label.groupBy("_one").agg(
        F.collect_list(F.struct("cluster_index", "label")).alias("_all"))
    months = totals.select("month").distinct().withColumn("_one", F.lit(1))
    grid = months.join(series, "_one").select("month", F.inline("_all"))
    return grid.join(totals, ["month", "cluster_index", "label"], "left").select(
        "month", "cluster_index", "label",
        F.coalesce("total", F.lit(0).cast("decimal(38,2)")).alias("total"),
    ).orderBy("month", "cluster_index")


def spend_pivot(totals: DataFrame, labels: list[str]) -> DataFrame:
    """Months down, cluster labels across."""
    return totals.groupBy("month").pivot("label", labels).agg(F.sum("total")).orderBy("month")


def filter_transactions(
    transactions: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    txn_kind: str | None = None,
    merchant: str | None = None,
) -> DataFrame:
    """Inclusive dates, one kind, and a case-blind part of the merchant name, in which
    ``%`` and ``_`` are wildcards."""
    out = transactions
    if start is not None:
        out = out.filter(F.col("txn_date") >= F.lit(start))
        if "month" in out.columns:
            out = out.filter(F.col("month") >= F.lit(start.strftime("%Y-%m")))
    if end is not None:
        out = out.filter(F.col("txn_date") <= F.lit(end))
        if "month" in out.columns:
            out = out.filter(F.col("month") <= F.lit(end.strftime("%Y-%m")))
    if txn_kind:
        out = out.filter(F.col("txn_kind") == txn_kind)
    if merchant:
        out = out.filter(F.col("counterparty_normalized").ilike(f"%{merchant}%"))
    return out


def in_cluster(
    transactions: DataFrame, runs: DataFrame, assignments: DataFrame,
    cluster_index: int | None = None, is_anomaly: bool | None = None,
) -> DataFrame:
    """Only transactions of a cluster and/or anomaly state in the newest run; none without
    a run."""
    if cluster_index is None and is_anomaly is None:
        return transactions
    run = resolve_run(runs)
    if run is None:
        return transactions.limit(0)
    wanted = assignments.filter(F.col("run_id") == run)
    if is_anomaly is not None:
        wanted = wanted.filter(F.col("is_anomaly") == is_anomaly)
    if cluster_index is not None:
        wanted = wanted.filter(F.col("cluster_index") == cluster_index)
    ids = wanted.select(F.col("transaction_id").alias("id"))
    return transactions.join(ids, "id", "left_semi")


def _months_of_page(
    transactions: DataFrame, limit: int, offset: int
) -> tuple[DataFrame, int]:
    """Rows of the months that a page touches, and its offset among them (undated rows last)."""
    month = F.date_format("txn_date", "yyyy-MM")
    counts = transactions.where("txn_date is not null").groupBy(month.alias("m")).agg(
        F.count("*").alias("n")).orderBy(F.desc("m")).collect()
    skipped = seen = 0
    newest = oldest = None
    for r in counts:
        seen += r["n"]
        if newest is None and seen <= offset:
            skipped = seen
            continue
        newest, oldest = newest or r["m"], r["m"]
        if seen >= offset + limit:
            return transactions.filter(month.between(oldest, newest)), offset - skipped
    undated = F.col("txn_date").isNull()
    return transactions.filter(undated if newest is None else undated | (month <= newest)), offset - skipped


def page(
    transactions: DataFrame, limit: int = fv.PAGE_LIMIT, offset: int = 0,
    after: tuple[datetime, str] | None = None,
) -> DataFrame:
    """Newest first. ``after`` continues below the last (txn_date, id) of the previous page
    and needs no offset, which keeps deep pages cheap. An offset is found by the counts of
    months, so only the months that the page touches are sorted."""
    if limit > fv.PAGE_LIMIT_MAX:
        raise ValueError(f"limit is at most {fv.PAGE_LIMIT_MAX}")
    out = transactions
    if after is not None:
        ts, last_id = F.lit(after[0]), F.lit(after[1])
        out = out.filter(
            (F.col("txn_date") < ts) | ((F.col("txn_date") == ts) & (F.col("id") > last_id)))
    if offset:
        out, offset = _months_of_page(out, limit, offset)
    return out.orderBy(F.desc("txn_date"), "id").offset(offset).limit(limit)


def by_amount(transactions: DataFrame, descending: bool = True) -> DataFrame:
    amount = F.desc("amount") if descending else F.asc("amount")
    return transactions.orderBy(amount, F.desc("txn_date"), "id")


def split_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(normal, anomalies)"""
    return points.filter(~F.col("is_anomaly")), points.filter("is_anomaly")


def list_insights(
    runs: DataFrame, insights: DataFrame, run_id: str | None = None, month: str | None = None
) -> DataFrame:
    run = resolve_run(runs, run_id)
    out = insights.filter(F.col("run_id") == run) if run is not None else insights.limit(0)
    if month:
        out = out.filter(F.col("period_month") == month)
    return out.orderBy(F.desc("impact_amount"), "cluster_index", "period_month", "kind")


def unparsed_queue(unparsed: DataFrame, limit: int = fv.UNPARSED_LIMIT) -> DataFrame:
    order = [c for c in ("source_file", "part_no", "row_no", "raw_line") if c in unparsed.columns]
    return unparsed.orderBy(F.desc("created_at"), *order).limit(limit)


