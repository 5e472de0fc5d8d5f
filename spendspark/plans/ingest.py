"""Ingest: statement files to stored ledger rows, the same result however often it runs."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..runtime import durable, job_folder
from ..sources.csv_statement import list_files
from ..sources.registry import ADAPTERS, Adapter
from .clean import clean_ledger
from .store import LedgerStore


def ingest_rows(
    store: LedgerStore, rows: DataFrame, unparsed: DataFrame, batch: str,
    created_at: datetime | None = None, **clean_args,
) -> dict:
    """Clean and store parsed rows. The returned counts are those of this call."""
    created_at = created_at or datetime.now(timezone.utc).replace(tzinfo=None)
    rows, unparsed = rows.persist(), unparsed.persist()
    parsed, failed = rows.count(), unparsed.count()
    cleaned = clean_ledger(rows, **clean_args).persist()
    kept = cleaned.count()
    inserted = store.insert_transactions(cleaned, created_at)
    store.add_unparsed(unparsed, created_at, batch)
    for df in (rows, unparsed, cleaned):
        df.unpersist()
    seen = parsed + failed
    return {
        "parsed": parsed, "unparsed": failed,
        "parse_rate": round(parsed / seen, 4) if seen else 0.0,
        "inserted": inserted, "duplicates_skipped": kept - inserted,
        "in_batch_duplicates": parsed - kept,
    }


def ingest_path(
    spark: SparkSession, store: LedgerStore, path: str, batch: str | None = None,
    source_app: str = "statement", adapters: list[Adapter] | None = None, **clean_args,
) -> dict:
    """Ingest all files under a path that an adapter reads.

    Every other file is listed as unparsed: one that no adapter knows, and one of an adapter
    that does not read (extracted PDF text comes in through ``ingest_rows``).
    """
    with job_folder(spark):
        files = durable(list_files(spark, path))
        unread, parts = files, []
        for adapter in adapters or ADAPTERS:
            if adapter.read:
                # by name: a file whose first line says nothing may hold a header further down
                mine = list_files(spark, path, adapter.glob)
                parts.append(adapter.read(spark, path, source_app))
                unread = unread.join(mine, "source_file", "left_anti")
        known = [a for a in adapters or ADAPTERS if not a.read]
        reason = F.lit(fv.REASON_NO_ADAPTER)
        for a in known:
            reason = F.when(a.recognises(F.lower("source_file"), F.lit("")),
                            fv.REASON_NO_READER % a.name).otherwise(reason)
        strange = unread.select(
            "source_file", F.lit(0).cast("bigint").alias("part_no"),
            F.lit(0).cast("bigint").alias("row_no"), F.lit("").alias("raw_line"),
            reason.alias("reason"))
        rows = reduce(DataFrame.unionByName, [r for r, _ in parts])
        unparsed = reduce(DataFrame.unionByName, [u for _, u in parts] + [strange])
        return ingest_rows(store, rows, unparsed, batch or path, **clean_args)


