"""Statement text and extracted table rows (from pages, one row per page or per row)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import any_of, parse_text_date
from ..functions.text import text_counterparty
from ..runtime import compute_once

ANCHOR = f"(?mdU)^({fv.TEXT_DATE})"


def split_records(pages: DataFrame, text: str = "text", keep_orphans: bool = False) -> DataFrame:
    """One row per record: a record runs from one line-start date to the next.

    Text before the first date is no record; ``keep_orphans`` keeps it as record 0.
    """
    chunks = F.split(F.col(text), f"(?mdU)(?=^{fv.TEXT_DATE})")
    out = pages.select(
        "*", F.posexplode(F.transform(chunks, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
        .alias("pos", "chunk"))
    is_record = F.col("chunk").rlike(ANCHOR)
    wanted = (F.length("chunk") > 0) if keep_orphans else is_record
    # `pos` is 0 for text that begins with a date, 1 when something stands before it
    starts = F.col(text).rlike(f"(?U)^{fv.TEXT_DATE}")
    number = F.when(starts, F.col("pos") + 1).otherwise(F.col("pos"))
    return out.withColumn("record_no", number.cast("bigint")).filter(wanted).drop("pos")


def direction_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_of([low.contains(w) for w in fv.TEXT_CREDIT_WORDS]), "credit").otherwise("debit")


def _amount_text(text: Column) -> Column:
    return F.regexp_extract(text, f"(?U){fv.TEXT_AMOUNT}", 1)


def extract_fields(records: DataFrame, text: str = "chunk") -> DataFrame:
    """First date and first currency amount of each record, with a reason on failure."""
    t = F.col(text)
    date_text = F.regexp_extract(t, ANCHOR, 1)
    amount_text = _amount_text(t)
    found = (date_text != "") & (amount_text != "")
    out = compute_once(records, {
        "txn_date": parse_text_date(date_text),
        "amount": F.abs(F.replace(amount_text, F.lit(","), F.lit("")).try_cast("decimal(14,2)")),
        "direction": direction_of(t),
        "counterparty_raw": text_counterparty(t),
        "found": found,
    })
    reason = F.when(~F.col("found"), fv.REASON_NO_FIELDS).when(
        F.col("txn_date").isNull() | F.col("amount").isNull(), fv.REASON_BAD_FIELDS)
    return out.withColumn("reason", reason).drop("found")


def text_rows(records: DataFrame, source_app: str = "statement") -> DataFrame:
    """Ledger-shaped rows (with ``reason``) of text records: the less certain path."""
    fields = extract_fields(records)
    return fields.select(
        "source_file", "part_no", F.col("record_no").alias("row_no"),
        "txn_date", "amount", "direction", "counterparty_raw",
        F.lit(None).cast("string").alias("reference_id"),
        F.lit(source_app).alias("source_app"),
        F.lit(fv.TEXT_CONFIDENCE).alias("parse_confidence"),
        F.col("chunk").alias("raw_line"),
        "reason",
    )


def table_rows(tables: DataFrame, source_app: str = "statement") -> DataFrame:
    """Ledger-shaped rows (with ``reason``) of table rows given as arrays of cells."""
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    fields = extract_fields(tables.withColumn("chunk", F.array_join(cells, " ")))
    return fields.select(
        "source_file", "part_no", "row_no",
        "txn_date", "amount", "direction", "counterparty_raw",
        F.lit(None).cast("string").alias("reference_id"),
        F.lit(source_app).alias("source_app"),
        F.lit(fv.TABLE_CONFIDENCE).alias("parse_confidence"),
        F.col("chunk").alias("raw_line"),
        "reason",
    )


def pages_with_fallback(
    tables: DataFrame, pages: DataFrame, source_app: str = "statement",
    keep_orphans: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(rows, unparsed): table rows where a page has any, its text records elsewhere.

    ``tables``: source_file, part_no (page), row_no, cells. ``pages``: source_file,
    part_no, text. Table rows that hold no transaction are headings and are skipped;
    ``keep_orphans`` sends them, and text before the first date, to the unparsed rows.
    """
    from_tables = table_rows(tables, source_app)
    good = from_tables.filter("reason is null").drop("reason")
    served = good.select("source_file", "part_no").distinct()
    rest = pages.join(served, ["source_file", "part_no"], "left_anti")
    from_text = text_rows(split_records(rest, keep_orphans=keep_orphans), source_app)
    rows = good.unionByName(from_text.filter("reason is null").drop("reason"))
    columns = ["source_file", "part_no", "row_no", "raw_line", "reason"]
    unparsed = from_text.filter("reason is not null").select(*columns)
    if keep_orphans:
        lost = from_tables.filter("reason is not null").join(
            served, ["source_file", "part_no"], "left_semi")
        unparsed = unparsed.unionByName(lost.select(*columns))
    return rows, unparsed
