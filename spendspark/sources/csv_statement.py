"""CSV statements, read as splittable text.

A statement has some preamble, then a header row in one of many spellings, then data.
Lines are read as text so that one huge file still spreads over many tasks; a record
that a quoted line break spreads over several lines is put together again afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import blanks, parse_date
from ..functions.money import infer_direction, parse_amount
from ..runtime import broadcast_if_small, compute_once, durable

# one cell after its comma: quoted (with doubled quotes inside) or bare
CELL = r',("(?:[^"]|"")*"[^,]*|[^,]*)'

# a quote opens only at the start of a cell; elsewhere it is text
_INSIDE = r'(?:[^"]|"")*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?,)*+'
OPENS = rf'^{_CELLS}"{_INSIDE}$'
STAYS_OPEN = rf'^{_INSIDE}$'
OPENS_AGAIN = rf'^{_INSIDE}"[^,]*+,{_CELLS}"{_INSIDE}$'
#: a quoted cell that is not closed within so many lines is taken as one line that cannot be read
MAX_RECORD_LINES = 100


def read_lines(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Every line with its place: (file, byte offset of its split, line number)."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path)
    )
    return number_lines(with_split(lines))


def same_path(path: Column) -> Column:
    """Scans and listings write the root of a local path differently."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def with_split(lines: DataFrame) -> DataFrame:
    """Lines with the file and the byte offset of the split they were read from."""
    return lines.select(
        same_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("part_no"),
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``row_no``; it grows along each split, so it must come before any shuffle."""
    return lines.select(
        "source_file", "part_no", F.monotonically_increasing_id().alias("row_no"), "line")


def opens_cell(line: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell."""
    return line.contains('"') & line.rlike(OPENS)


def _state_before(value: str, swaps: str, over: Window) -> Column:
    """Whether the place before a row is inside a cell: what the last row that decides it says,
    turned by the rows after it that only turn it; null where no row decides."""
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(value, swaps)), True).over(over)
    here = F.coalesce(F.sum("swap").over(over), F.lit(0))
    return F.when(last.isNotNull(), (F.when(last[value], 1).otherwise(0) + here - last[swaps]) % 2 == 1)


def join_broken_records(lines: DataFrame) -> DataFrame:
    """Put records together that contain quoted line breaks.

    A line tells, for either state before it, whether a quoted cell is open after it. Such
    functions follow each other per split first and then over the splits of a file, so a file
    is never gathered into one task: each split only needs the state before it and the place
    where a record was left open. A cell not closed within ``MAX_RECORD_LINES`` does not open:
    its line is ``unclosed`` and the next ones are read on their own.
    """
    split = ["source_file", "part_no"]
    in_split = Window.partitionBy(*split).orderBy("row_no")
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    here = in_split.rowsBetween(Window.unboundedPreceding, 0)
    later = in_split.rowsBetween(1, Window.unboundedFollowing)
    of_file = Window.partitionBy("source_file").orderBy("part_no")
    before_split = of_file.rowsBetween(Window.unboundedPreceding, -1)

    told = lines.withColumns({
        "opens": opens_cell(F.col("line")),
        "open_on": F.col("line").rlike(STAYS_OPEN) | F.col("line").rlike(OPENS_AGAIN),
        "at": F.row_number().over(in_split).cast("long"),
    }).withColumn("close", F.when(~F.col("open_on"), F.col("at")))
    # the next line that closes a cell may be in a later split
    sizes = told.groupBy(*split).agg(F.count("*").alias("n"), F.min("close").alias("first_close"))
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before_split), F.lit(0)))
    sizes = sizes.withColumn("close_later", F.min(F.col("base") + F.col("first_close")).over(
        of_file.rowsBetween(1, Window.unboundedFollowing)) - F.col("base")).select(*split, "close_later")
    closed = F.coalesce(F.min("close").over(later), F.col("close_later")) - F.col("at") <= MAX_RECORD_LINES
    lasting = told.join(sizes, split).withColumn("closed", F.coalesce(closed, F.lit(False)))
    # a line decides the state after it, or keeps or turns the one before
    turned = lasting.withColumns({
        "unclosed": F.col("opens") & ~F.col("closed"), "opens": F.col("opens") & F.col("closed"),
    }).withColumns({
        "says": F.when(F.col("opens") == F.col("open_on"), F.col("opens")),
        "swap": F.when(F.col("opens") & ~F.col("open_on"), 1).otherwise(0),
    }).withColumn("swaps", F.sum("swap").over(here))

    whole = turned.groupBy(*split).agg(
        F.max_by(F.struct("says", "swaps"), F.when(F.col("says").isNotNull(), F.col("at"))).alias("last"),
        F.sum("swap").alias("swap"))
    whole = whole.withColumn("says", F.when(F.col("last").isNotNull(), (
        F.when(F.col("last.says"), 1).otherwise(0) + F.col("swap") - F.col("last.swaps")) % 2 == 1))
    whole = whole.withColumn("swap", F.when(F.col("says").isNull(), F.col("swap")).otherwise(0)).withColumn(
        "swaps", F.sum("swap").over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    entered = F.coalesce(_state_before("says", "swaps", before_split), F.coalesce(
        F.sum("swap").over(before_split), F.lit(0)) % 2 == 1)
    whole = whole.select(*split, entered.alias("entered"))

    inside = F.coalesce(_state_before("says", "swaps", before), (
        F.when(F.col("entered"), 1).otherwise(0) + F.coalesce(F.sum("swap").over(before), F.lit(0))) % 2 == 1)
    placed = turned.join(whole, split).withColumn("starts", ~inside).withColumn(
        "start_here", F.last(F.when(F.col("starts"), F.struct("part_no", "row_no")), True).over(here))
    # a split that begins inside a record continues the last record of an earlier one
    last_start = placed.groupBy(*split).agg(
        F.max(F.when(F.col("starts"), F.struct("part_no", "row_no"))).alias("last_start"))
    carried = last_start.select(*split, F.last("last_start", True).over(before_split).alias("carried_start"))
    return (
        placed.join(carried, split)
        .withColumn("start", F.coalesce("start_here", "carried_start"))
        .groupBy("source_file", "start.part_no", "start.row_no")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("part_no").alias("p"), F.col("row_no").alias("r"), "line"))).alias("pieces"),
            F.bool_or(F.col("unclosed") & F.col("starts")).alias("unclosed"))
        .select(
            "source_file", "part_no", "row_no",
            F.array_join(F.col("pieces.line"), "\n").alias("line"), "unclosed",
        )
    )


def split_cells(line: Column) -> Column:
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'),
        F.replace(F.regexp_replace(c, r'(?s)^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"')),
    ).otherwise(c))


def scan_records(
    spark: SparkSession, path: str | list[str], glob: str = "*", quoted_breaks: bool | None = None
) -> DataFrame:
    """Records of CSV files as arrays of cells.

    ``quoted_breaks``: whether records may span lines; ``None`` looks for files with lines
    that end inside a cell first and puts only those through record assembly.
    """
    return records_of_lines(read_lines(spark, path, glob), quoted_breaks)


def records_of_lines(lines: DataFrame, quoted_breaks: bool | None = None) -> DataFrame:
    alone = lines.withColumn("unclosed", opens_cell(F.col("line")))
    if quoted_breaks is None:
        broken = lines.filter(opens_cell(F.col("line"))).select("source_file").distinct()
        if broken.isEmpty():
            records = alone
        else:
            broken = broadcast_if_small(durable(broken))
            records = alone.join(broken, "source_file", "left_anti").unionByName(
                join_broken_records(lines.join(broken, "source_file", "left_semi")))
    else:
        records = join_broken_records(lines) if quoted_breaks else alone
    # the columns of a line with an open cell are anybody's guess: it is one cell
    cells = F.when(F.col("unclosed"), F.array("line")).otherwise(split_cells(F.col("line")))
    return records.select("source_file", "part_no", "row_no", "line", cells.alias("cells"))


def _key(cell: Column) -> Column:
    return F.lower(F.trim(cell))


def find_headers(records: DataFrame) -> DataFrame:
    """First row of each file that names a date and an amount."""
    keys = F.transform("cells", _key)
    is_header = F.array_contains(keys, "date") & F.exists(keys, lambda k: k.contains("amount"))
    text = F.lower("line")
    return (
        # two substring tests spare nearly all data rows the splitting into cells
        records.filter(text.contains("date") & text.contains("amount")).filter(is_header)
        .groupBy("source_file")
        .agg(F.min(F.struct("part_no", "row_no", "cells")).alias("h"))
        .select(
            "source_file",
            F.struct("h.part_no", "h.row_no").alias("header_at"),
            F.transform("h.cells", lambda c: F.trim(c)).alias("names"),
        )
    )


def map_header(headers: DataFrame) -> DataFrame:
    """Add one 1-based column position per known field (null: not in the file).

    The first column with a known spelling wins; of equally named columns the last
    holds the value.
    """
    out = headers
    for field, spellings in fv.HEADER_ALIASES.items():
        known = F.array(*[F.lit(s) for s in spellings])
        name = F.get(F.filter("names", lambda n: F.array_contains(known, F.lower(n))), 0)
        last = F.size("names") - F.array_position(F.reverse("names"), name) + 1
        out = out.withColumn(f"{field}_at", F.when(name.isNotNull(), last).cast("int"))
    return out


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """All file names, empty files too: the listing that planning a scan makes anyway."""
    names = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .inputFiles()  # a scan of the same would leave empty files out
    )
    return spark.createDataFrame([(n,) for n in names], "source_file string").select(
        same_path(F.col("source_file")).alias("source_file"))


def name_fields(records: DataFrame, headers: DataFrame, source_app: str = "statement") -> DataFrame:
    """Data rows below each header, as raw text fields plus their ``k=v`` line."""
    mapped = map_header(headers).filter(
        " and ".join(f"{f}_at is not null" for f in fv.REQUIRED_FIELDS))
    rows = records.join(mapped, "source_file").filter(
        (F.struct("part_no", "row_no") > F.col("header_at"))
        & F.exists("cells", lambda c: F.length(F.trim(c)) > 0)
    )
    width = F.least(F.size("names"), F.size("cells"))
    raw_line = F.array_join(
        F.zip_with(F.slice("names", 1, width), F.slice("cells", 1, width),
                   lambda k, v: F.concat(k, F.lit("="), v)), " | ")

    def cell(field: str) -> Column:
        at = F.col(f"{field}_at")
        return F.when(at.isNotNull(), F.coalesce(F.get("cells", at - 1), F.lit("")))

    return rows.select(
        "source_file", "part_no", "row_no",
        cell("date").alias("date_str"), cell("time").alias("time_str"),
        cell("details").alias("details_str"), cell("type").alias("type_str"),
        cell("amount").alias("amount_str"), cell("reference").alias("reference_str"),
        raw_line.alias("raw_line"), F.lit(source_app).alias("source_app"),
    )


def parse_fields(fields: DataFrame) -> DataFrame:
    """Typed columns plus ``reason``: null for a good row, else what failed."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    time = F.nullif(text("time_str"), F.lit(""))
    texts = compute_once(fields, {
        "_day": blanks(text("date_str")),
        "_both": F.when(time.isNotNull(), blanks(F.concat_ws(" ", text("date_str"), time))),
    })
    typed = compute_once(texts, {
        "_ts": parse_date(F.col("_both"), with_time=True),
        "amount": parse_amount(text("amount_str")),
        "direction": infer_direction(F.col("type_str"), text("amount_str")),
    })
    # without a readable time the day alone stands, at midnight
    day = F.when(F.col("_ts").isNull(), parse_date(F.col("_day")))
    typed = compute_once(typed, {"txn_date": F.coalesce("_ts", day)})
    reasons = F.concat_ws(
        ", ",
        F.when(F.col("txn_date").isNull(), fv.REASON_DATE),
        F.when(F.col("amount").isNull(), fv.REASON_AMOUNT),
        F.when(F.col("direction").isNull(), fv.REASON_DIRECTION),
    )
    return typed.select(
        "source_file", "part_no", "row_no", "txn_date", "amount", "direction",
        F.coalesce(F.nullif(F.trim(text("details_str")), F.lit("")), F.lit(fv.UNKNOWN))
        .alias("counterparty_raw"),
        F.nullif(F.trim(text("reference_str")), F.lit("")).alias("reference_id"),
        "source_app",
        F.lit(fv.TABLE_CONFIDENCE).alias("parse_confidence"),
        "raw_line",
        F.nullif(reasons, F.lit("")).alias("reason"),
    )


def file_failures(headers: DataFrame, files: DataFrame) -> DataFrame:
    """One unparsed row per file without a header or without a required column."""
    no_header = files.select("source_file").join(headers, "source_file", "left_anti").select(
        "source_file", F.lit("").alias("raw_line"), F.lit(fv.REASON_NO_HEADER).alias("reason"))
    missing = F.coalesce(*[
        F.when(F.col(f"{f}_at").isNull(), fv.REASON_NO_COLUMN % f) for f in fv.REQUIRED_FIELDS])
    no_column = map_header(headers).select(
        "source_file", F.array_join("names", ",").alias("raw_line"), missing.alias("reason")
    ).filter("reason is not null")
    return no_header.unionByName(no_column).withColumns(
        {"part_no": F.lit(0).cast("bigint"), "row_no": F.lit(0).cast("bigint")})


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null").drop("reason")


def bad_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").select(
        "source_file", "part_no", "row_no", "raw_line", "reason")


def read_csv_statements(
    spark: SparkSession,
    path: str | list[str],
    glob: str = "*.csv",
    source_app: str = "statement",
    quoted_breaks: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, unparsed rows) of all CSV statements under ``path``.

    The files are read once, into a table of lines: places of headers and of rows come from
    the same splits, and files that arrive meanwhile wait for the next call.
    """
    return rows_of_lines(durable(read_lines(spark, path, glob)), list_files(spark, path, glob),
                         source_app, quoted_breaks)


def rows_of_lines(
    lines: DataFrame, files: DataFrame, source_app: str = "statement",
    quoted_breaks: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, unparsed rows) of stored lines; ``files`` names those that must show up."""
    records = records_of_lines(lines, quoted_breaks)
    headers = durable(find_headers(records))
    parsed = durable(parse_fields(name_fields(records, headers, source_app)))
    return good_rows(parsed), bad_rows(parsed).unionByName(file_failures(headers, files))


def parse_stats(parsed: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Per file: rows parsed and not, and the share parsed (0 when there are none).

    Of rows that ``parse_fields`` gave, ``parsed_stats`` counts both kinds in one pass.
    """
    both = parsed.select("source_file", F.lit(1).alias("ok")).unionByName(
        unparsed.select("source_file", F.lit(0).alias("ok")))
    return both.groupBy("source_file").agg(
        F.sum("ok").cast("bigint").alias("parsed"),
        F.sum(1 - F.col("ok")).cast("bigint").alias("unparsed"),
        F.round(F.avg("ok"), 4).alias("parse_rate"),
    )


def parsed_stats(rows: DataFrame) -> DataFrame:
    """``parse_stats`` of rows with their ``reason``."""
    ok = F.col("reason").isNull().cast("bigint")
    return rows.groupBy("source_file").agg(
        F.sum(ok).alias("parsed"), F.sum(1 - ok).alias("unparsed"),
        F.round(F.avg(ok), 4).alias("parse_rate"))
