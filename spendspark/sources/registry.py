"""Which reader takes which file: the first that recognises it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.dates import any_of
from .csv_statement import list_files, read_csv_statements, read_lines


Reader = Callable[[SparkSession, "str | list[str]", str], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Adapter:
    """A reader's name, its test on (lower-case file name, lower-case first line), and what
    reads all its files under a path to (rows, unparsed rows).

    Without ``read`` the files are only named; ingest lists them as unparsed.
    """

    name: str
    recognises: Callable[[Column, Column], Column]
    read: Reader | None = None
    glob: str = "*"


CSV_GLOB = "*.[cC][sS][vV]"


def read_csv(spark: SparkSession, path: str | list[str], source_app: str) -> tuple[DataFrame, DataFrame]:
    return read_csv_statements(spark, path, CSV_GLOB, source_app)


CSV = Adapter(
    "csv",
    lambda path, line: path.endswith(".csv")
    & any_of([F.coalesce(line, F.lit("")).contains(w) for w in fv.SNIFF_WORDS]),
    read_csv, CSV_GLOB,
)
PDF = Adapter("pdf", lambda path, line: path.endswith(".pdf"))
ADAPTERS = [CSV, PDF]


def first_lines(spark: SparkSession, path: str | list[str], glob: str = "*.[cC][sS][vV]") -> DataFrame:
    """First line of each file; only the split at byte 0 of a file is looked at."""
    lines = read_lines(spark, path, glob)
    return (
        lines.filter("part_no = 0")
        .groupBy("source_file")
        .agg(F.min_by("line", "row_no").alias("first_line"))
    )


def route_files(
    spark: SparkSession, path: str | list[str], adapters: list[Adapter] | None = None
) -> DataFrame:
    """(source_file, adapter, reason): ``adapter`` is null where no reader fits."""
    files = list_files(spark, path)
    heads = first_lines(spark, path)
    line = F.lower("first_line")
    name = F.lower("source_file")
    chosen = None
    for adapter in adapters or ADAPTERS:
        fits = adapter.recognises(name, line)
        chosen = F.when(fits, adapter.name) if chosen is None else chosen.when(fits, adapter.name)
    return (
        files.join(heads, "source_file", "left")
        .select("source_file", chosen.alias("adapter"))
        .withColumn("reason", F.when(F.col("adapter").isNull(), fv.REASON_NO_ADAPTER))
    )
