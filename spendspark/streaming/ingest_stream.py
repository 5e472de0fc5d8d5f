"""File-stream ingest: new statement files become ledger rows as they arrive.

Each micro-batch goes through the batch job. No state is kept in the stream: the stored
keys make a replayed batch insert nothing, its unparsed rows are there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.ingest import ingest_rows
from ..plans.store import LedgerStore
from ..runtime import durable, job_folder
from ..sources.csv_statement import number_lines, rows_of_lines, with_split


def statement_lines(spark: SparkSession, path: str, glob: str = "*.csv", max_files: int = 1000) -> DataFrame:
    lines = (
        spark.readStream.format("text")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return with_split(lines)


def ingest_stream(
    spark: SparkSession, store: LedgerStore, path: str, checkpoint: str,
    source_app: str = "statement", max_files: int = 1000, **clean_args,
) -> StreamingQuery:
    """Start a run over all files that are new since the last one (``availableNow``)."""

    def store_batch(lines: DataFrame, batch_id: int) -> None:
        # the query's id is kept beside its checkpoint, so no other stream has it
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        with job_folder(spark):
            lines = durable(number_lines(lines))
            files = lines.select("source_file").distinct()
            rows, unparsed = rows_of_lines(lines, files, source_app)
            ingest_rows(store, rows, unparsed, f"stream-{stream}-{batch_id}", **clean_args)

    return (
        statement_lines(spark, path, max_files=max_files)
        .writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
