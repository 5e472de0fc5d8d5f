"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spendspark.runtime import discard, scratch_path, write_out

__all__ = ["discard", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there.

    What follows neither repeats the work nor depends on one executor's disk.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    write_out(df, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table
