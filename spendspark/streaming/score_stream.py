"""Score ledger rows against a stored run as they arrive (a stream-static join)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.score import score_new


def score_stream(
    spark: SparkSession, path: str, schema, profile, scaler, centers, output: str, checkpoint: str,
) -> StreamingQuery:
    rows = spark.readStream.schema(schema).parquet(path)
    return (
        score_new(rows, profile, scaler, centers)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
