"""Parquet tables of a ledger store.

Runs are immutable: their parts are appended under a run id, and the ``runs`` row is
written last, so readers that start from ``runs`` only see complete runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.dates import month_of
from ..operators.reads import resolve_run

TABLES = {
    "transactions": (schema.TRANSACTIONS, ["month"]),
    "unparsed": (schema.UNPARSED, ["batch"]),
    "runs": (schema.RUNS, []),
    "clusters": (schema.CLUSTERS, ["run_id"]),
    "assignments": (schema.ASSIGNMENTS, ["run_id"]),
    "insights": (schema.INSIGHTS, ["run_id"]),
    "features": (f"{schema.FEATURES}, run_id string", ["run_id"]),
}


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str) -> DataFrame:
        ddl, _ = TABLES[table]
        if not self._exists(table):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(self.path(table))

    def append(self, table: str, df: DataFrame, mode: str = "append") -> None:
        """Rows are rebalanced over the partition columns, which splits a hot month."""
        ddl, by = TABLES[table]
        columns = self.spark.createDataFrame([], ddl).schema
        shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns])
        if by:
            shaped = shaped.hint("rebalance", *by)
        writer = shaped.write.mode(mode)
        if mode == "overwrite" and by:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*by) if by else writer).parquet(self.path(table))

    # --- ingest ------------------------------------------------------------------
    def insert_transactions(self, cleaned: DataFrame, created_at) -> int:
        """Append rows whose key is not stored yet; returns how many (counted before the
        table changes, since recomputed rows would find themselves stored)."""
        fresh = new_rows(cleaned, self.read("transactions")).withColumns({
            "created_at": F.lit(created_at).cast("timestamp"),
            "month": month_of(F.col("txn_date")),
        }).persist()
        n = fresh.count()
        self.append("transactions", fresh)
        fresh.unpersist()
        return n

    def add_unparsed(self, unparsed: DataFrame, created_at, batch: str) -> None:
        """Append unparsed rows that are not listed yet; listed ones never go.

        Equal bad lines of a file are told apart by their number, in the order of the file: of
        those that it has more than are listed, the last ones are new.
        """
        keys = ["source_file", "raw_line", "reason"]
        listed = self.read("unparsed").groupBy(*keys).agg(F.count("*").alias("listed"))
        numbered = number_equal(unparsed, keys)
        fresh = numbered.join(listed, keys, "left").where(F.col("nth") > F.coalesce("listed", F.lit(0)))
        self.append("unparsed", fresh.withColumns({
            "created_at": F.lit(created_at).cast("timestamp"), "batch": F.lit(batch)}))

    def features(self, run_id: str | None = None) -> DataFrame:
        """Features of a run, by default the newest complete one; none before the first run."""
        run = resolve_run(self.read("runs"), run_id)
        return self.read("features").filter(F.col("run_id") == F.lit(run)).drop("run_id")

    # --- runs --------------------------------------------------------------------
    def write_run(
        self, run: DataFrame, clusters: DataFrame, assignments: DataFrame,
        insights: DataFrame, features: DataFrame,
    ) -> None:
        """Write the parts of a run under its id, then the row that makes it visible.

        A write that fails on the way leaves the former runs as they were, features included;
        a repeated one replaces the parts of its own run.
        """
        run_id = run.select("id").first()["id"]
        for table, df in (("features", features.withColumn("run_id", F.lit(run_id))),
                          ("clusters", clusters), ("assignments", assignments),
                          ("insights", insights)):
            self.append(table, df, mode="overwrite")
        self.append("runs", run.join(self.read("runs").select("id"), "id", "left_anti"))


def number_equal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``nth``, from 1 among the rows with equal ``keys``: rows are counted within their
    split, so a line that is bad all over a file does not meet in one task."""
    part = [*keys, "part_no"]
    before = Window.partitionBy(*keys).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*part).orderBy("row_no"))
    return rows.withColumn("own", own).join(sizes, part).withColumn(
        "nth", F.col("before") + F.col("own")).drop("before", "own")


def new_rows(rows: DataFrame, stored: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Rows whose key is not among the stored ones; only the key column is read there."""
    return rows.join(stored.select(key), key, "left_anti")
