"""Session helpers: durable intermediate results and size-checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20
#: shuffles of a write go when it ends, not whenever the driver's memory is next cleared
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_job_folder: ContextVar[str | None] = ContextVar("job_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it; it then gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        known = mkdtemp(prefix="run-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = _job_folder.get() or shared_dir(spark).rstrip("/")
    return f"{folder}/spendspark-{name}-{uuid.uuid4().hex}"


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[None]:
    """What ``durable`` writes inside goes when the job ends, however it ends."""
    path = scratch_path(spark, "job")
    token = _job_folder.set(path)
    try:
        yield
    finally:
        _job_folder.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_out(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet; the shuffles behind it are deleted with that."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there.

    Iterative jobs would otherwise replay their whole history after an executor loss.
    """
    path = scratch_path(df.sparkSession, "rows")
    write_out(df, path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Gathered:
    """Rows that a loop adds to one stored table. Reading it stays one scan, however often rows
    were added: unions of many tables would grow the driver's plans with every step."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, scratch_path(spark, name), None

    def add(self, df: DataFrame) -> None:
        write_out(df, self.path, "append")
        self.schema = df.schema

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` when its rows, written out, have at most ``max_bytes``.

    Above that it comes back unhinted, and the join shuffles, with the adaptive
    planner splitting hot keys. ``df`` is read once more for this: pass stored rows.
    """
    text = F.to_json(F.struct("*"))
    size = df.agg(F.sum(F.octet_length(text) + F.lit(16))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows evenly over tasks by a hash of ``columns``, which should tell most rows apart.

    Spark sorts the rows of a scan's task whole before a shuffle that keeps the first or the
    smallest of each group, however many rows a split unfolds to.
    """
    return df.repartition(*columns)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read instead of repeating.

    Spark moves a filter below the projection that made its columns and then evaluates
    their expressions twice. It does not move one below a generator, here of one row.
    """
    return df.select("*", F.inline(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))
