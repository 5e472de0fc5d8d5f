"""Centroid clustering of integer vectors with exact dot products that are kept and updated.

Each vector's dot products with all centroids are part of its row. When centroids move, only
their components that changed are multiplied again, for all vectors, and added; squared
distances follow from the dot products and two norms, and the least one is taken anew. All of
it is whole numbers, so nothing drifts however many rounds pass. Rows never leave their
partition: a round is one pass that writes the updated products and one that adds up the
vectors of each centroid, of which a task sends one row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.llm.storage import discard, stored

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: components up to here have exact distances in 64 bits; larger ones are refused
LARGEST = 1 << 27

STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls, all of ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of a matrix."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel(), kind))


def scaled_rows(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows kept, their components): lists of ``width`` finite entries, each
    entry c as floor(scale * c)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == width)
    rows = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(
        zero_copy_only=False).reshape(-1, width)
    fit = np.isfinite(rows).all(axis=1)
    whole = np.floor(rows[fit] * scale) + 0.0
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST // scale}, distances would not be exact")
    return at[fit], whole.astype(np.int64)


def exact_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers; through floating point where that is exact, as it is faster."""
    if x.size == 0 or y.size == 0:
        return np.zeros((len(x), len(y)), np.int64)
    if int(np.abs(x).max()) * int(np.abs(y).max()) * x.shape[1] < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def integer_vectors(rows: DataFrame, id_column: str, column: str, width: int, scale: int) -> DataFrame:
    """(vec_id, x) of the rows with ``width`` finite components."""
    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = scaled_rows(batch.column(1), width, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), lists(x, pa.int32())], names=["vec_id", "x"])

    return rows.select(F.col(id_column).cast("long"), F.col(column)).mapInArrow(
        scaled, "vec_id long, x array<int>")


def first_centroids(vectors: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of ``seed:id``; equal hashes go by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(centroids).collect()
    return np.array([r["x"] for r in found], np.int64)


def moved(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The dot products after centroids moved, and with them cluster and distance.

    ``state`` without products is that of centroids at the origin.
    """
    steps = [(c, np.flatnonzero(d), d[np.flatnonzero(d)]) for c, d in enumerate(after - before)]
    norms = (after * after).sum(axis=1)
    known = "dots" in state.columns
    k, width = after.shape

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width).astype(np.int64)
            dots = (matrix(batch.column("dots"), k).copy() if known
                    else np.zeros((len(x), k), np.int64))
            for c, at, by in steps:
                if len(at):
                    dots[:, c] += exact_dots(x[:, at], by[None, :])[:, 0]
            apart = (x * x).sum(axis=1)[:, None] + norms - 2 * dots
            nearest = apart.argmin(axis=1)  # the first of equal ones
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), lists(dots, pa.int64()),
                 pa.array(nearest, pa.int32()),
                 pa.array(np.take_along_axis(apart, nearest[:, None], 1)[:, 0], pa.int64())],
                names=["vec_id", "x", "dots", "cluster", "distance"])

    return state.mapInArrow(update, STATE)


def cluster_sums(state: DataFrame, k: int, width: int) -> dict[int, tuple[int, list[int]]]:
    """(count, component sums) of each cluster with members: ``k`` rows of ``width`` + 1 numbers."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("x"), width)
            for c in np.unique(own):
                rows = x[own == c]
                sums[c, 0] += len(rows)
                sums[c, 1:] += rows.sum(axis=0, dtype=np.int64)
        has = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), lists(sums[has], pa.int64())], names=["cluster", "sums"])

    partial = state.select("cluster", "x").mapInArrow(add, "cluster int, sums array<long>")
    total = (partial.select("cluster", F.posexplode("sums").alias("at", "v"))
             .groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    found: dict[int, list[int]] = {}
    for r in total:
        found.setdefault(r["cluster"], [0] * (width + 1))[r["at"]] = int(r["v"])
    return {c: (v[0], v[1:]) for c, v in found.items()}


def cluster_vectors(rows: DataFrame, *, id_column: str = "vec_id", column: str = "embedding",
                    width: int = DIMS, scale: int = SCALE, centroids: int = CENTROIDS,
                    rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and dots of vectors.

    Rows whose vector is null, of another width, or holds null or non-finite entries are left
    out. Ties go to the smaller centroid; a centroid without vectors stays. Fewer vectors than
    centroids make as many centroids as there are vectors; equal vectors count each, and may
    start as equal centroids, of which the first gets all. A null id counts as an empty one for
    the start. An empty table gives no rows; other columns are not looked at. A component whose
    distances could leave 64 bits raises an error.
    """
    state = stored(integer_vectors(rows, id_column, column, width, scale), "vectors")
    here = first_centroids(state, centroids, seed)
    if len(here) == 0:
        return state.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"),
            ("inertia", "long"), ("centroid_sha256", "string"), ("dots", "array<long>"))])
    before = np.zeros_like(here)
    for number in range(rounds + 1):
        following = stored(moved(state, before, here), "products")
        discard(state)
        state = following
        if number < rounds:
            before, here = here, here.copy()
            for c, (n, sums) in cluster_sums(state, *here.shape).items():
                here[c] = [s // n for s in sums]
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia)
    facts = rows.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(
            ",".join(map(str, here[r["cluster"]].tolist())).encode()).hexdigest()) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "dots")
