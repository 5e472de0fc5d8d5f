"""k-means on scaled columns: fit, assignment, sweep over k, and cluster summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import column_distance, literal_vector, squared_distance
from ..runtime import discard, durable
from .silhouette import silhouettes

#: neighbouring vectors that are given to a center at once where their box allows it
BOX_ROWS = 32
#: vectors and starts that are compared one by one at a time
LOOSE_ROWS = 32_768


@dataclass(frozen=True)
class Fit:
    k: int
    cost: float
    centers: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Start:
    """First centers of one fit, and the column that says how many rows a vector stands for."""

    weight: str
    centers: np.ndarray


def near_together(vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The vectors, stored along a Z-curve: the bits of all coordinates in turn."""
    d = len(columns)
    bits = max(1, min(16, 62 // d))
    ends = vectors.agg(*[F.struct(F.min(c), F.max(c)).alias(f"e{j}") for j, c in enumerate(columns)]).first()
    place = F.lit(0).cast("bigint")
    for j, (c, (low, high)) in enumerate(zip(columns, ends)):
        step = ((high - low) if low is not None and high > low else 1.0) / (2 ** bits - 1)
        cell = F.floor((F.col(c) - F.lit(low or 0.0)) / F.lit(step)).cast("bigint")
        for bit in range(bits):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1)), bit * d + j))
    return durable(vectors.withColumn("_place", place).orderBy("_place").drop("_place"))


def _box_moments(x: np.ndarray, w: np.ndarray, centers: np.ndarray, with_cost: bool) -> np.ndarray:
    """(cluster, start) -> weight, cost and sums of the vectors ``x``, for ``centers`` by cluster
    and start; ties go to the lower cluster.

    Boxes of ``BOX_ROWS`` vectors whose nearest center is nearer than any other by more than the
    box's diameter go to it whole; vectors of other boxes are compared one by one.
    """
    k, s, d = centers.shape
    n, at = len(x), np.arange(0, len(x), BOX_ROWS)
    low, high = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
    mid, size = (low + high) / 2, np.sqrt(((high - low) ** 2).sum(axis=1))
    own, best, second = np.zeros((s, len(at)), int), None, np.full((s, len(at)), np.inf)
    for c in range(k):
        far = np.sqrt(sum((mid[None, :, j] - centers[c, :, j, None]) ** 2 for j in range(d)))
        if best is None:
            best = far
            continue
        closer = far < best
        second = np.where(closer, best, np.minimum(second, far))
        own[closer] = c
        best = np.minimum(best, far)
    whole = second - best > size * (1 + 1e-9) + 1e-9 * best
    off = x - np.repeat(mid, np.diff(np.append(at, n)), axis=0)
    weight = np.add.reduceat(w, at)
    apart = np.add.reduceat(w[:, None] * off, at)
    sums = apart + weight[:, None] * mid
    rows = np.column_stack([weight, np.zeros(len(at)), sums])
    spread = np.add.reduceat(w * (off * off).sum(axis=1), at) + 2 * (mid * apart).sum(axis=1)
    out = np.zeros((k, s, d + 2))
    for c in range(k):
        mine = (whole & (own == c)).astype(float)
        out[c] = mine @ rows
        if with_cost:
            out[c, :, 1] = (mine * (weight * best ** 2 + spread - 2 * centers[c] @ apart.T)).sum(axis=1)

    starts, boxes = np.nonzero(~whole)
    for lo in range(0, len(starts), LOOSE_ROWS // BOX_ROWS):
        row = (at[boxes[lo:lo + LOOSE_ROWS // BOX_ROWS], None] + np.arange(BOX_ROWS)).ravel()
        start = np.repeat(starts[lo:lo + LOOSE_ROWS // BOX_ROWS], BOX_ROWS)
        start, row = start[row < n], row[row < n]
        y, v = x[row], w[row]
        far = np.stack([sum((y[:, j] - centers[c, start, j]) ** 2 for j in range(d)) for c in range(k)])
        nearest = far.argmin(axis=0)
        cell = nearest * s + start
        parts = [v, v * far[nearest, np.arange(len(v))], *[v * y[:, j] for j in range(d)]]
        out += np.stack([np.bincount(cell, p, k * s) for p in parts], axis=1).reshape(k, s, d + 2)
    return out


def _moments(
    vectors: DataFrame, columns: Sequence[str], starts: dict[int, Start], with_cost: bool = False,
) -> dict:
    """(start, cluster) -> (weight, sums, cost) at the given centers: one pass for all starts.

    The cost is 0 unless asked for.
    """
    alike: dict[tuple[str, int], list[int]] = {}
    for i, start in starts.items():
        alike.setdefault((start.weight, len(start.centers)), []).append(i)
    known = vectors.sparkSession.sparkContext.broadcast([
        (weight, ids, np.stack([starts[i].centers for i in ids], axis=1))
        for (weight, _), ids in alike.items()])
    names = list(columns)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list = [0] * len(known.value)
        for part in batches:
            x = part[names].to_numpy(float)
            for g, (weight, _, centers) in enumerate(known.value if len(x) else []):
                total[g] = total[g] + _box_moments(x, part[weight].to_numpy(float), centers, with_cost)
        yield pd.DataFrame([
            (i, c, *row) for moments, (_, ids, _) in zip(total, known.value) if np.ndim(moments)
            for c, of_cluster in enumerate(moments) for i, row in zip(ids, of_cluster)], columns=out)

    out = ["start", "cluster", "w", "cost", *[f"s{j}" for j in range(len(names))]]
    sums = (vectors.mapInPandas(step, "start int, cluster int, " + ", ".join(
        f"{c} double" for c in out[2:])).groupBy("start", "cluster").agg(
        *[F.sum(c).alias(c) for c in out[2:]]).collect())
    return {(r["start"], r["cluster"]): (r["w"], np.array(r[4:]), r["cost"]) for r in sums}


def run_starts(
    vectors: DataFrame, columns: Sequence[str], starts: Sequence[Start], max_iter: int = 300,
    tolerance: float = 1e-4,
) -> list[Fit]:
    """Move the centers of all starts over the same weighted vectors until they rest.

    Every pass serves all starts that still move, so their number costs no more jobs; the
    driver sees a row per start and cluster.
    """
    now = dict(enumerate(starts))
    moving = set(now)
    for _ in range(max_iter):
        if not moving:
            break
        sums = _moments(vectors, columns, {i: now[i] for i in moving})
        for i in sorted(moving):
            old = now[i].centers
            new = np.array([sums[i, c][1] / sums[i, c][0] if (i, c) in sums and sums[i, c][0] > 0
                            else old[c] for c in range(len(old))])
            now[i] = Start(now[i].weight, new)
            if ((new - old) ** 2).sum(axis=1).max() <= tolerance ** 2:
                moving.discard(i)
    last = _moments(vectors, columns, now, with_cost=True)
    return [Fit(len(s.centers), max(0.0, float(sum(last[i, c][2] for c in range(len(s.centers))
                                                   if (i, c) in last))),
                tuple(sorted(tuple(float(v) for v in c) for c in s.centers)))
            for i, s in now.items()]


def _even(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers over 0 and up to 1, evenly spread, from hashes and a salt."""
    z = h.astype(np.int64).view(np.uint64) ^ np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53


def draw_starts(
    vectors: DataFrame, columns: Sequence[str], tasks: Sequence[tuple[int, str, int]],
) -> list[Start]:
    """A start for each (k, weight column, seed), drawn from all vectors.

    The first center is drawn by weight, each next one by weight times squared distance from
    those before: the vector with the least exponential key at that rate. A pass draws the next
    center of all starts; keys come from a hash of the values, so partitioning changes nothing.
    Where no vector is left at a distance, weights alone decide, and without weights the hash.
    """
    names = list(columns)
    hashed = vectors.withColumn("_h", F.xxhash64(*names))
    centers = {i: np.empty((0, len(names))) for i in range(len(tasks))}
    out = ["start", "tier", "key", *[f"x{j}" for j in range(len(names))]]
    while wanted := [i for i, (k, _, _) in enumerate(tasks) if len(centers[i]) < k]:
        known = vectors.sparkSession.sparkContext.broadcast([
            (i, tasks[i][1], centers[i], int(np.random.default_rng(
                [tasks[i][2], tasks[i][0], len(centers[i])]).integers(2 ** 63))) for i in wanted])

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple] = {}
            for part in batches:
                x, h = part[names].to_numpy(float), part["_h"].to_numpy()
                if not len(x):
                    continue
                low, high = x.min(axis=0), x.max(axis=0)
                for i, weight, chosen, salt in known.value:
                    w, even = part[weight].to_numpy(float), _even(h, salt)
                    # a key is at least (1 - even) / rate, so most vectors cannot beat the best one
                    far = (np.maximum(np.abs(low - chosen), np.abs(high - chosen)) ** 2).sum(axis=1)
                    top = w.max() * (far.min() if len(chosen) else 1.0) * (1 + 1e-9)
                    some = (np.flatnonzero(1 - even <= best[i][1] * top) if i in best and best[i][0] == 0
                            else np.arange(len(x)))
                    if not len(some):
                        continue
                    y, w = x[some], w[some]
                    far = (sum((y[:, j, None] - chosen[None, :, j]) ** 2 for j in range(x.shape[1])).min(axis=1)
                           if len(chosen) else np.ones(len(y)))
                    tier = np.where(w * far > 0, 0, np.where(w > 0, 1, 2))
                    rate = np.where(tier == 0, w * far, np.where(tier == 1, w, 1.0))
                    key = -np.log(even[some]) / rate
                    at = np.lexsort((key, tier))[0]
                    row = (int(tier[at]), float(key[at]), *map(float, y[at]))
                    best[i] = min(best.get(i, row), row)
            yield pd.DataFrame([(i, *row) for i, row in best.items()], columns=out)

        drawn = hashed.mapInPandas(draw, "start int, tier int, " + ", ".join(
            f"{c} double" for c in out[2:])).groupBy("start").agg(
            F.min(F.struct(*out[1:])).alias("m")).collect()
        if not drawn:
            raise ValueError("no vectors to draw starts from")
        for r in drawn:
            centers[r["start"]] = np.vstack([centers[r["start"]], r["m"][2:]])
    return [Start(weight, centers[i]) for i, (_, weight, _) in enumerate(tasks)]


def best_fits(tasks: Sequence[tuple], fits: Sequence[Fit]) -> dict:
    """The cheapest fit for each first element of ``tasks``; the earlier one of equals."""
    best: dict = {}
    for (key, *_), f in zip(tasks, fits):
        if key not in best or f.cost < best[key].cost:
            best[key] = f
    return best


def fit_many(
    scaled: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int = 25,
    seed: int = 42, max_iter: int = 300,
) -> dict[int, Fit]:
    """Per k the lowest-cost fit of ``n_init`` starts, all moved together.

    Equal rows become one weighted vector first: features hang on merchant and amount, so
    this shrinks a large ledger many times before the passes. Centers come back sorted, so
    cluster numbers do not depend on seed or partitioning.
    """
    unordered = durable(scaled.groupBy(*columns).agg(F.count("*").cast("double").alias("weight")))
    vectors = near_together(unordered, columns)
    discard(unordered)
    tasks = [(k, "weight", seed + i) for k in ks for i in range(n_init)]
    fits = run_starts(vectors, columns, draw_starts(vectors, columns, tasks), max_iter)
    discard(vectors)
    return best_fits(tasks, fits)


def fit_kmeans(
    scaled: DataFrame, columns: Sequence[str], k: int, n_init: int = 25, seed: int = 42,
    max_iter: int = 300,
) -> Fit:
    return fit_many(scaled, columns, [k], n_init, seed, max_iter)[k]


def nearest_columns(columns: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """struct(d2, cluster) of the nearest center; the lower number wins a tie."""
    return F.array_min(F.array(*[
        F.struct(column_distance(columns, c).alias("d2"), F.lit(i).alias("cluster"))
        for i, c in enumerate(centers)]))


def assign_columns(
    scaled: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]],
    label: str = "cluster_index", distance: str | None = "distance_to_centroid",
) -> DataFrame:
    out = scaled.withColumn("_near", nearest_columns(columns, centers)).withColumn(
        label, F.col("_near.cluster"))
    if distance:
        out = out.withColumn(distance, F.sqrt("_near.d2"))
    return out.drop("_near")


def assign_vectors(
    points: DataFrame, vector: str, centers: Sequence[Sequence[float]],
    label: str = "cluster_index", distance: str = "distance_to_centroid",
) -> DataFrame:
    """Nearest of a few literal centers for an ``array<double>`` column."""
    near = F.array_min(F.array(*[
        F.struct(squared_distance(F.col(vector), literal_vector(c)).alias("d2"),
                 F.lit(i).alias("cluster"))
        for i, c in enumerate(centers)]))
    return points.withColumn("_near", near).withColumns({
        label: F.col("_near.cluster"), distance: F.sqrt("_near.d2")}).drop("_near")


def sweep_k(
    scaled: DataFrame, columns: Sequence[str], k_min: int = 2, k_max: int = 8,
    n_init: int = 25, seed: int = 42, max_iter: int = 300, method: str = "squared",
) -> tuple[Fit, list[dict]]:
    """Fit every k, score all labelings by the silhouette of ``method``, keep the best.

    Returns the chosen fit and one dict per k (k, inertia, silhouette). The smallest k
    wins a tie; labelings with a single used cluster score -1.
    """
    top = min(k_max, max(2, scaled.count() - 1))
    fits = fit_many(scaled, columns, range(k_min, top + 1), n_init, seed, max_iter)
    labelled = scaled.select(*columns)
    for k, fit in fits.items():
        labelled = assign_columns(labelled, columns, fit.centers, f"k{k}", None)
    scores = silhouettes(labelled, columns, [f"k{k}" for k in fits], method)
    sweep = [
        {"k": k, "inertia": fit.cost,
         "silhouette": s["silhouette"] if s["silhouette"] is not None else -1.0}
        for (k, fit), s in zip(fits.items(), scores)
    ]
    best = max(sweep, key=lambda r: (r["silhouette"], -r["k"]))
    return fits[best["k"]], sweep


def sweep_frame(spark: SparkSession, sweep: list[dict]) -> DataFrame:
    return spark.createDataFrame(sweep, "k int, inertia double, silhouette double")


def raw_centroids(
    rows: DataFrame, columns: Sequence[str], label: str = "cluster_index"
) -> DataFrame:
    """Mean of the unscaled features per cluster: the centroids in raw units."""
    return rows.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])


def cluster_totals(assigned: DataFrame, keys: Sequence[str] = ("cluster_index",)) -> DataFrame:
    return assigned.groupBy(*keys).agg(
        F.count("*").alias("n_transactions"), F.sum("amount").alias("total_amount"))


