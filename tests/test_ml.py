from __future__ import annotations

import math
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendspark.operators import anomaly, kmeans, projection, quantiles, scaling, silhouette, stability

COLS = ["a", "b", "c"]


def frame(spark, x, **extra):
    rows = [(f"t{i:05d}", *map(float, r), *(v[i] for v in extra.values())) for i, r in enumerate(x)]
    names = ["transaction_id", *COLS[: x.shape[1]], *extra]
    return spark.createDataFrame(rows, names)


def blobs(seed=0, n=150, d=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [6, 6, 0], [0, 7, 7]])[:, :d]
    y = rng.integers(0, 3, n)
    return centers[y] + rng.normal(size=(n, d)), y


def test_scaler(spark):
    x, _ = blobs()
    x[:, 2] = 4.25
    df = frame(spark, x)
    scaler = scaling.fit_scaler(df, COLS)
    got = scaler.transform(df).orderBy("transaction_id").toPandas()[COLS].to_numpy()
    std = x.std(axis=0)
    np.testing.assert_allclose(got[:, :2], ((x - x.mean(axis=0)) / np.where(std, std, 1))[:, :2])
    np.testing.assert_allclose(got[:, 2], 0, atol=1e-9)
    np.testing.assert_allclose(scaler.to_raw([1, -1, 0]), x.mean(axis=0) + [std[0], -std[1], 0])


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (y == y[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][y == y[i]].sum() / (own - 1)
        b = min(d[i][y == v].mean() for v in set(y) if v != y[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


@pytest.mark.parametrize("block", [2048, 37])
def test_silhouettes_exact(spark, monkeypatch, block):
    monkeypatch.setattr(silhouette, "BLOCK", block)
    x, y = blobs(1)
    x[10:20] = x[10]  # equal rows
    y[10:20] = y[10]
    other = np.where(np.arange(len(x)) == 3, 9, y % 2)  # a cluster of one
    flat = np.zeros(len(x), int)
    df = frame(spark, x, y=y.tolist(), z=other.tolist(), one=flat.tolist())
    got = silhouette.silhouettes(df, COLS, ["y", "z", "one"])
    assert got[0]["silhouette"] == pytest.approx(brute_silhouette(x, y).mean())
    assert got[1]["silhouette"] == pytest.approx(brute_silhouette(x, other).mean())
    assert got[2]["silhouette"] is None
    assert got[0]["n_points"] == len(x)


def test_silhouette_tiles(spark, monkeypatch):
    """A point is copied to tiles, not to blocks, and a pair of tiles is compared once."""
    x, y = blobs(3)
    monkeypatch.setattr(silhouette, "BLOCK", 16)
    monkeypatch.setattr(silhouette, "TILE", 40)
    monkeypatch.setattr(silhouette, "TILES", 3)
    met = spark.sparkContext.accumulator(0)
    distances = silhouette._distance_function()

    def counted(a, b):
        met.add(len(a) * len(b))
        return distances(a, b)

    monkeypatch.setattr(silhouette, "_distance_function", lambda: counted)
    got = silhouette.silhouettes(frame(spark, x, y=y.tolist()), COLS, ["y"])[0]
    assert got["silhouette"] == pytest.approx(brute_silhouette(x, y).mean())
    assert met.value < 0.8 * len(x) ** 2


def test_distances_of_near_points():
    """Tiny distances far from the origin, equal points and values without a number stay as they are."""
    distances = silhouette._distance_function()
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (60, 5))
    x[20:40] = x[:20] + 1e-10 * rng.normal(0, 1, (20, 5))
    x[40:50] = x[:10]
    x += 100.0
    with np.errstate(all="ignore"):
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.testing.assert_allclose(distances(x, x), want, rtol=1e-7, atol=0)
        x[3, 1], x[7, 2] = np.nan, np.inf
        want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.testing.assert_allclose(distances(x, x), want, rtol=1e-7, atol=0)


def test_squared_silhouette(spark):
    """Linear form against all distances, with equal rows, a cluster of one, and one cluster."""
    x, y = blobs(2, 120)
    x[10:20], y[10:20] = x[10], y[10]
    other = np.where(np.arange(len(x)) == 3, 9, y % 2)
    df = frame(spark, x, y=y.tolist(), z=other.tolist(), one=[0] * len(x))
    got = silhouette.silhouettes(df, COLS, ["y", "z", "one"], method="squared")
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    for g, labels in zip(got, (y, other)):
        values = []
        for i in range(len(x)):
            mean = {v: far[i][labels == v].sum() / max(1, (labels == v).sum() - (v == labels[i])) for v in set(labels)}
            a, b = mean.pop(labels[i]), min(mean.values())
            values.append((b - a) / max(a, b) if (labels == labels[i]).sum() > 1 else 0.0)
        assert g["silhouette"] == pytest.approx(np.mean(values)) and g["n_points"] == len(x)
    assert got[2]["silhouette"] is None


def test_adjusted_rand(spark):
    rng = np.random.default_rng(0)

    def brute(a, b):
        tp = fp = fn = tn = 0
        for i, j in combinations(range(len(a)), 2):
            x, y = a[i] == a[j], b[i] == b[j]
            tp, fp, fn, tn = tp + (x and y), fp + (not x and y), fn + (x and not y), tn + (not x and not y)
        return 1.0 if fp == fn == 0 else 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))

    for a, b in [(rng.integers(0, 3, 40), rng.integers(0, 4, 40)), ([1, 1, 2], [5, 5, 7]), ([1, 2], [1, 1])]:
        df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "p int, q int")
        row = stability.adjusted_rand(df, "p", "q").first()
        assert row["ari"] == pytest.approx(brute(a, b)) and row["n"] == len(a)


def test_kmeans_sweep_and_stability(spark):
    x, y = blobs(3, 200)
    df = frame(spark, x).persist()
    best, sweep = kmeans.sweep_k(df, COLS, 2, 4, n_init=4, method="euclidean")
    assert best.k == 3 and [r["k"] for r in sweep] == [2, 3, 4]
    assert list(best.centers) == sorted(best.centers)
    got = kmeans.assign_columns(df, COLS, best.centers).orderBy("transaction_id").toPandas()
    d = np.sqrt(((x[:, None] - np.array(best.centers)[None]) ** 2).sum(-1))
    np.testing.assert_array_equal(got.cluster_index, d.argmin(1))
    np.testing.assert_allclose(got.distance_to_centroid, d.min(1))
    assert sum((got.distance_to_centroid) ** 2) == pytest.approx(best.cost)
    assert sweep[1]["silhouette"] == pytest.approx(brute_silhouette(x, d.argmin(1)).mean())
    linear, _ = kmeans.sweep_k(df, COLS, 2, 4, n_init=4)
    assert linear.k == 3 and linear.cost == pytest.approx(best.cost)
    scores = stability.stability(df, COLS, best, seeds=3, n_init=4)
    assert len(scores) == 3 and min(scores) > 0.9
    assert stability.stability(df.limit(19), COLS, best) is None
    limits = stability.hash_limits(df, "transaction_id", [1, 2], 160)
    for s in (1, 2):
        assert df.filter(stability.salted("transaction_id", s) <= limits[s]).count() == 160
    assert kmeans.sweep_k(df.limit(3), COLS, n_init=1)[1][0]["k"] == 2


def test_starts_share_passes_and_weights(spark):
    """A weight of n stands for n equal rows, and starts do not disturb each other."""
    x, _ = blobs(6, 60)
    df = frame(spark, x).withColumn("one", F.lit(1.0)).withColumn("half", (F.col("a") > 2).cast("double"))
    first = [kmeans.Start("one", x[:3]), kmeans.Start("half", x[5:8]), kmeans.Start("one", x[:2])]
    together = kmeans.run_starts(df, COLS, first)
    alone = [kmeans.run_starts(df, COLS, [f])[0] for f in first]
    for a, b in zip(together, alone):
        np.testing.assert_allclose(a.centers, b.centers)
    doubled = kmeans.run_starts(df.withColumn("one", F.lit(2.0)), COLS, first[:1])[0]
    assert doubled.cost == pytest.approx(2 * together[0].cost)
    np.testing.assert_allclose(doubled.centers, together[0].centers)


def test_assign_vectors_and_raw_centroids(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 5.0])], "i int, v array<double>")
    got = kmeans.assign_vectors(df, "v", [[0, 0], [5, 4], [5, 4]]).orderBy("i").collect()
    assert [(r["cluster_index"], r["distance_to_centroid"]) for r in got] == [(0, 1.0), (1, 1.0)]


def test_pca(spark):
    x, _ = blobs(4)
    x = (x - x.mean(0)) / x.std(0)
    placed, ratios = projection.pca_2d(frame(spark, x), COLS)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    axes = [v if abs(v.max()) >= abs(v.min()) else -v for v in vt[:2]]
    got = placed.orderBy("transaction_id").toPandas()
    np.testing.assert_allclose(got[["pca_x", "pca_y"]], x @ np.array(axes).T, atol=1e-8)
    np.testing.assert_allclose(ratios, (s**2 / (s**2).sum())[:2])
    single, _ = projection.pca_2d(frame(spark, x[:, :1]), ["a"])
    assert single.filter("pca_y <> 0").count() == 0


@pytest.mark.parametrize("limits", [(4096, 10_000), (4, 3)])
def test_exact_percentile(spark, monkeypatch, limits):
    monkeypatch.setattr(quantiles, "BINS", limits[0])
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", limits[1])
    rng = np.random.default_rng(1)
    for values in (rng.exponential(size=301) ** 4, np.repeat([1.0, 2.0, 5.0], [40, 1, 9]), np.array([3.0]),
                   np.array([0.0, 0.0, 1e-300, 1e300])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for p in (0.0, 0.33, 0.5, 0.9, 1.0):
            assert quantiles.exact_percentile(df, "x", p) == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
    assert quantiles.exact_percentile(spark.createDataFrame([], "x double"), "x", 0.5) is None


@pytest.mark.parametrize("coarse", [10_000_000, 7])
def test_weighted_median(spark, monkeypatch, coarse):
    monkeypatch.setattr(quantiles, "COARSE", coarse)
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(12):
        v = rng.choice(np.arange(-40, 60), size=rng.integers(1, 9), replace=False)
        w = rng.integers(1, 5, len(v))
        rows += [(k, int(a), int(b)) for a, b in zip(v, w)]
        want[k] = (2 * np.median(np.repeat(v, w)), int(w.sum()))
    df = spark.createDataFrame(rows, "k int, v long, w long")
    got = {r["k"]: (r["median2"], r["n"]) for r in quantiles.weighted_median2(df, "k", "v", "w").collect()}
    assert got == want


def test_robust_z(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"m{rng.integers(0, 6)}", round(float(rng.exponential(100)), 2)) for i in range(200)]
    rows += [(900 + i, "FLAT", 10.0) for i in range(4)] + [(910, "FLAT", 10.5), (920, "PAIR", 1.0), (921, "PAIR", 99.0)]
    df = spark.createDataFrame(rows, "id int, m string, amount double")
    got = {r["id"]: r for r in anomaly.robust_z(df, merchant="m").collect()}
    assert len(got) == len(rows)
    for m in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == m]
        v = np.array([r[2] for r in mine])
        if len(v) < 3:
            assert all(got[r[0]]["z"] is None and not got[r[0]]["is_unusual"] for r in mine)
            continue
        med = np.median(v)
        mad = round(np.median(np.abs(v - med)), 6) or 1e-9
        for r in mine:
            z = 0.6745 * (r[2] - med) / mad
            assert got[r[0]]["z"] == pytest.approx(z, rel=1e-6, abs=1e-9)
            assert got[r[0]]["is_unusual"] == (abs(z) > 3.5)
    assert got[910]["z_reason"] == "unusual amount for FLAT (z=337250000.0)"
    assert got[900]["z_reason"] is None


def brute_noise(x, eps, min_samples=4):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_samples
    return {f"t{i:05d}" for i in range(len(x)) if not core[i] and not (near[i] & core).any()}


@pytest.mark.parametrize("d, n, eps", [(1, 40, 0.05), (2, 120, 0.3), (2, 120, 0.15), (3, 200, 0.6), (3, 200, 0.4)])
def test_density_outliers_against_brute_force(spark, d, n, eps):
    rng = np.random.default_rng(d * 100 + n)
    x = np.concatenate([rng.normal(size=(n, d)), rng.normal(size=(n, d)) * 0.1, np.full((5, d), 3.0)])
    got = anomaly.density_outliers(frame(spark, x), COLS[:d], eps=eps)
    assert {r[0] for r in got.collect()} == brute_noise(x, eps)


@pytest.mark.parametrize("leaf, deepest", [(1024, 30), (4, 30), (4, 2)])
def test_density_outliers_with_crowded_boxes(spark, monkeypatch, leaf, deepest):
    """A crowd that the radius of single points cuts, a third of all rows equal, a null."""
    monkeypatch.setattr(anomaly, "LEAF_VECTORS", leaf)
    monkeypatch.setattr(anomaly, "MAX_LEVEL", deepest)
    rng = np.random.default_rng(7)
    angle = rng.random(40) * 2 * np.pi
    ring = np.stack([np.cos(angle), np.sin(angle)], 1) * rng.uniform(0.9, 1.25, (40, 1))
    x = np.concatenate([
        rng.normal(size=(900, 2)) * 0.06, ring, np.full((500, 2), -0.0), np.full((3, 2), 4.0),
        [[0.0, 5.0]], [[-0.0, 5.0]], rng.uniform(-6, 6, (60, 2))])
    df = frame(spark, x).unionByName(frame(spark, x[:1]).withColumns(
        {COLS[0]: F.lit(None).cast("double"), "transaction_id": F.lit(None).cast(
            frame(spark, x[:1]).schema["transaction_id"].dataType)}))
    got = anomaly.density_outliers(df, COLS[:2], eps=1.0)
    expected = brute_noise(x, 1.0)
    assert len(expected) > 5
    assert sorted(r[0] for r in got.collect()) == sorted(expected)


def test_density_outliers_of_nothing(spark):
    assert anomaly.density_outliers(frame(spark, np.zeros((1, 2))).limit(0), COLS[:2]).count() == 0


def test_density_eps(spark):
    x, _ = blobs(5)
    df = frame(spark, x)
    away = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    assert anomaly.density_eps(df, COLS, list(x.mean(0))) == pytest.approx(np.percentile(away, 90))
    same = frame(spark, np.zeros((5, 3)))
    assert anomaly.density_eps(same, COLS, [0, 0, 0]) == 1.0


def test_flag_anomalies(spark):
    t = datetime(2024, 1, 1)
    rows = [(f"t{i}", t + timedelta(days=i), 10.0 + (i == 5) * 500 + i * 0.1, "M") for i in range(8)]
    df = spark.createDataFrame(rows, "transaction_id string, txn_date timestamp, amount double, counterparty_normalized string")
    noise = spark.createDataFrame([("t5",), ("t1",)], "transaction_id string")
    got = {r["transaction_id"]: r for r in anomaly.flag_anomalies(df, noise).collect()}
    assert got["t5"]["anomaly_reason"].startswith("unusual amount for M (z=")
    assert got["t1"]["anomaly_reason"] == "density outlier (DBSCAN)"
    assert [k for k, r in got.items() if r["is_anomaly"]] == [k for k in got if k in ("t1", "t5")]
    assert math.isfinite(float(got["t5"]["anomaly_reason"].split("z=")[1][:-1]))
    assert df.join(noise, "transaction_id").agg(F.count("*")).first()[0] == 2


def test_starts_are_drawn_from_all_vectors(spark):
    """Eight single vectors far from 20,000 others, and one that stands for most rows."""
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), 1.0) for a, b in rng.random((20_000, 2))]
    far = [(1e3 * float(np.cos(t)), 1e3 * float(np.sin(t))) for t in range(8)]
    df = spark.createDataFrame([*rows, *[(a, b, 1.0) for a, b in far], (0.5, 0.5, 1e5)], "a double, b double, w double")
    tasks = [(10, "w", s) for s in range(5)]
    starts = kmeans.draw_starts(df, ["a", "b"], tasks)
    for s in starts:
        assert s.centers.shape == (10, 2) and set(far) <= set(map(tuple, s.centers.tolist()))
    again = kmeans.draw_starts(df.repartition(7), ["a", "b"], tasks)
    assert all((x.centers == y.centers).all() for x, y in zip(starts, again))
    first = [tuple(s.centers[0]) for s in kmeans.draw_starts(df, ["a", "b"], [(1, "w", s) for s in range(40)])]
    assert first.count((0.5, 0.5)) > 25


def test_moments_of_boxes(spark):
    """Sums and costs of whole boxes are those of single vectors, of any weight and tie."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 3)), np.zeros((90, 3)), rng.integers(0, 3, (211, 3)) / 2])
    w = rng.integers(0, 4, len(x)).astype(float)
    near = kmeans.near_together(frame(spark, x, w=[float(v) for v in w]), COLS)
    assert sorted(map(tuple, near.select(*COLS).collect())) == sorted(map(tuple, x))
    centers = np.concatenate([rng.normal(size=(4, 6, 3)), rng.integers(0, 3, (4, 2, 3)) / 2.0], axis=1)
    rows = near.toPandas()
    got = kmeans._box_moments(rows[COLS].to_numpy(float), rows["w"].to_numpy(float), centers, True)
    for s in range(8):
        far = ((x[:, None, :] - centers[None, :, s]) ** 2).sum(axis=2)
        for c in range(4):
            mine = w * (far.argmin(axis=1) == c)
            want = [mine.sum(), mine @ far[:, c], *(mine @ x)]
            np.testing.assert_allclose(got[c, s], want, atol=1e-9)


def test_most_vectors_move_in_boxes(spark, monkeypatch):
    """Of a crowd only the vectors of boxes between centers are compared one by one."""
    x = np.random.default_rng(5).normal(size=(20_000, 2))
    rows = kmeans.near_together(frame(spark, x), COLS[:2]).toPandas()[COLS[:2]].to_numpy(float)
    compared, count = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: compared.append(len(a[0])) or count(*a))
    kmeans._box_moments(rows, np.ones(len(rows)), np.array([[[-1.0, 0.0]], [[1.0, 0.0]]]), False)
    assert sum(compared) / 4 < len(x) / 3


def test_tables_of_fits_go_when_nothing_reads_them(spark, monkeypatch):
    """Vectors and labelings are deleted once their fit, score or stability is known."""
    kept, durable = [], kmeans.durable

    def noted(df):
        table = durable(df)
        kept.append(Path(table.stored_path.removeprefix("file:")))
        assert kept[-1].exists()
        return table

    for module in (kmeans, silhouette, stability):
        monkeypatch.setattr(module, "durable", noted)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.2, (20, 2)) for c in (0, 5)])
    rows = frame(spark, x)
    fit, _ = kmeans.sweep_k(rows, COLS[:2], 2, 3, n_init=2, method="squared")
    assert fit.k == 2
    assert stability.stability(rows, COLS[:2], fit, seeds=2, n_init=2) == [1.0, 1.0]
    assert len(kept) == 5 and not any(path.exists() for path in kept)
