"""Whitening of embeddings by an eigendecomposition that partitions build up vector by vector.

Every task keeps the eigenvalues and eigenvectors of what it has read so far and works new
vectors in by centred rank-one updates (``eigen``). The spectra of the tasks, one small row
each, are combined in groups, level by level, by rank-one updates again. A last pass over all
vectors refines the result: the covariance, centred at the exact mean, is projected on the
combined basis and solved there (Rayleigh-Ritz). Entries are whole numbers; counts, sums and
deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendspark.llm.centroids import integer_vectors, lists, matrix
from spendspark.llm.eigen import Spectrum, empty, merged, with_rows
from spendspark.llm.storage import discard, stored

SCALE, COMPONENTS = 256, 4
#: vectors that enter a spectrum together, and spectra that one task combines
BLOCK_ROWS, GROUP = 1024, 16

SPECTRUM = "place long, n long, mean array<double>, values array<double>, vectors array<double>"
ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def common_width(rows: DataFrame, column: str) -> int:
    """The number of entries that most vectors have, the larger of equal ones; 0 without any."""
    found = (rows.groupBy(F.size(column).alias("width")).agg(F.count("*").alias("n"))
             .where("width > 0").orderBy(F.desc("n"), F.desc("width")).first())
    return found["width"] if found else 0


def column_sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Exact count and sums of the entries; a task sends one row."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1, width + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            sums[0, 0] += len(x)
            sums[0, 1:] += x.sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([lists(sums, pa.int64())], names=["sums"])

    total = (vectors.select("x").mapInArrow(add, "sums array<long>")
             .select(F.posexplode("sums").alias("at", "v")).groupBy("at")
             .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    sums = [0] * (width + 1)
    for r in total:
        sums[r["at"]] = int(r["v"])
    return sums[0], sums[1:]


def _row(place: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int64()), pa.array([s.n], pa.int64()),
         *[lists(a.reshape(1, -1), pa.float64()) for a in (s.mean, s.values, s.vectors)]],
        names=["place", "n", "mean", "values", "vectors"])


def _read(batch: pa.RecordBatch, i: int) -> Spectrum:
    mean, values, vectors = (np.array(batch.column(c)[i].as_py()) for c in ("mean", "values", "vectors"))
    return Spectrum(batch.column("n")[i].as_py(), mean, values, vectors.reshape(len(mean), len(mean)))


def task_spectra(vectors: DataFrame, width: int, block_rows: int) -> DataFrame:
    """One spectrum for each task of ``vectors``."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = empty(width)
        for batch in batches:
            x = matrix(batch.column("x"), width).astype(np.float64)
            for at in range(0, len(x), block_rows):
                s = with_rows(s, x[at:at + block_rows])
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    return vectors.select("x").mapInArrow(gather, SPECTRUM)


def combined(spectra: DataFrame, group: int) -> Spectrum:
    """One spectrum of all, from groups of ``group`` neighbours; ``spectra`` is stored."""
    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks().to_batches()[0]
        s = _read(rows, 0)
        for i in range(1, rows.num_rows):
            s = merged(s, _read(rows, i))
        return pa.Table.from_batches([_row(rows.column("place")[0].as_py() // group, s)])

    count = spectra.count()
    while count > 1:
        following = stored(spectra.groupBy(F.expr(f"place div {group}")).applyInArrow(
            fold, SPECTRUM), "spectra")
        discard(spectra)
        spectra, count = following, following.count()
    row = spectra.first()
    discard(spectra)
    width = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]),
                    np.array(row["vectors"]).reshape(width, width))


def projected_covariance(vectors: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance, divisor ``n``, of the centred vectors in the columns of ``basis``."""
    width, k = basis.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = (matrix(batch.column("x"), width) - mean) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([lists(total.reshape(1, -1), pa.float64())], names=["sums"])

    out = np.zeros(k * k)
    for r in (vectors.select("x").mapInArrow(add, "sums array<double>")
              .select(F.posexplode("sums").alias("at", "v"))
              .groupBy("at").agg(F.sum("v").alias("v")).collect()):
        out[r["at"]] = r["v"]
    return out.reshape(k, k) / n


def principal(vectors: DataFrame, n: int, mean: np.ndarray, approximate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) from an approximate basis.

    The basis is made orthonormal and the covariance solved in it; the sign of a vector is
    that which makes its largest entry positive.
    """
    basis, _ = np.linalg.qr(approximate)
    values, inner = np.linalg.eigh(projected_covariance(vectors, n, mean, basis))
    values, own = values[::-1], basis @ inner[:, ::-1]
    own /= np.sqrt((own * own).sum(axis=0))
    return values, own * np.sign(own[np.abs(own).argmax(axis=0), np.arange(own.shape[1])])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n * x - sums)^2 by row; null where 64 bits do not hold one."""
    rough = ((n * x.astype(np.float64) - sums) ** 2).sum(axis=1)
    apart = n * x.astype(np.int64) - sums.astype(np.int64)
    return pa.array((apart * apart).sum(axis=1), pa.int64(), mask=rough >= 2.0 ** 63)


def whiten(rows: DataFrame, *, id_column: str = "vec_id", column: str = "embedding",
           scale: int = SCALE, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS,
           group: int = GROUP) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty or holds null or non-finite entries are left out, and
    those of another width than most have. The covariance is over each distinct vector once;
    repeated rows all get their rows of the result, null ids too. A component without variance
    has null as ``whitened``, and where nothing varies ``explained`` and ``identity_error`` are
    null. An empty table gives no rows; other columns are not looked at. ``deviation`` is null
    beyond 64 bits; a scaled entry beyond 2^27 raises an error.
    """
    width = common_width(rows, column)
    if width == 0:
        return rows.sparkSession.createDataFrame([], ROWS)
    kept = stored(integer_vectors(rows, id_column, column, width, scale), "vectors")
    fit = stored(kept.select("x").distinct(), "fit-vectors")
    n, sums = column_sums(fit, width)
    if n == 0:
        return rows.sparkSession.createDataFrame([], ROWS)
    mean = np.array([s / n for s in sums])
    exact = np.array(sums, np.float64 if max(map(abs, sums)) >= 1 << 62 else np.int64)
    found = combined(stored(task_spectra(fit, width, block_rows), "spectra"), group)
    values, own = principal(fit, n, mean, found.vectors)
    trace = float(values.sum())
    k = min(components, width)
    values, own = values[:k], own[:, :k]
    varies = values > width * np.finfo(np.float64).eps * max(trace, 0.0)
    onto = own[:, varies] / np.sqrt(values[varies])
    error = (float(np.abs(projected_covariance(fit, n, mean, onto) - np.eye(onto.shape[1])).max())
             if varies.any() else None)
    explained = [float(v) / trace if varies.any() else None for v in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            white = np.full((len(x), k), np.nan)
            white[:, varies] = (x - mean) @ onto
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(x) * k, n), pa.int64()), deviations(x, n, exact).take(at),
                 pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel())),
                 pa.array(explained * len(x), pa.float64()),
                 pa.array([error] * (len(x) * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(project, ROWS)
