"""Eigenvalues and eigenvectors that follow a covariance while vectors arrive.

A ``Spectrum`` holds the number of vectors, their mean, and the eigendecomposition of their
scatter around it. Both another vector and another spectrum change the scatter by rank-one
terms, and each such term is worked into the decomposition by the roots of its secular
equation; directions that the term leaves alone are set aside first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

EPS = np.finfo(np.float64).eps


class Spectrum(NamedTuple):
    """``vectors`` has an eigenvector in each column, ``values`` rises."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def empty(width: int) -> Spectrum:
    return Spectrum(0, np.zeros(width), np.zeros(width), np.eye(width))


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(w / (d - root)), one right of each pole, for rising ``d``, ``w`` > 0.

    They come as (nearest pole, distance from it), which keeps the digits of small distances.
    Every step fits a curve with the two poles around a root; one that leaves the interval
    known to hold the root is replaced by its middle.
    """
    n, total = len(d), w.sum()
    right = np.append(d[1:], d[-1] + total * (1 + 4 * EPS))
    middle = (d + right) / 2
    at_middle = 1 + (w / (d - middle[:, None])).sum(axis=1)
    last = np.arange(n) == n - 1
    near = np.where((at_middle >= 0) | last, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    origin = d[near]
    poles = d[None, :] - origin[:, None]
    below = np.arange(n)[None, :] <= np.arange(n)[:, None]
    left_pole, right_pole = d - origin, right - origin
    half = middle - origin
    low = np.where(at_middle >= 0, left_pole, half)
    high = np.where(at_middle >= 0, half, right_pole)
    x = (low + high) / 2
    done = np.zeros(n, bool)
    for _ in range(200):
        gaps = poles - x[:, None]
        terms = w / gaps
        f = 1 + terms.sum(axis=1)
        done |= np.abs(f) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        done |= high - low <= 2 * EPS * np.minimum(np.abs(low), np.abs(high))
        if done.all():
            break
        slopes = terms / gaps
        psi = np.where(below, slopes, 0).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        a_left, a_right = left_pole - x, right_pole - x
        with np.errstate(all="ignore"):
            c = f - a_left * psi - a_right * phi
            a = (a_left + a_right) * f - a_left * a_right * (psi + phi)
            b = a_left * a_right * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``vectors @ diag(values) @ vectors.T + v v'``."""
    z = vectors.T @ v
    size = float(np.sqrt(z @ z))
    if size == 0.0:
        return values, vectors
    bound = 8 * EPS * max(abs(values).max(), size * size)
    values, vectors = values.copy(), vectors.copy()
    # deflation: entries too small to matter, then equal poles, of which one takes the entry
    active = np.abs(z) * size > bound
    kept: list[int] = []
    rows = np.flatnonzero(active)
    if len(rows) > 1 and np.diff(values[rows]).min() > 2 * bound:
        kept = rows.tolist()
    else:
        for j in rows.tolist():
            if kept:
                p = kept[-1]
                r = float(np.hypot(z[p], z[j]))
                c, s = z[j] / r, z[p] / r
                if abs((values[j] - values[p]) * c * s) <= bound:
                    vp, vj = vectors[:, p].copy(), vectors[:, j].copy()
                    vectors[:, p], vectors[:, j] = c * vp - s * vj, s * vp + c * vj
                    low, high = values[p], values[j]
                    values[p], values[j] = low * c * c + high * s * s, low * s * s + high * c * c
                    z[p], z[j] = 0.0, r
                    kept.pop()
            kept.append(j)
    at = np.array(kept)
    if len(at) == 0:
        return values, vectors
    order = np.argsort(values[at], kind="stable")
    at = at[order]
    d, w = values[at], z[at] ** 2
    if len(at) == 1:
        values[at] = d + w
    else:
        near, x = secular_roots(d, w)
        gaps = (d[near][:, None] - d[None, :]) + x[:, None]  # root i - pole j
        # entries for which the roots found are exact: the eigenvectors come out orthogonal
        m = len(at)
        i, j = np.indices((m, m))
        apart = d[:, None] - d[None, :]
        other = np.where(i < j, apart, np.roll(apart, -1, axis=0))
        ratio = np.where(i < m - 1, gaps / np.where(i < m - 1, other, 1.0), gaps)
        ratio[j == m - 1] = (gaps / np.where(i < j, apart, 1.0))[j == m - 1]
        exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[at])
        inner = exact[None, :] / -gaps
        inner /= np.sqrt((inner * inner).sum(axis=1))[:, None]
        vectors[:, at] = vectors[:, at] @ inner.T
        values[at] = d[near] + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def with_rows(spectrum: Spectrum, rows: np.ndarray) -> Spectrum:
    """The spectrum after more vectors.

    One vector is one centred rank-one term. Many act on the scatter as the rows of the
    triangular factor of their own centred block, at most as many as there are dimensions, and
    one term more for the distance of the two means.
    """
    if len(rows) == 0:
        return spectrum
    n, m = spectrum.n, len(rows)
    mean = rows.mean(axis=0)
    centred = rows - mean
    values, vectors = spectrum.values, spectrum.vectors
    terms = [] if m == 1 else np.linalg.qr(centred, mode="r")
    for term in [*terms, np.sqrt(n * m / (n + m)) * (mean - spectrum.mean)]:
        values, vectors = rank_one(values, vectors, term)
    return Spectrum(n + m, spectrum.mean + (mean - spectrum.mean) * (m / (n + m)), values, vectors)


def merged(one: Spectrum, two: Spectrum) -> Spectrum:
    """The spectrum of both sets of vectors: a rank-one term for each eigenpair of the second."""
    if one.n == 0 or two.n == 0:
        return two if one.n == 0 else one
    n = one.n + two.n
    values, vectors = one.values, one.vectors
    apart = two.mean - one.mean
    for term in [*(np.sqrt(np.maximum(two.values, 0)) * two.vectors).T,
                 np.sqrt(one.n / n * two.n) * apart]:
        values, vectors = rank_one(values, vectors, term)
    return Spectrum(n, one.mean + apart * (two.n / n), values, vectors)
