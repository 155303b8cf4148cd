"""Clusters of each key's vectors: hierarchical with four linkages, and spectral.

A key is one channel's few hundred to few thousand vectors; keys are the unit of parallel work. Labels are numbered by first appearance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LINKAGES = ("complete", "average", "centroid", "ward")
#: Shares of a key's vectors that are tried as numbers of neighbours, vectors a cluster that may be found, restarts of k-means.
SHARES, MOST, RESTARTS, SEED = np.geomspace(0.01, 0.25, 8), 8, 4, 0


def by_appearance(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered from 0 in the order in which they first appear."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)


def _joined(method: str, di: np.ndarray, dj: np.ndarray, dij: float, ni: float, nj: float, nk: np.ndarray) -> np.ndarray:
    """Distances of all others to the union of two clusters (squared ones for centroid and ward), from those to its parts."""
    if method == "complete":
        return np.maximum(di, dj)
    both = ni + nj
    if method == "average":
        return (ni * di + nj * dj) / both
    if method == "centroid":
        return (ni * di + nj * dj) / both - ni * nj * dij / both**2
    return ((nk + ni) * di + (nk + nj) * dj - nk * dij) / (nk + both)


def hierarchy(x: np.ndarray, method: str = "complete", threshold: float | None = None, count: int | None = None) -> np.ndarray:
    """Labels after merging the two nearest clusters again and again, until ``count`` are left, or else while their distance is below ``threshold``.

    Complete and average linkage use cosine distance, centroid and ward the Euclidean one between
    unit vectors. Of equal distances that of the cluster which appears first is taken.
    """
    if method not in LINKAGES:
        raise ValueError(f"linkage {method} is none of {LINKAGES}")
    if (threshold is None) == (count is None):
        raise ValueError("give either a threshold or a count")
    n, squared = len(x), method in ("centroid", "ward")
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    v = unit_rows(np.asarray(x, dtype=np.float64))
    alike, own = v @ v.T, (v * v).sum(axis=1)
    d = np.maximum(own[:, None] + own[None, :] - 2 * alike if squared else 1 - alike, 0)
    np.fill_diagonal(d, np.inf)
    label, size, left = np.arange(n), np.ones(n), n
    near = d.argmin(axis=1)
    best = d[np.arange(n), near]
    while left > max(count or 1, 1):
        i = int(best.argmin())
        i, j = sorted((i, int(near[i])))
        height = float(np.sqrt(max(d[i, j], 0)) if squared else d[i, j])
        if threshold is not None and height >= threshold:
            break
        new = _joined(method, d[i], d[j], d[i, j], size[i], size[j], size)
        new[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        label[label == j], size[i], size[j], left = i, size[i] + size[j], 0, left - 1
        stale = np.flatnonzero((near == i) | (near == j) | (np.arange(n) == i) | (np.arange(n) == j))
        near[stale] = d[stale].argmin(axis=1)
        best[stale] = d[stale, near[stale]]
        closer = new < best
        near[closer], best[closer] = i, new[closer]
    return by_appearance(label)


def k_means(x: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    """Labels of the best of a few runs of Lloyd's algorithm from spread-out starts, drawn with a seed."""
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), dtype=np.int64))
    for _ in range(RESTARTS):
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < k:
            away = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).min(axis=1)
            pick = int(rng.choice(len(x), p=away / away.sum())) if away.sum() > 0 else int(rng.integers(len(x)))
            centres = np.vstack([centres, x[pick]])
        label = np.full(len(x), -1)
        for _ in range(100):
            apart = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
            new = apart.argmin(axis=1)
            if (new == label).all():
                break
            label = new
            for c in range(k):
                if (label == c).any():
                    centres[c] = x[label == c].mean(axis=0)
        cost = float(apart[np.arange(len(x)), label].sum())
        if cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def spectrum(v: np.ndarray, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and eigenvectors of the normalised affinity in which every vector keeps its nearest ones."""
    alike = v @ v.T
    kept = np.zeros_like(alike)
    order = np.argsort(-alike, axis=1, kind="stable")[:, : neighbours + 1]
    np.put_along_axis(kept, order, np.take_along_axis(alike, order, axis=1), axis=1)
    kept = (kept + kept.T) / 2
    scale = 1 / np.sqrt(np.maximum(kept.sum(axis=1), 1e-10))
    values, vectors = np.linalg.eigh(scale[:, None] * kept * scale[None, :])
    return values[::-1], vectors[:, ::-1]


def spectral(x: np.ndarray, count: int | None = None, most: int = MOST, seed: int = SEED) -> np.ndarray:
    """Labels by k-means on the leading eigenvectors of the affinity, with the number of neighbours whose eigengap is largest for its share of the vectors.

    Without ``count`` it is the place of the largest gap among the first ``most``.
    """
    n = len(x)
    if count is not None and n <= count or n <= 2:
        return np.arange(n)
    v, chosen = unit_rows(np.asarray(x, dtype=np.float64)), None
    for neighbours in sorted({min(n - 1, max(2, round(s * n))) for s in SHARES}):
        values, vectors = spectrum(v, neighbours)
        gaps = values[: min(most, n - 1)] - values[1 : min(most, n - 1) + 1]
        k = count or int(gaps.argmax()) + 1
        score = (values[k - 1] - values[k]) / (neighbours / n)
        if chosen is None or score > chosen[0] + 1e-12:
            chosen = (score, k, vectors[:, :k])
    return by_appearance(k_means(unit_rows(chosen[2]), chosen[1], seed))


def clustered_by(points: DataFrame, method: str, threshold: float | None = None, count: int | None = None) -> DataFrame:
    """(key, seq, cluster) of the vectors (key, seq, v); ``method`` is a linkage or ``spectral``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
        return pdf[["key", "seq"]].assign(cluster=spectral(x, count) if method == "spectral" else hierarchy(x, method, threshold, count))

    return points.select("key", "seq", "v").groupBy("key").applyInPandas(run, "key long, seq long, cluster int")
