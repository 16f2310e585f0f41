"""Dimension reduction: principal components of any set, a neighbour-graph layout of a small one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import MOST, _signed


def _moments(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[*s.tolist(), *q.ravel().tolist()]], pa.list_(pa.float64()))], names=["n", "v"])

    got = rows.mapInArrow(add, "n bigint, v array<double>").collect()  # a row per task
    n = sum(r["n"] for r in got)
    v = sum((np.array(r["v"]) for r in got), np.zeros(dim + dim * dim))
    return n, v[:dim], v[dim:].reshape(dim, dim)


def principal_components(df: DataFrame, key: str, vector: str, dim: int, d: int = 2) -> DataFrame:
    """``key, x1, x2, ...``: coordinates along the main axes of the centred vectors; each axis points to its largest component.

    Sums of products come from one pass; vectors of another length or null are left out.
    """
    rows = df.where(F.coalesce(F.size(vector) == dim, F.lit(False))).select(key, F.col(vector).cast("array<double>").alias("_v"))
    n, s, q = _moments(rows.select("_v"), dim)
    mean = s / max(n, 1)
    axes = _signed(np.linalg.eigh(q / max(n, 1) - np.outer(mean, mean))[1][:, ::-1][:, :d])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - mean) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(d)]], names=[key, *[f"x{i + 1}" for i in range(d)]])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(project, f"`{key}` {kind}, " + ", ".join(f"x{i + 1} double" for i in range(d)))


def neighbour_layout(x: np.ndarray, neighbours: int = 15, d: int = 2, spread: float = 1.0, nearest: float = 0.1, rounds: int = 200, seed: int = 42) -> np.ndarray:
    """Coordinates that keep neighbours close: fuzzy neighbour weights, attraction along them, repulsion from random rows."""
    n = len(x)
    if n > MOST:
        raise ValueError(f"{n} rows; at most {MOST} fit an algorithm on a whole matrix")
    if n <= d + 1:
        return np.zeros((n, d))
    k = min(neighbours, n - 1)
    unit = x / np.maximum(np.sqrt((x * x).sum(1))[:, None], 1e-300)
    dist = np.clip(1 - unit @ unit.T, 0, 2)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    gap = np.take_along_axis(dist, near, 1)
    gap = gap - gap[:, :1]
    low, high = np.zeros(n), np.full(n, 100.0)
    for _ in range(50):  # the width at which the weights sum to log2(k)
        mid = (low + high) / 2
        big = np.exp(-gap / np.maximum(mid, 1e-12)[:, None]).sum(1) > np.log2(k)
        high, low = np.where(big, mid, high), np.where(big, low, mid)
    w = np.zeros((n, n))
    w[np.arange(n)[:, None], near] = np.exp(-gap / np.maximum(high, 1e-12)[:, None])
    w = w + w.T - w * w.T
    r = np.linspace(0, 3 * spread, 300)
    want = np.where(r < nearest, 1.0, np.exp(-(r - nearest) / spread))
    best = min(((((1 / (1 + a * r ** (2 * b))) - want) ** 2).sum(), a, b) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.5, 1.5, 21))
    a, b = best[1], best[2]
    centred = x - x.mean(0)
    y = _signed(np.linalg.svd(centred, full_matrices=False)[0][:, :d]) * 10
    random = np.random.RandomState(seed)
    i, j = np.nonzero(np.triu(w))
    for t in range(rounds):
        rate = 1 - t / rounds
        use = random.rand(len(i)) < w[i, j]
        p, q = i[use], j[use]
        diff = y[p] - y[q]
        r2 = np.maximum((diff * diff).sum(1), 1e-12)
        pull = np.clip((-2 * a * b * r2 ** (b - 1) / (1 + a * r2**b))[:, None] * diff, -4, 4) * rate
        np.add.at(y, p, pull)
        np.add.at(y, q, -pull)
        other = random.randint(0, n, (len(p),))
        diff = y[p] - y[other]
        r2 = (diff * diff).sum(1)
        push = np.clip((2 * b / ((0.001 + r2) * (1 + a * r2**b)))[:, None] * diff, -4, 4) * rate
        np.add.at(y, p, push)
    return y
