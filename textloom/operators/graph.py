"""Nearest-neighbour graphs, their Laplacians, and spectral embeddings of small ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows above which an operator that needs a whole matrix refuses.
MOST = 5_000


def guarded(df: DataFrame, most: int = MOST) -> pd.DataFrame:
    """A frame that an algorithm on whole matrices needs, on the driver, after a check of its size."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows; at most {most} fit an algorithm on a whole matrix")
    return df.toPandas()


def symmetric(edges: DataFrame) -> DataFrame:
    """``src, dst`` in both directions, once each, without loops."""
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree`` of symmetric edges."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def laplacian(edges: DataFrame) -> DataFrame:
    """``i, j, value``: degrees on the diagonal, -1 for each edge."""
    diagonal = degrees(edges).select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").cast("bigint").alias("value"))
    return diagonal.union(edges.select("src", "dst", F.lit(-1).cast("bigint")))


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest component is positive."""
    v = v.copy()
    for c in range(v.shape[1]):
        if v[np.abs(v[:, c]).argmax(), c] < 0:
            v[:, c] *= -1
    return v


def eigenmap(edges: DataFrame, d: int = 2, normalised: bool = False) -> pd.DataFrame:
    """``node`` and ``d`` coordinates: the eigenvectors after the constant one of the (normalised) Laplacian.

    ``edges`` are symmetric; the number of nodes is checked before anything comes
    to the driver.
    """
    nodes = np.sort(guarded(degrees(edges).select("node"))["node"].to_numpy())
    pairs = edges.toPandas()
    at = {n: i for i, n in enumerate(nodes.tolist())}
    a = np.zeros((len(nodes), len(nodes)))
    a[pairs["src"].map(at), pairs["dst"].map(at)] = 1
    degree = a.sum(1)
    lap = np.diag(degree) - a
    if normalised:
        s = 1 / np.sqrt(degree)
        lap = s[:, None] * lap * s
    vectors = _signed(np.linalg.eigh(lap)[1][:, 1 : d + 1])
    return pd.DataFrame({"node": nodes, **{f"x{i + 1}": vectors[:, i] for i in range(vectors.shape[1])}})


def classical_mds(points: np.ndarray | None = None, distances: np.ndarray | None = None, d: int = 2) -> np.ndarray:
    """Coordinates whose distances fit the given ones best: top eigenpairs of the doubly centred squares."""
    if distances is None:
        s = (points * points).sum(1)
        distances = np.sqrt(np.maximum(s[:, None] + s - 2 * points @ points.T, 0))
    if len(distances) > MOST:
        raise ValueError(f"{len(distances)} rows; at most {MOST} fit an algorithm on a whole matrix")
    sq = distances**2
    b = -0.5 * (sq - sq.mean(0) - sq.mean(1)[:, None] + sq.mean())
    values, vectors = np.linalg.eigh(b)
    order = np.argsort(-values)[:d]
    return _signed(vectors[:, order] * np.sqrt(np.maximum(values[order], 0)))


def swiss_roll(spark, n: int, rotations: float = 1.5, seed: int = 0) -> DataFrame:
    """``i, x, y, z``: points of a rolled-up sheet, from hashed uniform numbers."""
    u, v = ((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6) for k in (1, 2))
    angle = 2 * np.pi * rotations * v
    r = 0.5 * F.exp(v * rotations)
    return spark.range(n).select(F.col("id").alias("i"), (6 * u).alias("x"), (r * F.cos(angle)).alias("y"), (r * F.sin(angle)).alias("z"))


def s_curve(spark, n: int, seed: int = 0) -> DataFrame:
    """``i, x, y, z``: points of an S-shaped sheet, from hashed uniform numbers."""
    u, v = ((F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1e6) for k in (1, 2))
    t = 3 * np.pi * (u - 0.5)
    return spark.range(n).select(F.col("id").alias("i"), F.sin(t).alias("x"), (2 * v).alias("y"), (F.signum(t) * (F.cos(t) - 1)).alias("z"))
