"""Classifiers with weighted classes, held-out and cross-validated measures, intervals and explanations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.stats import confusion


def weighted(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: n / (classes * n of the row's class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = counts.crossJoin(F.broadcast(whole)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # by one row
    return df.join(F.broadcast(table), label)


def _sums(rows: DataFrame, features: list[str], label: str, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, curvature and loss of the weighted logistic loss, summed over the tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(beta)
    d = len(features) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, loss = np.zeros(d), np.zeros((d, d)), 0.0
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            x = np.column_stack([*cols[2:], np.ones(len(cols[0]))])
            s = x @ shared.value
            p = 1 / (1 + np.exp(-np.clip(s, -700, 700)))
            g += x.T @ (cols[1] * (p - cols[0]))
            h += (x * (cols[1] * p * (1 - p))[:, None]).T @ x
            loss += float((cols[1] * (np.logaddexp(0, s) - cols[0] * s)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel(), [loss]]).tolist()], pa.list_(pa.float64()))], names=["v"])

    made = rows.select(F.col(label).cast("double"), F.col("weight").cast("double"), *[F.col(f).cast("double") for f in features]).mapInArrow(add, "v array<double>")
    total = sum((np.array(r["v"]) for r in made.collect()), np.zeros(d + d * d + 1))  # a row per task
    return total[:d], total[d:-1].reshape(d, d), float(total[-1])


class Logistic:
    """A fitted logistic model: coefficients, the constant last, and their covariance."""

    def __init__(self, features: list[str], beta: np.ndarray, covariance: np.ndarray) -> None:
        self.features, self.beta, self.covariance = features, beta, covariance

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``score`` and ``predicted``, 1 above 0."""
        s = F.lit(float(self.beta[-1]))
        for f, b in zip(self.features, self.beta, strict=False):
            s = s + F.col(f).cast("double") * float(b)
        return df.withColumn("score", s).withColumn("predicted", (F.col("score") > 0).cast("int"))

    def table(self) -> pd.DataFrame:
        """Coefficients with 95 % intervals and odds ratios."""
        se = np.sqrt(np.diag(self.covariance))
        low, high = self.beta - 1.959963984540054 * se, self.beta + 1.959963984540054 * se
        return pd.DataFrame({"feature": [*self.features, "(constant)"], "coefficient": self.beta, "low": low, "high": high, "odds_ratio": np.exp(self.beta)})


def logistic(df: DataFrame, features: list[str], label: str, c: float = 1.0, rounds: int = 50) -> Logistic:
    """Newton's method on the class-weighted loss plus squares / (2 c), the constant included in the penalty.

    Each round sums a matrix of features by features over the tasks; rows with a
    null are left out.
    """
    if c <= 0:
        raise ValueError("c has to be positive")
    rows = weighted(df.dropna(subset=[label, *features]), label).persist()
    beta = np.zeros(len(features) + 1)
    eye = np.eye(len(beta)) / c
    g, h, loss = _sums(rows, features, label, beta)
    for _ in range(rounds):
        step = np.linalg.solve(h + eye, g + beta / c)
        size = 1.0
        while True:
            new = beta - size * step
            g2, h2, loss2 = _sums(rows, features, label, new)
            if loss2 + new @ new / (2 * c) <= loss + beta @ beta / (2 * c) + 1e-12 or size < 1e-6:
                break
            size /= 2
        done = np.abs(new - beta).max() < 1e-9
        beta, g, h, loss = new, g2, h2, loss2
        if done:
            break
    rows.unpersist()
    return Logistic(features, beta, np.linalg.inv(h + eye))


def tree(train: DataFrame, features: list[str], label: str, depth: int = 6, boosted: bool = False, seed: int = 42):
    """A fitted decision tree (or boosted trees) with class weights, and the assembler of its features."""
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    kind = GBTClassifier(maxIter=50, stepSize=0.05, maxDepth=4, seed=seed) if boosted else DecisionTreeClassifier(maxDepth=depth, seed=seed)
    kind = kind.setFeaturesCol("_features").setLabelCol(label).setWeightCol("weight").setPredictionCol("predicted")
    return kind.fit(assembler.transform(weighted(train, label))), assembler


def cross_validated(df: DataFrame, features: list[str], label: str, k: int, depth: int = 6, seed: int = 42) -> DataFrame:
    """``fold`` and the measures of ``confusion`` on each held-out fold; ``df`` has ``fold``, see ``sampling.folds``."""
    out = None
    for i in range(k):
        model, assembler = tree(df.where(F.col("fold") != i), features, label, depth, seed=seed)
        held = model.transform(assembler.transform(df.where(F.col("fold") == i))).withColumn("predicted", F.col("predicted").cast("int"))
        part = confusion(held, label, "predicted").withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(df: DataFrame, features: list[str], label: str, k: int, c: float = 1.0) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` of a logistic model that hasn't seen the row's fold; ``df`` has ``fold``.

    Rows with a null in a feature or the label are left out.
    """
    rows, out = df.dropna(subset=[label, *features]), None
    for i in range(k):
        part = logistic(rows.where(F.col("fold") != i), features, label, c).score(rows.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def tree_nodes(model) -> list[dict]:
    """The nodes of a fitted tree: feature, threshold, children, share of label 1 and weight reaching it."""
    nodes: list[dict] = []

    def walk(node) -> int:
        at = len(nodes)
        stats = list(node.impurityStats().stats()) if hasattr(node, "impurityStats") else []
        nodes.append({"weight": float(sum(stats)), "value": float(stats[1] / sum(stats)) if len(stats) > 1 and sum(stats) else 0.0, "feature": -1})
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            nodes[at]["feature"], nodes[at]["threshold"] = split.featureIndex(), split.threshold()
            nodes[at]["left"] = walk(node.leftChild())
            nodes[at]["right"] = walk(node.rightChild())
        return at

    walk(model._java_obj.rootNode())
    return nodes


def shap_values(nodes: list[dict], x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values of each row and feature of one tree, for all rows at once and any number of features.

    A leaf pays its value to rows that take every branch above it. A feature
    that isn't known takes its branches with the share of the weight that does,
    so a leaf's pay to a coalition is a product over the features above it, and
    the average over coalitions of a size is a coefficient of the polynomial
    whose factors are those features.
    """
    out = np.zeros(x.shape)
    # a leaf's path: for each feature the rows that keep to it and the share of weight that does
    stack: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
    while stack:
        at, path = stack.pop()
        n = nodes[at]
        if n["feature"] >= 0:
            f, goes_left = n["feature"], x[:, n["feature"]] <= n["threshold"]
            keeps, share = path.get(f, (np.ones(len(x), bool), 1.0))
            for child, takes in ((n["left"], goes_left), (n["right"], ~goes_left)):
                part = nodes[child]["weight"] / (nodes[n["left"]]["weight"] + nodes[n["right"]]["weight"])
                stack.append((child, {**path, f: (keeps & takes, share * part)}))
            continue
        d = len(path)
        for f, (keeps, share) in path.items():
            by_size = np.zeros((d, len(x)))
            by_size[0] = 1.0
            for k, (other, (there, z)) in enumerate((o, v) for o, v in path.items() if o != f):
                by_size[1 : k + 2] = by_size[1 : k + 2] * z + by_size[: k + 1] * there
                by_size[0] *= z
            weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
            out[:, f] += n["value"] * (weights @ by_size) * (keeps - share)
    return out


def signed_importance(long: DataFrame) -> DataFrame:
    """``feature, importance, direction``: mean absolute Shapley value, and the sign of its covariance with the feature; ``long`` has ``feature, x, shap``."""
    return long.groupBy("feature").agg(F.round(F.avg(F.abs("shap")), 9).alias("importance"), F.signum(F.round(F.covar_pop("x", "shap"), 12)).alias("direction"))
