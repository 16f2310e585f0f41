"""Texts to an explained classifier in stages; each gives a new object, so nothing goes stale."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import classify, features, sampling, stats


@dataclass(frozen=True)
class Loaded:
    rows: DataFrame
    key: str
    text: str
    label: str

    def annotated(self, annotate: Callable[[DataFrame, str], DataFrame] = features.annotate) -> Annotated:
        return Annotated(self, annotate(self.rows, self.text))


@dataclass(frozen=True)
class Annotated:
    loaded: Loaded
    rows: DataFrame

    def counted(self, modes: list[int], low: int = 1, high: int = 2, most: int = 30) -> Counted:
        """The counts of the ``most`` frequent n-grams; the rest would only widen the table."""
        long = features.counts(self.rows, self.loaded.key, "tokens", modes, low, high)
        names = [r["feature"] for r in features.vocabulary(long, self.rows, most_features=most).orderBy("feature").collect()]
        wide = long.groupBy(self.loaded.key).agg(*[F.coalesce(F.sum(F.when(F.col("feature") == n, F.col("n"))), F.lit(0)).alias(f"f{i}") for i, n in enumerate(names)])
        table = self.rows.select(self.loaded.key, self.loaded.label).join(wide, self.loaded.key, "left").fillna(0, [f"f{i}" for i in range(len(names))])
        return Counted(self, table, names)


@dataclass(frozen=True)
class Counted:
    before: Annotated
    table: DataFrame
    names: list[str]

    def classified(self, share: float = 0.2, depth: int = 5, seed: int = 42) -> Classified:
        key, label = self.before.loaded.key, self.before.loaded.label
        rows = sampling.holdout(self.table.where(F.col(label).isNotNull()), key, label, share, seed)
        columns = [f"f{i}" for i in range(len(self.names))]
        model, assembler = classify.tree(rows.where("not test"), columns, label, depth, seed=seed)
        held = model.transform(assembler.transform(rows.where("test"))).withColumn("predicted", F.col("predicted").cast("int"))
        return Classified(self, model, stats.confusion(held, label, "predicted"))


@dataclass(frozen=True)
class Classified:
    before: Counted
    model: object
    measures: DataFrame

    def importance(self) -> list[tuple[str, float]]:
        """Features by importance in the tree, those of none left out."""
        values = np.array(self.model.featureImportances.toArray())
        order = np.argsort(-values, kind="stable")
        return [(self.before.names[i], float(values[i])) for i in order if values[i] > 0]
