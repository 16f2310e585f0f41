"""Samples, folds and splits that are the same on every run: rows are drawn by a hash of seed and key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    """The order in which rows are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _numbered(df: DataFrame, seed: int, key: str, *by: str) -> DataFrame:
    """``_place``, the place of each row in the drawing order of its group, without sorting a group in one task.

    Rows fall into 4096 ranges of the hash; a range's rows are numbered on their
    own and moved up by the number of rows in the ranges before.
    """
    order = draw(seed, key)
    rows = df.withColumns({"_draw": order, "_range": F.substring(order, 1, 3)})
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")).drop("_n")
    on = [*by, "_range"]
    before = before.toDF(*[f"_at_{c}" for c in on], "_before")
    matches = F.lit(True)
    for c in on:
        matches = matches & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    joined = rows.join(before, matches, "left").drop(*[f"_at_{c}" for c in on])
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_draw", key))
    return joined.withColumn("_place", F.col("_before") + inside).drop("_draw", "_range", "_before")


def thin_matching(df: DataFrame, key: str, matches: Column, fraction: float, seed: int = 42) -> DataFrame:
    """All rows that don't match, and ``bround(n * fraction)`` of the ``n`` that do; a null match is none."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction has to be within 0 and 1")
    hit = F.coalesce(matches, F.lit(False))
    rows = df.withColumn("_hit", hit)
    chosen = _numbered(rows.where("_hit"), seed, key)
    n = rows.where("_hit").agg(F.expr(f"bround(count(*) * {float(fraction)}D, 0)").cast("bigint").alias("_keep"))
    kept = chosen.join(F.broadcast(n), F.col("_place") <= F.col("_keep")).drop("_place", "_keep")
    return rows.where("not _hit").unionByName(kept).drop("_hit")


def balanced(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """As many rows of each label as the rarest has; null labels are left out."""
    rows = df.where(F.col(label).isNotNull())
    least = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    return _numbered(rows, seed, key, label).join(F.broadcast(least), F.col("_place") <= F.col("_least")).drop("_place", "_least")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from 0 to ``k - 1``, every label spread evenly over the folds."""
    if k < 2:
        raise ValueError("at least two folds")
    return _numbered(df, seed, key, label).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def holdout(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``test``: ``bround(n * share)`` rows of each label are for testing."""
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.expr(f"bround(count(*) * {float(share)}D, 0)").cast("bigint").alias("_keep"))
    rows = _numbered(df, seed, key, label)
    return rows.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label"))).select(*df.columns, (F.col("_place") <= F.col("_keep")).alias("test"))


def missing_numbers(df: DataFrame, group: str, number: str, upto: int) -> DataFrame:
    """``group, number``: of 1 to ``upto`` those a group doesn't have."""
    have = df.where(F.col(number).between(1, upto)).groupBy(group).agg(F.collect_set(F.col(number).cast("int")).alias("have"))  # at most upto values
    every = df.select(group).distinct().join(have, group, "left")
    return every.select(group, F.explode(F.array_except(F.sequence(F.lit(1), F.lit(upto)), F.coalesce("have", F.array().cast("array<int>")))).alias("number"))


def continue_numbers(new: DataFrame, existing: DataFrame, group: str, order: Iterable[str]) -> DataFrame:
    """``new`` with ``number``: counted on within each group from the number of existing rows."""
    counts = existing.groupBy(group).agg(F.count("*").alias("_have"))
    rows = new.join(counts, group, "left")
    return rows.withColumn("number", F.coalesce("_have", F.lit(0)) + F.row_number().over(Window.partitionBy(group).orderBy(*order))).drop("_have")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The rows in the drawing order."""
    return df.orderBy(draw(seed, key), key)
