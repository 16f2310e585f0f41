"""Checks as frames of violations: an empty frame is a passed check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import usable


class Violation(ValueError):
    """What ``demand`` raises."""


def demand(violations: DataFrame, message: str) -> None:
    """Raises with the first violation, if there is one."""
    first = violations.first()
    if first is not None:
        raise Violation(f"{message}: {first.asDict()}")


def blank(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """``key, field``: fields that are null or blank."""
    each = F.explode(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in columns]))
    return df.select(key, each.alias("field")).where("field is not null")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """``key, n``: keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def bad_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key, reason`` of vectors that are null, of another length, not finite or all zero."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = F.when(v.isNull(), "null").when(F.size(v) != dim, "length").when(odd, "not finite").when(~usable(v, dim), "zero")
    return df.select(key, reason.alias("reason")).where("reason is not null")


def outside(df: DataFrame, key: str, column: str, allowed: list) -> DataFrame:
    """``key, value`` of values that aren't null and not allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(key, F.col(column).alias("value"))


def rare_classes(df: DataFrame, label: str, least: int, classes: list) -> DataFrame:
    """``class, n`` of classes with fewer than ``least`` rows, those without any too."""
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"class {df.schema[label].dataType.simpleString()}")
    have = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return every.join(have, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def orphans(df: DataFrame, key: str, reference: DataFrame, target: str) -> DataFrame:
    """Rows whose key isn't null and not in the reference."""
    return df.where(F.col(key).isNotNull()).join(reference.select(F.col(target).alias(key)).distinct(), key, "left_anti")


def disagreement(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """``key, here, there`` where two tables say different things of one key."""
    a, b = left.select(key, F.col(column).alias("here")), right.select(key, F.col(column).alias("there"))
    return a.join(b, key).where(~F.col("here").eqNullSafe(F.col("there")))


def wrong_sizes(df: DataFrame, group: str, wanted: int) -> DataFrame:
    """``group, n`` of groups that don't have exactly ``wanted`` rows."""
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") != wanted)
