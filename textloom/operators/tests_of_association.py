"""Chi-squared and exact tests of association, effect sizes, and step-down adjustment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import effect_size


def chi_squared_tail(x: float, dof: int) -> float:
    """The probability of a larger value: the upper regularised gamma function at half of both."""
    if x <= 0 or dof < 1:
        return 1.0
    a, y = dof / 2, x / 2
    if y < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= y / k
            total += term
        return max(0.0, 1 - total * math.exp(-y + a * math.log(y) - math.lgamma(a)))
    b = y + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if an * d + b else 1e-300)
        c = b + an / c if b + an / c else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-y + a * math.log(y) - math.lgamma(a)) * h


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables of the same margins that are no likelier."""
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    choose = (lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1))
    base = choose(n, c1)
    p = {x: math.exp(choose(r1, x) + choose(r2, c1 - x) - base) for x in range(max(0, c1 - r2), min(r1, c1) + 1)}
    return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))


def contingency(df: DataFrame, feature: str, label: str) -> DataFrame:
    """``level, n0, n1, rate``: rows of label 0 and 1 by level of a feature, and the share of label 1; null levels are left out."""
    rows = df.where(F.col(label).isin(0, 1) & F.col(feature).isNotNull())
    return rows.groupBy(F.col(feature).alias("level")).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).withColumn("rate", F.round(F.col("n1") / (F.col("n0") + F.col("n1")), 6))


def association(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``feature, n, levels, statistic, dof, cramers_v, effect, least_expected`` of each feature against the label.

    Pearson's statistic without a correction, from one pass over all features.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features]))
    rows = df.where(F.col(label).isin(0, 1)).select(F.col(label).alias("y"), each.alias("e")).select("y", "e.feature", "e.level").where("level is not null")
    cell = rows.groupBy("feature", "level", "y").agg(F.count("*").alias("o"))
    line = cell.groupBy("feature", "level").agg(F.sum("o").alias("r"))
    side = cell.groupBy("feature", "y").agg(F.sum("o").alias("c"))
    total = side.groupBy("feature").agg(F.sum("c").alias("n"))
    grid = line.join(side, "feature").join(total, "feature").join(cell, ["feature", "level", "y"], "left")
    e = F.col("r") * F.col("c") / F.col("n")
    made = grid.groupBy("feature").agg(F.max("n").alias("n"), F.countDistinct("level").alias("levels"), F.countDistinct("y").alias("sides"), F.sum((F.coalesce("o", F.lit(0)) - e) * (F.coalesce("o", F.lit(0)) - e) / e).alias("x2"), F.min(e).alias("least"))
    v = F.sqrt(F.col("x2") / (F.col("n") * F.greatest(F.lit(1), F.least(F.col("levels"), F.col("sides")) - 1)))
    return made.select("feature", "n", "levels", F.round("x2", 6).alias("statistic"), ((F.col("levels") - 1) * (F.col("sides") - 1)).alias("dof"), F.round(v, 6).alias("cramers_v"), effect_size(v).alias("effect"), F.round("least", 6).alias("least_expected"))


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """``df`` with ``adjusted``: step-down p-values; the table of tests is small."""
    order = Window.orderBy(p, name)
    stepped = (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1) * F.col(p)
    rows = df.withColumn("_s", stepped)
    return rows.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def tested(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``association`` with ``test``, ``p`` and ``adjusted``; exact for 2 x 2 tables with an expected count below five."""
    spark = df.sparkSession
    out = []
    for r in association(df, features, label).collect():  # a row per feature
        test, p = "chi2", chi_squared_tail(r["statistic"], r["dof"])
        if r["levels"] == 2 and r["dof"] == 1 and r["least_expected"] < 5:
            cells = contingency(df, r["feature"], label).orderBy("level").collect()
            test, p = "fisher", fisher_exact(cells[0]["n0"], cells[0]["n1"], cells[1]["n0"], cells[1]["n1"])
        out.append((r["feature"], test, r["statistic"], r["dof"], r["cramers_v"], r["effect"], p))
    return holm(spark.createDataFrame(out, "feature string, test string, statistic double, dof bigint, cramers_v double, effect string, p double"), "p", "feature")
