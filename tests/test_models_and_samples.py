import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import classify, features, sampling
from textloom.operators import tests_of_association as association


def test_tails():
    assert abs(association.chi_squared_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(association.chi_squared_tail(11.070497693516351, 5) - 0.05) < 1e-9
    assert association.chi_squared_tail(0, 3) == 1.0
    assert abs(association.fisher_exact(8, 2, 1, 5) - 0.034965034965) < 1e-9


def test_association_and_step_down(spark):
    rows = [(1, "a", 1)] * 30 + [(0, "a", 0)] * 10 + [(1, "b", 1)] * 10 + [(0, "b", 0)] * 30 + [(None, "a", 1), (1, None, 0)]
    out = {r["feature"]: r for r in association.tested(spark.createDataFrame(rows, "y int, f string, g int"), ["f", "g"], "y").collect()}
    assert out["f"]["statistic"] == pytest.approx(20.0) and out["f"]["cramers_v"] == pytest.approx(0.5) and out["f"]["effect"] == "large"
    assert out["f"]["adjusted"] >= out["f"]["p"]
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert [round(r["adjusted"], 4) for r in association.holm(tests, "p", "name").orderBy("name").collect()] == [0.03, 0.06, 0.06]


def test_logistic_equals_newton(spark):
    random = np.random.RandomState(0)
    x = random.randn(300, 2)
    y = (random.rand(300) < 1 / (1 + np.exp(-(x @ [1.5, -1] - 1)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    model = classify.logistic(df, ["a", "b"], "y")
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    z, beta = np.column_stack([x, np.ones(300)]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.eye(3), z.T @ (w * (p - y)) + beta)
    assert np.allclose(model.beta, beta, atol=1e-6)
    t = model.table()
    assert ((t["low"] < t["coefficient"]) & (t["coefficient"] < t["high"])).all()
    with pytest.raises(ValueError):
        classify.logistic(df, ["a"], "y", c=0)


def test_shapley_values_equal_their_definition():
    random = np.random.RandomState(4)

    def grow(depth):
        at = len(nodes)
        nodes.append({"weight": 0.0, "value": 0.0, "feature": -1})
        if depth == 0 or random.rand() < 0.15:
            nodes[at] |= {"weight": float(random.randint(1, 9)), "value": random.rand()}
        else:
            nodes[at] |= {"feature": int(random.randint(5)), "threshold": random.randn()}
            nodes[at] |= {"left": grow(depth - 1), "right": grow(depth - 1)}
            nodes[at]["weight"] = nodes[nodes[at]["left"]]["weight"] + nodes[nodes[at]["right"]]["weight"]
        return at

    def expect(row, known, at=0):
        n = nodes[at]
        if n["feature"] < 0:
            return n["value"]
        a, b = nodes[n["left"]]["weight"], nodes[n["right"]]["weight"]
        if n["feature"] in known:
            return expect(row, known, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"])
        return (a * expect(row, known, n["left"]) + b * expect(row, known, n["right"])) / (a + b)

    for _ in range(6):
        nodes = []
        grow(5)
        x = random.randn(4, 5)
        got = classify.shap_values(nodes, x)
        for r in range(4):
            for f in range(5):
                want = 0.0
                for k in range(5):
                    for s in combinations([o for o in range(5) if o != f], k):
                        want += math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * (expect(x[r], {*s, f}) - expect(x[r], {*s}))
                assert abs(got[r, f] - want) < 1e-12


def test_shapley_values_add_up(spark):
    random = np.random.RandomState(1)
    x = random.randn(200, 3)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)}))
    model, assembler = classify.tree(df, ["a", "b", "c"], "y", depth=3)
    nodes = classify.tree_nodes(model)
    values = classify.shap_values(nodes, x[:20])

    def predict(row, at=0):
        n = nodes[at]
        return n["value"] if n["feature"] < 0 else predict(row, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"])

    def mean(at=0):
        n = nodes[at]
        if n["feature"] < 0:
            return n["value"]
        a, b = nodes[n["left"]]["weight"], nodes[n["right"]]["weight"]
        return (a * mean(n["left"]) + b * mean(n["right"])) / (a + b)

    assert np.allclose(values.sum(1) + mean(), [predict(r) for r in x[:20]])


def test_samples(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 201)] + [(900, None)], "i int, y int")
    thin = sampling.thin_matching(df, "i", F.col("y") == 0, 0.1)
    assert thin.where("y = 0").count() == 15 and thin.where("y = 1 or y is null").count() == 51
    assert thin.exceptAll(sampling.thin_matching(df.repartition(7), "i", F.col("y") == 0, 0.1)).count() == 0
    assert {r["y"]: r["count"] for r in sampling.balanced(df, "i", "y").groupBy("y").count().collect()} == {0: 50, 1: 50}
    folds = sampling.folds(df.where("y is not null"), "i", "y", 10).groupBy("fold", "y").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {5, 15}
    assert {(r["y"], r["n"]) for r in sampling.holdout(df, "i", "y").where("test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 30), (1, 10)}
    with pytest.raises(ValueError):
        sampling.thin_matching(df, "i", F.lit(True), 1.5)


def test_numbers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 9)], "g string, n int")
    assert {tuple(r) for r in sampling.missing_numbers(df, "g", "n", 3).collect()} == {("a", 2), ("b", 1), ("b", 2), ("b", 3)}
    new = spark.createDataFrame([("a", 5), ("a", 4), ("c", 1)], "g string, i int")
    assert {(r["g"], r["i"], r["number"]) for r in sampling.continue_numbers(new, df, "g", ["i"]).collect()} == {("a", 4, 3), ("a", 5, 4), ("c", 1, 1)}


def test_ngram_counts_of_modes(spark):
    df = features.annotate(spark.createDataFrame([(1, "A cat sat cat"), (2, "A dog sat"), (3, None)], "i int, t string"), "t")
    got = {(r["i"], r["feature"]): r["n"] for r in features.counts(df, "i", "tokens", [10]).collect()}
    assert got[1, "cat_10"] == 2 and got[1, "a cat_10"] == 1 and got[1, "cat sat cat_10"] == 1 and got[2, "a dog sat_10"] == 1 and (2, "cat_10") not in got
    both = {r["feature"] for r in features.counts(df, "i", "tokens", [10, 20], 1, 1).collect()}
    assert "a_cat_20" in both and "cat_10" in both
    long = features.counts(df, "i", "tokens", [10], 1, 1)
    vocabulary = features.vocabulary(long, df, most_features=1)
    assert [r["feature"] for r in vocabulary.collect()] == ["a_10"]
    assert features.recount(long, vocabulary).count() == 2
    # shares are of all rows, the one without a feature too
    assert features.vocabulary(long, df, least_share=0.7).count() == 0 and features.vocabulary(long, df, most_share=0.5, least_rows=2).count() == 0
    whole = {tuple(r) for r in features.corpus_counts(df, "tokens", [10, 20], 1, 2).collect()}
    assert whole == {tuple(r) for r in features.vocabulary(features.counts(df, "i", "tokens", [10, 20], 1, 2), df).collect()}
    assert features.frame_summary(long, df, "i").first().asDict() == {"rows": 3, "filled": 2, "features": 4, "counts": 6, "density": 0.5}
    for mode in (10, 11, 12, 13, 20, 21, 22, 23, 30, 31, 32, 40, 50, 51, 52, 60, 61):
        df.select(features.symbols(F.col("tokens"), mode)).collect()
    with pytest.raises(ValueError):
        features.symbols(F.col("tokens"), 99)


def test_out_of_fold_scores_come_from_models_without_the_row(spark):
    rows = [(i, float(i % 7), i % 3, int(i % 7 > 3) if i % 11 else 1 - int(i % 7 > 3), i % 4) for i in range(200)] + [(900, None, 1, 1, 0)]
    df = spark.createDataFrame(rows, "i int, x double, z int, y int, fold int")
    got = {r["i"]: r["score"] for r in classify.out_of_fold(df, ["x", "z"], "y", 4).collect()}
    assert set(got) == set(range(200))
    for k in range(4):
        alone = classify.logistic(df.where(F.col("fold") != k), ["x", "z"], "y")
        held = {r["i"]: r["score"] for r in alone.score(df.where(F.col("fold") == k).dropna()).collect()}
        assert all(abs(got[i] - s) < 1e-9 for i, s in held.items())
