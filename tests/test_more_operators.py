import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import clustering, incremental, sampling, validation
from textloom.operators.pipeline import Loaded


def value(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_terms_and_roots(spark):
    got = value(spark, T.clause_terms, "Text beginning with an aside, then a long appeal, then an enumeration of ideas", "It is starting where it is something", None)
    assert {"beginning", "an aside", "a long appeal", "an enumeration"} <= set(got[0]) and not {"text", "an"} & set(got[0])
    assert "is starting" in got[1] and "is something" not in got[1] and got[2] == []
    assert value(spark, T.semantic_root, "starts", "is starting", "begins", "is beginning", "class") == ["start", "start", "begin", "begin", "class"]


def test_word_clusters(spark):
    counts = spark.createDataFrame([("academic", 2), ("factual", 5), ("starting", 1)], "term string, n bigint")
    members = spark.createDataFrame([("academic", 0), ("factual", 0)], "term string, cluster int")
    assert [(r["name"], r["words"], r["grouped"]) for r in clustering.word_clusters(counts, members).collect()] == [("cluster1", ["factual", "academic"], 2)]


def test_forced_topics(spark):
    rows = [(i, t, v) for i, (t, v) in enumerate([(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.0, 1.0]), (1, [0.1, 0.9]), (-1, [0.8, 0.2])])]
    got = clustering.forced(spark.createDataFrame(rows, "i int, topic int, v array<double>"), "i", "topic", "v", 2).orderBy("i").collect()
    assert [r["topic"] for r in got] == [0, 0, 1, 1, 0] and sum(r["forced"] for r in got) == 1


def test_distance_summary(spark):
    x = np.random.RandomState(0).randn(30, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    d = clustering.distance_matrix(x)[np.triu_indices(30, 1)]
    got = clustering.distance_summary(df, "i", "v", 3, block=7).toPandas()
    assert got["pairs"].sum() == 435 and abs(got["mean"][0] - d.mean()) < 1e-5 and abs(got["stdev"][0] - d.std()) < 1e-5
    assert clustering.distance_summary(df.limit(0), "i", "v", 3).count() == 0


def test_cluster_columns_and_examples(spark):
    df = spark.createDataFrame([(1, None, 0, "a", 0.5), (2, 3, 0, "b", 0.9), (3, 3, -1, "c", 0.1)], "i int, cluster_id int, cluster int, q string, p double")
    assert clustering.cluster_column(df) == "cluster"
    with pytest.raises(ValueError):
        clustering.cluster_column(df.select("i", "cluster_id"))
    assert [(r["cluster"], r["size"], r["examples"]) for r in clustering.by_cluster(df, "cluster", "i", "q", "p", 1, noise=False).collect()] == [(0, 2, ["b"])]


def test_formats_and_answers(spark):
    df = spark.createDataFrame([(0.0004, 1.234), (0.05, float("inf")), (0.5, None)], "p double, o double")
    assert [(r["a"], r["b"]) for r in df.select(T.shown_p(F.col("p")).alias("a"), T.shown_odds(F.col("o")).alias("b")).collect()] == [("< 0.001", "1.23"), ("0.050", "inf"), ("0.500", "undefined")]
    assert value(spark, lambda t: T.parsed_items(t, 2), '["a", " b"]', '["a", "a"]', '["a"]', "no", None, '["a", ""]') == [["a", "b"], None, None, None, None, None]


def test_kept_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    mark = incremental.fingerprint(df, "i", "t")
    assert mark == incremental.fingerprint(df.repartition(3), "i", "t") != incremental.fingerprint(df.limit(1), "i", "t")
    calls = []
    compute = lambda d: calls.append(1) or d.select("i")
    for _ in range(2):
        assert incremental.cached(df, str(tmp_path), mark, compute).count() == 2
    assert len(calls) == 1
    assert [r["i"] for r in sampling.shuffled(df, "i", 3).collect()] == [r["i"] for r in sampling.shuffled(df.repartition(2), "i", 3).collect()]
    assert validation.wrong_sizes(df.union(df.limit(1)), "i", 2).count() == 1


def test_pipeline(spark):
    rows = pd.DataFrame([(i, "plain words here" if i % 2 else "fancy words there", i % 2) for i in range(60)], columns=["i", "q", "y"])
    made = Loaded(spark.createDataFrame(rows), "i", "q", "y").annotated().counted([10], 1, 1).classified()
    assert made.measures.first()["balanced_accuracy"] == 1.0
    assert made.importance()[0][0] in {"plain_10", "fancy_10", "here_10", "there_10"}
