import pytest
from pyspark.sql import functions as F

from textloom.operators import clustering, providers
from textloom.sources import indexes


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<double>, embedding_model string")


def test_an_index_of_several_files(spark):
    a, b = vectors(spark, [("x", [3.0, 4.0], "m"), ("y", [1.0, 0.0], None)]), vectors(spark, [("z", [0.0, 2.0], "m")])
    got = {r["id"]: (r["unit"], r["source"]) for r in indexes.embedding_index({"a": a, "b": b}).collect()}
    assert got == {"x": ([0.6, 0.8], "a"), "y": ([1.0, 0.0], "a"), "z": ([0.0, 1.0], "b")}
    for bad in ([("x", [1.0, 0.0], "m")], [("q", [1.0], "m")], [("q", [0.0, 0.0], "m")], [("q", None, "m")], [("q", [float("nan"), 1.0], "m")], [(" ", [1.0, 0.0], "m")], [(None, [1.0, 0.0], "m")], [("q", [1.0, 0.0], "other")]):
        with pytest.raises(ValueError):
            indexes.embedding_index({"a": a, "b": vectors(spark, bad)})
    for none in ({}, {"a": a.limit(0)}):
        with pytest.raises(ValueError):
            indexes.embedding_index(none)


def test_queries_of_several_files(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, paragraph_id string, query string, source string")
    a, b = make([("x_hard1", "p", "q", "old"), ("y", "p", "q", "old")]), make([("z_hard1", "p", "q", None)])
    assert indexes.query_records({"a": a, "b": b}).count() == 3
    hard = indexes.query_records({"a": a, "b": b}, hard_only=True)
    kept, skipped = indexes.kept_and_skipped(hard, vectors(spark, [("x_hard1", [1.0], "m")]))
    assert [r["id"] for r in kept.collect()] == ["x_hard1"] and [tuple(r) for r in skipped.collect()] == [("b", 1)]
    for bad in ([("x_hard1", "p", "q", None)], [("n", " ", "q", None)], [("n", "p", None, None)], [("", "p", "q", None)]):
        with pytest.raises(ValueError):
            indexes.query_records({"a": a, "b": make(bad)})
    # a blank field of a query that isn't asked for doesn't matter
    assert indexes.query_records({"a": a, "b": make([("n", None, None, None)])}, hard_only=True).count() == 1


def test_of_five_queries_the_fourth_is_kept(spark):
    df = spark.createDataFrame([(1, '["a", "b", "c", "d", "e"]'), (2, '["a", "b"]'), (3, None), (4, "no json"), (5, '["only"]')], "i int, a string")
    assert {r["i"]: r["query"] for r in providers.chosen_query(df, "i", "a", "ordered").collect()} == {1: "d", 2: None, 3: None, 4: None, 5: None}
    assert {r["i"]: r["query"] for r in providers.chosen_query(df, "i", "a").collect()} == {1: None, 2: None, 3: None, 4: None, 5: "only"}


def test_rejected_queries_are_written_again_with_the_reason(spark):
    def write(prompts):
        return [None if "nothing" in p else "never" if "stubborn" in p else "good" if "Because: bad" in p else "bad" for p in prompts]

    def problem(rows):
        return rows.select("i", F.when(F.col("query") != "good", F.concat(F.col("query"), F.lit("!"))).alias("problem"))

    df = spark.createDataFrame([(1, "some text"), (2, "nothing here"), (3, "stubborn text"), (4, None)], "i int, t string")
    got = {r["i"]: (r["query"], r["tries"], r["problem"]) for r in providers.generated(df, "i", "t", write, problem, "Write one.").collect()}
    assert got == {1: ("good", 2, None), 2: (None, 1, None), 3: (None, 3, "never!")}
    assert providers.generated(df.limit(0), "i", "t", write, problem, "p").count() == 0


def test_noise_report_and_membership(spark):
    df = spark.createDataFrame([(-1, 0.0, 1.0), (0, 0.5, 0.2), (0, 1.0, 0.0), (3, 0.6, 0.1), (None, None, None)], "c int, p double, o double")
    assert clustering.noise_report(df, "c", "p").first().asDict() == {"rows": 4, "clusters": 2, "noise": 1, "mean_probability": 0.7, "noise_percent": 25.0}
    own = [r["membership"] for r in clustering.enriched(df, "c", "p", "o").collect()]
    assert own[0].asDict() == {"cluster_id": -1, "is_noise": True, "probability": 0.0, "outlier_score": 1.0} and not own[1]["is_noise"]
