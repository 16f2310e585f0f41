import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import stats


@pytest.mark.parametrize(("hard", "easy", "expected", "odds"), [(54, 7, 4.82, 97.42), (72, 9, 6.39, 103.89), (124, 17, 11.13, 103.13), (117, 18, 10.66, 90.79), (151, 8, 12.55, 280.22), (72, 1, 5.76, 935.89), (208, 77, None, 44.34)])
def test_published_odds(spark, hard, easy, expected, odds):
    rows = [(1, ["x"])] * hard + [(1, ["y"])] * (703 - hard) + [(0, ["x"])] * easy + [(0, ["y"])] * (8203 - easy) + [(None, ["x"])]
    r = stats.contrast(spark.createDataFrame(rows, "label int, tok array<string>"), "tok", "label").where("term = 'x'").first()
    assert r["odds_ratio"] == odds and (expected is None or round(r["expected_hard"], 2) == expected)


def test_odds_with_zeros(spark):
    rows = [(1, 0, 3, 4), (0, 0, 3, 4), (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").select(stats.odds_ratio(*map(F.col, "abcd")).alias("o"))
    assert [r["o"] for r in df.collect()] == [float("inf"), None, 0.67]


def test_nearest_rank_percentiles(spark):
    random.seed(1)
    for n in (1, 2, 5, 10, 101):
        v = sorted(random.randint(0, 30) for _ in range(n))
        got = {r["share"]: r["value"] for r in stats.nearest_rank(spark.createDataFrame([(x,) for x in [*v, None]], "v int"), "v", (25, 75, 90)).collect()}
        assert got == {p: v[min(n, max(1, round(p / 100 * n + 0.5))) - 1] for p in (25, 75, 90)}


def test_vocabulary_and_terms(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["a", "c"])], "i int, tok array<string>")
    assert stats.vocabulary(df, "tok").first().asDict() == {"tokens": 5, "types": 3, "once": 2, "ttr": 0.6, "once_share": 0.6667}
    assert {(r["term"], r["n"]) for r in stats.record_frequency(df, "tok").collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert stats.vocabulary(df.limit(0), "tok").first()["ttr"] == 0.0
    assert [r["term"] for r in stats.top(stats.occurrences(df, "tok"), 2).orderBy("place").collect()] == ["a", "b"]


def test_duplicates(spark):
    df = spark.createDataFrame([("A ",), ("a",), ("b",), (None,), (None,), ("a",)], "t string")
    assert stats.duplicate_texts(df, "t").first()["repeats"] == 2
    assert stats.duplicate_texts(df.limit(0), "t").first()["repeats"] == 0


def test_rank_measures(spark):
    df = spark.createDataFrame([(1, "a_m"), (2, "a_m"), (100, "b_prompt1"), (None, "b_m"), (61, None)], "rank bigint, id string")
    r = stats.rank_metrics(df, "rank").first()
    assert (r["queries"], r["median_rank"], r["recall_1"], r["recall_10"]) == (4, 31.5, 0.25, 0.5)
    f = {x["suffix"]: (x["total"], x["worse"], x["percent"]) for x in stats.failures_by_suffix(df, "id", "rank", ["_m", "_prompt1", "_none"]).collect()}
    assert f == {"_m": (2, 0, 0.0), "_prompt1": (1, 1, 100.0), "_none": (0, 0, 0.0)}


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (None, 1)], "y int, p int")
    r = stats.confusion(df, "y", "p").first()
    assert (r["tp"], r["fn"], r["tn"], r["fp"], r["balanced_accuracy"], r["precision"], r["f1"]) == (1, 1, 2, 0, 0.75, 1.0, round(2 / 3, 9))
    assert stats.confusion(df.limit(0), "y", "p").first()["f1"] == 0.0


def test_leak_reasons(spark):
    rows = [(1, "w " * 40, "x"), (2, "quartz engine", "quartz engine"), (3, "red green blue gray", "red green blue gray pink"), (4, "red", "red"), (5, None, None)]
    rare = spark.createDataFrame([("quartz",)], "term string")
    df = spark.createDataFrame(rows, "i int, q string, t string").withColumn("t", T.topic_words(F.col("t")))
    got = {r["i"]: r["reason"] for r in stats.leak_reasons(df, "q", "t", rare, "i").collect()}
    assert got == {1: "long", 2: "rare word", 3: "shared words", 4: None, 5: None}


def test_running_total(spark):
    for seed in range(3):
        r = random.Random(seed)
        keys = r.sample(range(1000), 150)
        df = spark.createDataFrame([(k, r.randint(-3, 9)) for k in keys], "k int, n int")
        rows = sorted((x["k"], x["n"]) for x in df.collect())
        for down in (False, True):
            want, total = {}, 0
            for k, n in sorted(rows, reverse=down):
                total += n
                want[k] = total
            assert {x["k"]: x["_total"] for x in stats.running_total(df, "k", "n", down, ranges=7).collect()} == want
    assert stats.running_total(df.limit(0), "k", "n").count() == 0
