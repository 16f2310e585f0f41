import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import incremental, providers, validation
from textloom.sources import files
from textloom.streaming import incremental as streaming


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


SCHEMA = "id string, query string"


def test_line_files(spark, tmp_path):
    good = put(tmp_path / "a_hard.jsonl", '{"id": "1", "query": "x"}\n\n  \n{"id": "2"}\n')
    assert [(r["id"], r["query"], r["source"]) for r in files.read_lines(spark, good, SCHEMA).orderBy("id").collect()] == [("1", "x", "a_hard"), ("2", None, "a_hard")]
    bad = put(tmp_path / "b.jsonl", '{"id": "1"}\n[1]\n{"id": \n')
    with pytest.raises(ValueError, match="b.jsonl"):
        files.read_lines(spark, bad, SCHEMA)
    assert files.read_lines(spark, bad, SCHEMA, strict=False).count() == 1
    assert files.broken_lines(spark, bad, SCHEMA).first()["n"] == 2
    with pytest.raises(ValueError, match="no objects"):
        files.read_lines(spark, put(tmp_path / "c.jsonl", "\n"), SCHEMA, empty=False)


def test_arrays_and_sniffing(spark, tmp_path):
    array = put(tmp_path / "a.json", ' [\n{"id": "1", "query": "x"}, {"id": "2", "query": ""}]')
    assert files.read_any(spark, array, SCHEMA).count() == 2
    assert [r["id"] for r in files.read_any(spark, array, SCHEMA, "query").collect()] == ["1"]
    assert files.read_any(spark, put(tmp_path / "l.jsonl", '{"id": "1", "query": "x"}\n'), SCHEMA).count() == 1
    report = put(tmp_path / "r.json", json.dumps([{"clusters": [{"cluster_id": 3, "size": 1, "queries": [{"id": "q", "query": "t", "rank": 1, "probability": 0.5}]}]}]))
    assert files.read_report(spark, report).first()["cluster_id"] == 3
    with pytest.raises(ValueError):
        files.read_report(spark, put(tmp_path / "n.json", "[{}]"))


def test_templates_and_sinks(spark, tmp_path):
    assert "{{N}}" in files.read_template(put(tmp_path / "p.md", "{{TEXT}} {{N}}"), ("TEXT", "N"))
    with pytest.raises(ValueError, match="TEXT"):
        files.read_template(put(tmp_path / "q.md", "{{N}}"), ("TEXT", "N"))
    df = spark.createDataFrame([("1", "é"), ("2", None)], SCHEMA)
    out = str(tmp_path / "out")
    files.append_lines(df, out)
    files.append_lines(df, out)
    assert files.read_lines(spark, out, SCHEMA).count() == 4
    table = str(tmp_path / "table")
    files.replace_table(df, table)
    with pytest.raises(ValueError):
        files.replace_table(spark.read.parquet(table), table)
    files.replace_table(df.limit(1), table)
    assert spark.read.parquet(table).count() == 1


def test_nested_report(spark):
    r = files.retrieval_report(spark.createDataFrame([("a", 1), ("a", 61), ("b", 2), ("b", None)], "source string, rank int"), "source", "rank").first()
    assert r["failures"]["count"] == 1 and [x["source"] for x in r["by_source"]] == ["a", "b"] and r["overall"]["queries"] == 3


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, " ", None), (2, None, [float("nan"), 1.0])], "i int, t string, v array<double>")
    assert validation.blank(df, "i", "t").count() == 2
    assert validation.repeated(df, "i").first()["n"] == 2
    assert {r["reason"] for r in validation.bad_vectors(df, "i", "v", 2).collect()} == {"null", "not finite"}
    with pytest.raises(validation.Violation, match="twice"):
        validation.demand(validation.repeated(df, "i"), "twice")
    validation.demand(df.limit(0), "nothing")
    assert validation.orphans(df, "t", df.where("i = 2"), "t").count() == 1


def test_reuse_and_pending(spark):
    corpus = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "id string, text string")
    kept = spark.createDataFrame([("a", "x"), ("b", "old"), ("gone", "z")], "id string, t string").select("id", F.sha2("t", 256).alias("digest"))
    assert [r["id"] for r in incremental.reusable(corpus, kept, "id", "text", "digest").collect()] == ["a"]
    assert [r["id"] for r in incremental.pending(corpus, kept, "id", "text", "digest").collect()] == ["b"]
    seen = []

    def compute(rows):
        seen.extend(r["id"] for r in rows.collect())
        return rows.select("id", F.sha2("text", 256).alias("digest"))

    assert sorted(r["id"] for r in incremental.materialise(corpus, kept, "id", "text", "digest", compute).collect()) == ["a", "b"]
    assert seen == ["b"]
    assert incremental.materialise(corpus, kept, "id", "text", "digest", compute, force=True).count() == 2


def test_prepared_rows(spark):
    rows = [("a", "Same  text", "EN"), ("b", "same text ", "english"), ("c", "autre", "fr"), ("d", "x", None), ("e", "other", "eng")]
    assert sorted(r["id"] for r in incremental.prepared(spark.createDataFrame(rows, "id string, q string, lang string"), "id", "q", "lang").collect()) == ["a", "e"]


def test_rows_that_the_corpus_has_twice_are_reused_once(spark):
    corpus = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "b", "y")], "row_id int, id string, text string")
    kept = spark.createDataFrame([("a", "x")], "id string, t string").select("id", F.sha2("t", 256).alias("digest"))
    assert incremental.reusable(corpus, kept, "id", "text", "digest").count() == 1
    made = incremental.materialise(corpus, kept, "id", "text", "digest", lambda rows: rows.select("id", F.sha2("text", 256).alias("digest")))
    assert sorted(r["id"] for r in made.collect()) == ["a", "b", "b"]


def test_eligible_paragraphs_and_running_totals(spark):
    long = "w " * 20
    rows = spark.createDataFrame([("a", long), ("b", long), ("c", "short"), (None, long), ("d", None)], "id string, text string")
    assert [r["id"] for r in incremental.eligible(rows, "id", "text", spark.createDataFrame([("b",), (None,)], "p string"), "p").collect()] == ["a"]
    df = spark.createDataFrame([(1, 4), (1, None), (2, 6), (5, 2)], "b int, v int")
    got = [tuple(r) for r in incremental.running_totals(df, "b", "v").orderBy("b").select("b", "n", "total", "n_so_far", "total_so_far", "mean_so_far").collect()]
    assert got == [(1, 2, 4, 2, 4, 2.0), (2, 1, 6, 3, 10, 3.333333), (5, 1, 2, 4, 12, 3.0)]


def test_representatives_and_outliers(spark):
    rows = spark.createDataFrame([(i, 0.1 * i, 6 if i == 9 else 3) for i in range(10)], "i int, p double, w int")
    assert [r["i"] for r in incremental.chosen_representatives(rows, "i", "p", "w", 0.2, 5).collect()] == [8]
    same = spark.createDataFrame([(i, 0.5 if i > 2 else 0.9, 1) for i in range(10)], "i int, p double, w int")
    assert sorted(r["i"] for r in incremental.chosen_representatives(same, "i", "p", "w", 0.5, 5).collect()) == [0, 1, 2, 3, 4]
    assert incremental.chosen_representatives(same, "i", "p", "w", 0.05, 5).count() == 0
    topics = spark.createDataFrame([(0, -1, 0, 0), (1, -1, -1, 1), (2, 0, 0, 0), (3, 1, 1, 1)], "i int, t int, p int, e int")
    got = [(r["final"], r["method"]) for r in incremental.reduced_outliers(topics, "t", "p", "e").orderBy("i").collect()]
    assert got == [(0, "hdbscan_probability"), (1, "embedding_similarity"), (0, "original_cluster"), (1, "original_cluster")]


def test_batches_and_answers(spark):
    rows = incremental.batches(spark.createDataFrame([(i, f"q{i}") for i in range(30)], "i int, query string"), "i", 10).cache()
    requests = incremental.as_requests(rows, "query").collect()
    assert sum(len(json.loads(r["request"])) for r in requests) == 30
    answers = rows.select("batch", "index", F.lit(1).alias("v"))
    assert incremental.aligned(rows, answers, "v").where("problem is not null").count() == 0
    broken = answers.where("not (batch = 0 and index = 0)").union(spark.createDataFrame([(99, 0, 1)], "batch int, index int, v int"))
    assert {r["problem"] for r in incremental.aligned(rows, broken, "v").where("problem is not null").collect()} == {"missing", "not asked"}


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    got = {r["i"]: r["e"] for r in providers.called(df, "i", "t", providers.retried(providers.HashedWords(8)), "e", "array<double>").collect()}
    assert got[2] is None and len(got[1]) == 8 and got[3] == [0.0] * 8
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError
        return [0] * len(texts)

    assert providers.retried(flaky, wait=0.0)(["x"]) == [0]
    with pytest.raises(ValueError):
        providers.retried(lambda t: [], tries=2, wait=0.0)(["x"])
    assert providers.Rule(lambda t: "x" in t)(["x", "y"]) == [1, 0] and providers.Echo(1)(["a b"]) == ["a"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string").write.parquet(source)
    run = lambda: streaming.upserted(spark.readStream.schema("i int, t string").parquet(source), str(tmp_path / "out"), str(tmp_path / "check"), "i", lambda d: d.withColumn("n", F.length("t"))).awaitTermination()
    run()
    spark.createDataFrame([(2, "bbb")], "i int, t string").write.mode("append").parquet(source)
    run()
    assert {(r["i"], r["n"]) for r in streaming.latest(spark, str(tmp_path / "out"), "i").collect()} == {(1, 1), (2, 3)}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:00:00", "x", 4.0)], "ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert [(r["n"], r["total"]) for r in streaming.windowed(events, "ts", "k", "v").orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]
