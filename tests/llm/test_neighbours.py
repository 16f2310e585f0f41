import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import neighbours, queries, vectors


def table(spark, x, ids=None, models=None, extra=()):
    ids = range(1, len(x) + 1) if ids is None else ids
    rows = [(int(i), m, [float(v) for v in r], "u") for i, m, r in zip(ids, models or ["m"] * len(x), x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "vec_id bigint, embedding_model string, embedding array<double>, unit string")


def found(spark, df, **kw):
    units = vectors.unit_vectors(df, "vec_id", "embedding", F.col("embedding_model"))
    return {(r["id"], r["rank"]): (r["nbr"], round(r["cosine_similarity"], 5)) for r in neighbours.most_similar(units, **kw).collect()}


def brute(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 5)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        for r, b in enumerate(order):
            out[i, r + 1] = (ids[b], s[a, b])
    return out


def test_equals_brute_force_in_one_part(spark):
    x = np.random.RandomState(0).randn(120, 64)
    got = found(spark, table(spark, x), k=5)
    want = brute(x, list(range(1, 121)), 5)
    assert set(got) == set(want)
    assert all(abs(got[k][1] - want[k][1]) < 2e-5 for k in want)


def test_recall_over_several_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 100)
    random = np.random.RandomState(1)
    centres = random.randn(40, 64)
    x = centres[random.randint(0, 40, 1500)] + random.randn(1500, 64) * 0.6
    got, want = found(spark, table(spark, x), k=5), brute(x, list(range(1, 1501)), 5)
    worst = {i: want[i, 5][1] for i in range(1, 1501)}
    assert sum(c >= worst[i] - 2e-5 for (i, _), (_, c) in got.items()) / len(want) >= 0.9


def test_copies_rank_first_by_id_and_others_fill_up(spark):
    x = np.random.RandomState(2).randn(3, 64)
    rows = np.vstack([np.tile(x[0], (9, 1)), np.tile(x[1], (2, 1)), x[2:]])
    got = found(spark, table(spark, rows), k=5)
    assert [got[9, r][0] for r in range(1, 6)] == [1, 2, 3, 4, 5]
    assert [got[1, r][0] for r in range(1, 6)] == [2, 3, 4, 5, 6]
    assert got[10, 1] == (11, 1.0)
    assert len([k for k in got if k[0] == 12]) == 5


def test_unusable_vectors_neither_look_nor_are_found(spark):
    x = np.random.RandomState(3).randn(4, 64)
    bad = [(90, "m", None, None), (91, "m", [1.0] * 63, None), (92, "m", [0.0] * 64, None), (93, "m", [float("nan")] * 64, None), (94, "m", [float("inf")] + [0.0] * 63, None), (95, None, [1.0] * 64, None), (None, "m", [1.0] * 64, None)]
    got = found(spark, table(spark, x, models=["m", "m", "n", "n"], extra=bad), k=5)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert got[1, 1][0] == 2 and got[3, 1][0] == 4


def test_huge_components_and_empty_table(spark):
    x = np.array([[1e200] * 64, [1e-200] * 64])
    assert found(spark, table(spark, x), k=5)[1, 1] == (2, 1.0)
    assert found(spark, table(spark, np.zeros((0, 64))), k=5) == {}


def test_asked_rows_only(spark):
    x = np.random.RandomState(4).randn(60, 64)
    got = found(spark, table(spark, x), k=3, asked=F.col("id") % 20 == 0)
    assert {i for i, _ in got} == {20, 40, 60} and len(got) == 9


def test_exact_search_equals_brute_force(spark):
    x = np.random.RandomState(5).randn(50, 64)
    units = vectors.unit_vectors(table(spark, x), "vec_id", "embedding", F.col("embedding_model"))
    got = {(r["id"], r["rank"]): r["nbr"] for r in neighbours.exact_similar(units, 3, F.col("id") % 20 == 0, block=1).collect()}
    want = brute(x, list(range(1, 51)), 3)
    assert got == {k: v[0] for k, v in want.items() if k[0] % 20 == 0}


def test_parts_are_balanced():
    x = np.random.RandomState(6).randn(400, 64).astype(np.float32)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 5), 7)
    sizes = np.bincount(label, minlength=7)
    assert sizes.sum() == 400 and sizes.max() <= np.ceil(400 / 7 * 1.1)
    with pytest.raises(ValueError):
        neighbours.neighbour_graph(x[:2], 5)


def test_recall_of_the_index_for_near_pairs(spark, tmp_path):
    x = np.repeat(np.random.RandomState(7).randn(30, 64), 2, axis=0)
    x[1::2] += 0.1 * np.random.RandomState(8).randn(30, 64)
    table(spark, x).write.parquet(f"{tmp_path}/corpus_embedding.parquet")
    (r,) = queries.queries()["p1_recall_found"](spark, str(tmp_path)).collect()
    assert (r["queries"], r["wanted"], r["recall"]) == (3, 3, 1.0)


def test_large_parts_are_cut_again(spark, monkeypatch):
    for name, value in (("PART", 60), ("FAN", 4), ("SPLIT", 2)):
        monkeypatch.setattr(neighbours, name, value)
    random = np.random.RandomState(9)
    centres = random.randn(30, 64)
    x = centres[random.randint(0, 30, 1500)] + random.randn(1500, 64) * 0.6
    got, want = found(spark, table(spark, x), k=5), brute(x, list(range(1, 1501)), 5)
    worst = {i: want[i, 5][1] for i in range(1, 1501)}
    assert sum(c >= worst[i] - 2e-5 for (i, _), (_, c) in got.items()) / len(want) >= 0.9
    asked = found(spark, table(spark, x), k=5, asked=F.col("id") % 20 == 0)
    assert len(asked) == 75 * 5 and sum(c >= worst[i] - 2e-5 for (i, _), (_, c) in asked.items()) / 375 >= 0.9


def test_bounds_leave_the_exact_search_exact(spark):
    x = np.random.RandomState(10).randn(80, 64)
    units = vectors.unit_vectors(table(spark, x), "vec_id", "embedding", F.col("embedding_model"))
    asked = F.col("id") % 2 == 0
    near = neighbours.most_similar(units, 3, asked=asked)
    bounds = near.where("id % 4 = 0").groupBy("id").agg(F.min("cosine_similarity").alias("least"))
    rows = [{tuple(r) for r in neighbours.exact_similar(units, 3, asked, bounds=b).select("id", "rank", "nbr").collect()} for b in (None, bounds)]
    assert rows[0] == rows[1] and len(rows[0]) == 120
