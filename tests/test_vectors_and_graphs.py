import numpy as np
import pandas as pd
import pytest

from textloom.operators import clustering, graph, manifold, ranking


def packed(spark, x, key="id"):
    return spark.createDataFrame([(i, bytearray(np.asarray(v, float).tobytes())) for i, v in enumerate(x)], f"{key} bigint, vec binary")


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
def test_nearest_to_equals_brute_force(spark, metric):
    x = np.random.RandomState(0).randint(0, 3, (40, 4)).astype(float)
    d = np.round(clustering.distance_matrix(x, metric), 9)
    rows = packed(spark, x)
    got = {(r["src"], r["place"]): r["dst"] for r in ranking.nearest_to(rows.where("id % 5 = 0"), rows, 4, 3, metric).collect()}
    want = {(i, k + 1): j for i in range(0, 40, 5) for k, j in enumerate(sorted((j for j in range(40) if j != i), key=lambda j: (d[i, j], j))[:3])}
    assert got == want


def test_rank_expected_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 3)
    x = np.random.RandomState(1).randint(-1, 2, (30, 5)).astype(float)
    x[(x == 0).all(1)] = 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(f"d{i}", 100 - i, bytearray(v.tobytes())) for i, v in enumerate(x)], "doc_id string, pos int, unit binary")
    queries = spark.createDataFrame([(i, f"d{(i * 7) % 31}", bytearray(x[i].tobytes())) for i in range(12)], "query_id int, target string, unit binary")
    got = {r["query_id"]: r["rank"] for r in ranking.rank_expected(queries, corpus, 5).collect()}
    s = np.round(x @ x.T, 9)
    want = {}
    for i in range(12):
        t = (i * 7) % 31
        if t < 30:
            want[i] = 1 + sum(s[i, j] > s[i, t] or (s[i, j] == s[i, t] and 100 - j < 100 - t) for j in range(30))
    assert got == want
    assert ranking.rank_expected(queries.limit(0), corpus, 5).count() == 0


def test_small_graph(spark):
    edges = [(0, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (3, 6), (4, 5), (5, 6)]
    sym = graph.symmetric(spark.createDataFrame([*edges, (2, 2), (1, 0)], "src int, dst int"))
    assert [r["degree"] for r in graph.degrees(sym).orderBy("node").collect()] == [1, 3, 3, 4, 2, 3, 2]
    lap = np.zeros((7, 7))
    for r in graph.laplacian(sym).collect():
        lap[r["i"], r["j"]] += r["value"]
    assert (lap.sum(0) == 0).all() and (lap == lap.T).all()
    y = graph.eigenmap(sym, 2)
    v = y["x1"].to_numpy()
    value = v @ lap @ v / (v @ v)
    assert np.allclose(lap @ v, value * v) and value > 1e-9
    with pytest.raises(ValueError):
        graph.guarded(sym, 3)


def test_scaling_keeps_distances():
    x = np.random.RandomState(2).randn(20, 2)
    y = graph.classical_mds(x)
    assert np.allclose(clustering.distance_matrix(x), clustering.distance_matrix(y))


def test_components(spark):
    x = np.random.RandomState(3).randn(50, 3) * [5, 1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "i int, v array<double>")
    got = manifold.principal_components(df, "i", "v", 3).orderBy("i").toPandas()
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert len(got) == 50 and np.allclose(np.abs(got["x1"]), np.abs(c @ vt[0])) and np.allclose(np.abs(got["x2"]), np.abs(c @ vt[1]))


def test_layout_keeps_blobs_apart():
    x = np.vstack([np.random.RandomState(i).randn(25, 8) * 0.1 + np.eye(8)[i] * 5 for i in range(2)])
    y = manifold.neighbour_layout(x, neighbours=8)
    a, b = y[:25], y[25:]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > max(a.std(), b.std())
    assert (manifold.neighbour_layout(x) == manifold.neighbour_layout(x)).all()


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_linkage_equals_greedy_merging(method):
    x = np.random.RandomState(4).randn(12, 3)
    d = clustering.distance_matrix(x)
    groups = [[i] for i in range(12)]

    def gap(a, b):
        p = d[np.ix_(a, b)]
        if method == "ward":
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return {"single": p.min(), "complete": p.max(), "average": p.mean()}[method]

    heights = []
    while len(groups) > 1:
        h, i, j = min((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] += groups.pop(j)
    merges = clustering.linkage(d, method)
    assert np.allclose(merges[:, 2], heights) and merges[-1, 3] == 12
    assert len(set(clustering.cut(merges, 12, 4))) == 4


def test_canonical_labels(spark):
    assert clustering.canonical(np.array([5, 7, 7, -1, 9, 5, 7])).tolist() == [1, 0, 0, -1, 2, 1, 0]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([5, 7, 7, 9, 5, 7])], "i int, c int")
    assert [r["cluster"] for r in clustering.relabelled(df, "c", "i").orderBy("i").collect()] == [1, 0, 0, 2, 1, 0]


def test_silhouettes(spark):
    x = np.random.RandomState(5).randn(30, 3)
    labels = np.array([0] * 14 + [1] * 15 + [2])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "i int, v array<double>, c int")
    got = clustering.silhouettes(df, "i", "v", "c", 3, block=7).toPandas()
    assert len(got) == 30 and abs(got["width"].mean() - clustering.mean_silhouette(clustering.distance_matrix(x), labels)) < 1e-5
    assert np.isnan(clustering.mean_silhouette(np.zeros((3, 3)), np.zeros(3)))


def test_density_clusters():
    random = np.random.RandomState(6)
    x = np.vstack([random.randn(40, 2) * 0.2, random.randn(40, 2) * 0.2 + 5, random.uniform(-20, 20, (8, 2)) + 40])
    got = clustering.density_clusters(clustering.distance_matrix(x), 10)
    assert set(got["label"][:40]) <= {0, 1, -1} and got["label"][:40].mode()[0] != got["label"][40:80].mode()[0]
    assert (got["label"][:80] >= 0).mean() > 0.8 and got["probability"].between(0, 1).all() and (got["outlier_score"] >= 0).all()
    assert (clustering.density_clusters(clustering.distance_matrix(x), 10, most=5)["label"] == -1).all()
    assert len(clustering.density_clusters(np.zeros((1, 1)))) == 1


def test_agreement_and_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (None, "a")], "x int, y string")
    assert clustering.agreement(df, "x", "y").first().asDict() == {"ari": 1.0, "nmi": 1.0, "homogeneity": 1.0, "completeness": 1.0, "v_measure": 1.0}
    rows = spark.createDataFrame(pd.DataFrame({"c": [0, 0, 1], "k": [1, 2, 3], "d": [0.5, 0.1, 0.2], "r": [4, 8, 2]}))
    assert [r["k"] for r in clustering.representatives(rows, "c", "k", "d", 1).orderBy("c").collect()] == [2, 3]
    assert clustering.report(rows, "c", "k", "d", "r").orderBy("c").first()["mean_rank"] == 6.0
