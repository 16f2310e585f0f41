import time

import numpy as np
import pyarrow as pa
import pytest

from textloom.operators import ranking, stylometry
from textloom.plans.materialize import Workspace


def nearest(x, q, ids, k, batches=3):
    """What one task gives for rows ``x`` with ids 0, 1, ..."""
    made = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "vec"])
    size = -(-len(x) // batches)
    fine = x[np.isfinite(x).all(1)]
    out = ranking._closest_manhattan((made.slice(i, size) for i in range(0, len(x), size)), ids, q, fine.min(0), fine.max(0), k)
    return {(s, t): d for b in out for s, t, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}


def brute(x, q, ids, k):
    want = {}
    for i, v in zip(ids, q, strict=True):
        with np.errstate(invalid="ignore"):
            d = np.round(np.abs(x - v).mean(1), 9)
        near = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i and np.isfinite(d[j])][:k]
        want |= {(i, j): d[j] for j in near}
    return want


def sparse(n, dim=100, share=0.2, seed=0):
    r = np.random.RandomState(seed)
    x = r.exponential(1, (n, dim)) * (r.rand(n, dim) < share)
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize("kind", ["sparse", "whole", "tiny", "huge", "equal", "odd"])
def test_delta_measures_only_what_can_be_close(kind):
    r = np.random.RandomState(1)
    x = sparse(900)
    if kind == "whole":
        x = r.randint(-2, 3, (900, 6)).astype(float)  # many ties
    elif kind == "tiny":
        x = x * 1e-7  # distances that rounding makes equal
    elif kind == "huge":
        x[::50] *= 1e12
    elif kind == "equal":
        x[:] = x[0]
    elif kind == "odd":
        x[5, 3], x[6, 2], x[7, 1] = np.nan, np.inf, -np.inf
    ids = np.arange(0, 900, 2)
    assert nearest(x, x[ids], ids, 5) == brute(x, x[ids], ids, 5)
    few = x[8:11]
    assert nearest(few, x[8:40], np.arange(100, 132), 5, 1) == brute(few, x[8:40], np.arange(100, 132), 5)
    assert nearest(x, x[ids] * 3 - 1, ids + 1000, 5) == brute(x, x[ids] * 3 - 1, ids + 1000, 5)  # queries beyond the rows' span


def test_delta_isnt_a_loop_over_all_pairs(spark):
    """The one task of a call takes less than half of what measuring all pairs takes."""
    x = sparse(20_000)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id bigint, vec binary").coalesce(1).cache()
    queries = rows.where("id % 5 = 0")
    assert ranking.nearest_to(queries.where("id % 100 = 0"), rows, 100, 5, "manhattan").count() == 1000  # starts the workers
    began = time.time()
    for v in x[:64]:
        np.abs(x - v).mean(1)
    pairwise = (time.time() - began) * 4000 / 64
    began = time.time()
    assert ranking.nearest_to(queries, rows, 100, 5, "manhattan").count() == 20_000
    assert time.time() - began < pairwise / 2


def test_packed_profiles_equal_profiles(spark):
    texts = ["a b, c", "a a b d'e", "", None, "c, c, c", "Ä ä b", "d'e a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string")
    got, words = stylometry.packed_profiles(df, "row_id", "text", Workspace(spark, "test"), 4)
    want = {}
    for r in stylometry.profiles(df, "row_id", "text", 4).orderBy("row_id", "term").collect():
        want.setdefault(r["row_id"], []).append(r["z"])
    got = {r["id"]: np.frombuffer(r["vec"]) for r in got.collect()}
    assert words == 4 and got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-12) for i in got)


def test_profiles_without_deviation_have_no_nearest(spark):
    for texts in ([], [None, ""], ["a b"], ["a b", "b a", "a b"]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, text string")
        vectors, words = stylometry.packed_profiles(df, "row_id", "text", Workspace(spark, "test"))
        assert words == 0 and stylometry.delta_nearest(vectors, df.select("row_id"), 5, words).count() == 0
