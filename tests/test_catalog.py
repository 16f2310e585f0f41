"""Every query of the catalogue against its SQL, on the smallest of the given tables."""

import decimal
import math
import os
from collections import Counter

import pytest

from textloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    cursor = duck.execute(catalog.SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == names
    want = Counter(tuple(plain(r[theirs.index(n)]) for n in names) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


def unique(*names):
    return lambda rows: len({tuple(r[n] for n in names) for r in rows}) == len(rows) > 0


def within(low, high, *names):
    return lambda rows: len(rows) > 0 and all(low <= r[n] <= high for r in rows for n in names if r[n] is not None)


def finite(rows):
    return len(rows) > 0 and all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))


#: What has to hold for the rows of a query that SQL can't say.
PROPERTIES = {
    "graph_eigenmap": finite,
    "graph_spectral": finite,
    "graph_swiss_roll": lambda rows: len(rows) == 4000 and finite(rows),
    "manifold_components": lambda rows: unique("vec_id")(rows) and abs(sum(r["x1"] for r in rows)) < 1e-6 * len(rows) and sum(r["x1"] ** 2 for r in rows) >= sum(r["x2"] ** 2 for r in rows),
    "manifold_mds": lambda rows: unique("vec_id")(rows) and abs(sum(r["x"] for r in rows)) < 1e-6 * len(rows) and sum(r["x"] ** 2 for r in rows) >= sum(r["y"] ** 2 for r in rows),
    "manifold_layout": lambda rows: unique("vec_id")(rows) and finite(rows),
    "cluster_hierarchical": lambda rows: unique("vec_id")(rows) and len({r["cluster"] for r in rows}) == min(10, len(rows)),
    "cluster_chosen": lambda rows: unique("clusters")(rows) and within(-1, 1, "silhouette")(rows),
    "cluster_density": lambda rows: unique("vec_id")(rows) and within(0, 1, "probability")(rows),
    "cluster_words": lambda rows: unique("name")(rows) and all(len(r["words"]) == r["grouped"] for r in rows),
    "inc_hashed_embedding": lambda rows: unique("row_id")(rows) and all(len(r["embedding"]) == 64 for r in rows),
    "ml_cross_validated": lambda rows: sorted(r["fold"] for r in rows) == list(range(10)) and within(0, 1, "balanced_accuracy", "precision", "recall", "f1")(rows),
    "ml_explained": lambda rows: unique("feature")(rows) and all(r["importance"] >= 0 and r["direction"] in (-1, 0, 1) for r in rows),
    "ml_holdout_boosted": within(0, 1, "balanced_accuracy"),
    "ml_logistic": lambda rows: unique("feature")(rows) and all(r["low"] <= r["coefficient"] <= r["high"] and abs(math.log(r["odds_ratio"]) - r["coefficient"]) < 1e-6 for r in rows),
    "ml_out_of_fold": lambda rows: unique("row_id")(rows) and {r["fold"] for r in rows} == set(range(5)) and all(r["predicted"] == int(r["score"] > 0) or r["score"] == 0 for r in rows),
    "stat_tested": within(0, 1, "p", "adjusted"),
    "style_measures": lambda rows: unique("doc_id")(rows) and within(0, 1, "ttr")(rows) and all(r["sentences"] >= 1 for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_properties(spark, name):
    assert PROPERTIES[name](catalog.QUERIES[name](spark, FOLDER).collect())
