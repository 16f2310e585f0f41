import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_term_is_in_one_cluster(spark):
    rows = spark.read.parquet(f"{FOLDER}/query_record.parquet")
    terms = {r["t"] for r in rows.select(F.explode(T.clause_terms(F.col("query"))).alias("t")).distinct().collect()}
    assert len(terms) > 200
    made = catalog.QUERIES["cluster_words"](spark, FOLDER).collect()
    words = [w for r in made for w in r["words"]]
    assert len(words) == len(terms) and set(words) == terms
    assert all(r["grouped"] == len(r["words"]) for r in made)
