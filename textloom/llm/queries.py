"""The queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import abuse, bpe, clusters, copies, frequency, leaks, neardup, neighbours, splits, vectors
from textloom.plans.materialize import Workspace


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _corpus_units(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.unit_vectors(_read(spark, folder, "corpus_embedding"), "vec_id", "embedding", F.col("embedding_model"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.most_similar(_corpus_units(spark, folder), 5, 0.9)
    return near.select(F.least("id", "nbr").alias("vec_a"), F.greatest("id", "nbr").alias("vec_b")).distinct()


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.most_similar(_corpus_units(spark, folder), 5, asked=F.col("id") % 20 == 0)
    return near.select(F.col("id").alias("vec_id"), F.col("nbr").alias("neighbour_id"), "rank", "cosine_similarity")


def _recall(near: DataFrame, units: DataFrame, asked: Column, least: float = -2.0) -> DataFrame:
    """``queries, wanted, recall`` of found neighbours against brute force, over the rows ``asked`` for."""
    near = Workspace(units.sparkSession, "recall").cut(near)
    bounds = near.groupBy("id").agg(F.min("cosine_similarity").alias("least"), F.count("*").alias("n")).where("n >= 5")
    exact = neighbours.exact_similar(units, 5, asked, bounds=bounds).where(F.col("cosine_similarity") >= least)
    worst = exact.groupBy("id").agg(F.min("cosine_similarity").alias("worst"), F.count("*").alias("wanted"))
    got = near.join(worst, "id").where(F.col("cosine_similarity") >= F.col("worst") - 1e-6).groupBy("id").agg(F.count("*").alias("got"))
    both = worst.join(got, "id", "left")
    return both.agg(F.count("*").alias("queries"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"), (F.sum(F.least(F.coalesce("got", F.lit(0)), "wanted")) / F.sum("wanted")).alias("recall"))


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the index against brute force, over the rows whose id is divisible by 20."""
    units, asked = _corpus_units(spark, folder), F.col("id") % 20 == 0
    return _recall(neighbours.most_similar(units, 5, asked=asked), units, asked)


def p1_recall_found(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of ``p1_found``'s search against brute force: neighbours at 0.9 of the rows whose id is divisible by 20."""
    units, asked = _corpus_units(spark, folder), F.col("id") % 20 == 0
    return _recall(neighbours.most_similar(units, 5, 0.9).where(asked), units, asked, 0.9)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clusters(vectors.unit_vectors(_read(spark, folder, "embedded_query"), "row_id", "embedding").select("id", "unit"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).select(F.col("id").alias("row_id"), "cluster_id")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    texts = _read(spark, folder, "embedded_query").select(F.col("row_id").alias("id"), F.col("query").alias("text"))
    return clusters.describe(_clusters(spark, folder), texts)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.tied_groups(_read(spark, folder, "query_record"), "row_id", ["paragraph_id", "source"])


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "query_record")
    groups = splits.tied_groups(rows, "row_id", ["paragraph_id", "source"])
    kind = F.when(F.instr("id", "-") > 1, F.substring_index("id", "-", 1)).otherwise("other")
    return groups.join(rows.select("row_id", kind.alias("genre")), "row_id")


_SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(_labelled(spark, folder), "row_id", F.col("genre"), _SHARES)


def p3_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """What share of each genre, and of all rows, every split got."""
    labelled = Workspace(spark, "labelled").cut(_labelled(spark, folder))
    dealt = splits.assign_splits(labelled, "row_id", F.col("genre"), _SHARES)
    return splits.deviation(dealt.join(labelled.select("row_id", "genre"), "row_id"), "split", F.col("genre"), _SHARES)


def _prints(spark: SparkSession, folder: str) -> DataFrame:
    parts = [("corpus_record", "text"), ("query_record", "query")]
    a, b = (neardup.fingerprints(_read(spark, folder, t), t, "row_id", c) for t, c in parts)
    return a.unionByName(b)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_prints(spark, folder), 0.7)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(_prints(spark, folder), 0.7)


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    texts = copies.keyed_texts(_read(spark, folder, "query_record"), "query_record", "row_id", "query")
    texts = texts.unionByName(copies.keyed_texts(_read(spark, folder, "corpus_record"), "corpus_record", "row_id", "text"))
    return texts.unionByName(copies.keyed_objects(_read(spark, folder, "raw_record"), "raw_record", "rec_id", "line"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(_keyed(spark, folder))


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_sets(_keyed(spark, folder)).select("tbl", "keep_id", "copies")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.marked_terms(_read(spark, folder, "query_record"), "query").where("mark is not null").select("term", "mark")


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.marked_terms(_read(spark, folder, "query_record"), "query").select("term", "occurrences", "records", "mark")


def p6_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    counts = frequency.marked_terms(_read(spark, folder, "query_record"), "query", max_n=2)
    return counts.where("mark is null or mark = 'common'").select("term", F.col("n").cast("int").alias("n"), "occurrences", "records", "mark")


def p6_all(spark: SparkSession, folder: str) -> DataFrame:
    """N-grams of every length with their mark, rare ones too; a row stands for the first ``shortest`` to ``longest`` words of ``term``."""
    return frequency.marked_classes(_read(spark, folder, "query_record"), "query")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_corpus(_read(spark, folder, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(_read(spark, folder, "documents"), "doc_id", "text", _read(spark, folder, "heldout_item"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents").select("doc_id", "source")
    return documents.join(_leaks(spark, folder).select("doc_id").distinct(), "doc_id", "left_anti")


def _abuse(spark: SparkSession, folder: str) -> DataFrame:
    documents = _read(spark, folder, "documents")
    model = abuse.learn(abuse.labelled_texts(documents, "doc_id", "text", _read(spark, folder, "doc_label"), "toxic"))
    return abuse.scored(documents, "doc_id", "text", model)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _abuse(spark, folder).where("toxic").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _abuse(spark, folder).join(_read(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("toxic").alias("toxic"), F.avg(F.col("toxic").cast("int")).alias("rate"))


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of a model learned from one half of the labelled documents on the other half."""
    documents, labels = _read(spark, folder, "documents"), _read(spark, folder, "doc_label")
    half = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(2)) == 0
    model = abuse.learn(abuse.labelled_texts(documents, "doc_id", "text", labels, "toxic", within=half))
    held = abuse.labelled_rows(documents, "doc_id", "text", labels, "toxic").where(~half)
    scored = abuse.scored(held.select("key", "text"), "key", "text", model).join(held.select("key", "y"), "key")
    both = F.count_if(F.col("toxic") & (F.col("y") == 1))
    return scored.agg(F.count("*").alias("documents"), F.sum("y").alias("labelled"), F.count_if("toxic").alias("found"), (both / F.count_if("toxic")).alias("precision"), (both / F.sum("y")).alias("recall"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


_TERMS = """
WITH q AS (SELECT row_id, query FROM query_record),
w AS (SELECT row_id, unnest(list_transform(regexp_extract_all(query, '[\\p{L}\\p{N}]+'), lambda x: lower(x))) AS term FROM q WHERE query IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM w GROUP BY term),
m AS (SELECT *, CASE WHEN records > 0.1 * (SELECT count(*) FROM q) THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM c)
"""
_NGRAMS = """
WITH q AS (SELECT row_id, list_transform(regexp_extract_all(query, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS tok FROM query_record WHERE query IS NOT NULL),
w AS (SELECT row_id, 1 AS n, unnest(tok) AS term FROM q UNION ALL SELECT row_id, 2, unnest(CASE WHEN len(tok) >= 2 THEN list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) ELSE [] END) FROM q),
c AS (SELECT term, n, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM w GROUP BY term, n)
SELECT term, CAST(n AS INT) AS n, occurrences, records, CASE WHEN records > 0.1 * (SELECT count(*) FROM query_record) THEN 'common' END AS mark FROM c WHERE records > 2
"""
_PAIRS = """
WITH e AS (SELECT vec_id, embedding_model AS m, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM corpus_embedding
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM e a JOIN e b ON a.m = b.m AND a.vec_id <> b.vec_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE place <= 5
"""
_LEAKS = """
WITH i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS tok FROM heldout_item WHERE text IS NOT NULL),
d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS tok FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(tok) - least(12, len(tok)) + 2), lambda k: array_to_string(tok[k:k + least(12, len(tok)) - 1], ' '))) AS g FROM i WHERE len(tok) > 0),
l AS (SELECT DISTINCT least(12, len(tok)) AS n FROM i WHERE len(tok) > 0),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(tok) - n + 2), lambda k: array_to_string(tok[k:k + n - 1], ' '))) AS g FROM d, l WHERE len(tok) >= n)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS,
        "p8_found": _LEAKS,
        "p6_ngrams": _NGRAMS,
        "p6_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p6_terms": _TERMS + "SELECT term, occurrences, records, mark FROM m",
    }
