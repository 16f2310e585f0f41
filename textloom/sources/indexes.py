"""Records of several files as one table, with the guards that a single table of them needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.operators.validation import demand, repeated


def _together(files: dict[str, DataFrame]) -> DataFrame:
    """The rows of all files with ``source``, the file's name; columns that a file lacks are null."""
    if not files:
        raise ValueError("no files")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(name)) for name, df in files.items()))


def embedding_index(files: dict[str, DataFrame], key: str = "id", vector: str = "embedding", model: str = "embedding_model") -> DataFrame:
    """One row per key with ``unit``, its vector in length one; fails on anything an index can't hold.

    That is: no rows, a blank or repeated key, a vector that is null, of another
    length than the others, all zero or not finite, or more than one model; a
    null model is none.
    """
    rows = _together(files)
    demand(rows.where(F.col(key).isNull() | (F.trim(key) == "")), "blank keys")
    demand(repeated(rows, key), "repeated keys")
    seen = rows.agg(F.max(F.size(vector)).alias("most"), F.count_distinct(model).alias("models"), F.count("*").alias("n")).first()
    if not seen["n"]:
        raise ValueError("no embeddings")
    if seen["models"] > 1:
        raise ValueError(f"{seen['models']} embedding models in one index")
    demand(rows.where(~A.usable(F.col(vector), seen["most"] or 0)).select(key, "source"), "vectors that can't be used")
    return rows.withColumn("unit", A.unit(F.col(vector)))


def query_records(files: dict[str, DataFrame], hard_only: bool = False, mark: str = "_hard") -> DataFrame:
    """``id, paragraph_id, query, source`` of all files, or those with ``mark`` in the id; fails on blank fields and repeated ids."""
    rows = _together(files).select("id", "paragraph_id", "query", "source")
    demand(rows.where(F.col("id").isNull() | (F.trim("id") == "")), "blank ids")
    if hard_only:
        rows = rows.where(F.col("id").contains(mark))
    blank = F.col("paragraph_id").isNull() | (F.trim("paragraph_id") == "") | F.col("query").isNull() | (F.trim("query") == "")
    demand(rows.where(blank).select("id", "source"), "blank fields")
    demand(repeated(rows, "id"), "repeated ids")
    return rows


def kept_and_skipped(queries: DataFrame, index: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The queries that an index has, and ``source, skipped``, how many of each source it hasn't."""
    have = index.select(key)
    return queries.join(have, key, "left_semi"), queries.join(have, key, "left_anti").groupBy("source").agg(F.count("*").alias("skipped"))
