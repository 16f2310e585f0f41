"""Style profiles over the most frequent words, and measures of punctuation, names and sentence length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.ranking import nearest_to
from textloom.plans.materialize import Workspace


def most_frequent(df: DataFrame, text: str, words: int = 100) -> DataFrame:
    """``term, n``: the ``words`` most frequent style tokens, ties by term."""
    counts = df.select(F.explode(T.style_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(words)


def profiles(df: DataFrame, key: str, text: str, words: int = 100) -> DataFrame:
    """``key, term, z``: standardised relative frequencies of the most frequent words, one row per row and word.

    Relative to all style tokens of the text; a text without any has frequency
    zero throughout. Deviations are sample deviations over all rows; words that
    don't vary are left out. Nothing is collected; the word table has ``words`` rows.
    """
    tokens = df.select(F.col(key).alias("key"), T.style_tokens(F.col(text)).alias("t"))
    chosen = F.broadcast(most_frequent(df, text, words).select("term"))
    total = tokens.select("key", F.size("t").alias("total"))
    found = tokens.select("key", F.explode("t").alias("term"), F.size("t").alias("total")).join(chosen, "term").groupBy("key", "term", "total").agg((F.count("*") / F.col("total")).alias("f"))
    n = total.agg(F.count("*").alias("rows"))
    moments = found.groupBy("term").agg(F.sum("f").alias("s"), F.sum(F.col("f") * F.col("f")).alias("s2")).crossJoin(F.broadcast(n))  # by one row
    mean = F.col("s") / F.col("rows")
    moments = moments.select("term", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("rows") * mean * mean) / (F.col("rows") - 1))).alias("sd")).where("sd > 1e-15")
    table = F.broadcast(moments.agg(F.sort_array(F.collect_list(F.struct("term", "mean", "sd"))).alias("m")))  # one row of at most ``words`` entries
    held = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "f"))).alias("f"))  # at most ``words`` entries
    rows = total.select("key").join(held, "key", "left").crossJoin(table)
    each = rows.select("key", "f", F.explode("m").alias("m"))
    z = (F.coalesce(F.try_element_at("f", F.col("m.term")), F.lit(0.0)) - F.col("m.mean")) / F.col("m.sd")
    return each.select(F.col("key").alias(key), F.col("m.term").alias("term"), z.alias("z"))


def packed_profiles(df: DataFrame, key: str, text: str, workspace: Workspace, words: int = 100) -> tuple[DataFrame, int]:
    """``id, vec``: the frequencies of ``profiles`` as one packed row per text, words in order; and how many words there are.

    Texts are cut into words once and spread evenly. What comes to the driver is
    the words and, a row a task, their means and deviations.
    """
    spread = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).repartition("id")
    tokens = workspace.cut(spread.select("id", T.style_tokens(F.col("text")).alias("t")))
    counts = tokens.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    chosen = sorted(r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(words).collect())
    n = len(chosen)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(1)
            total = pc.list_value_length(t).to_numpy(zero_copy_only=False)
            at = pc.index_in(t.flatten(), pa.array(chosen, t.type.value_type))
            at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), total)
            held = np.bincount(row[at >= 0] * n + at[at >= 0], minlength=batch.num_rows * n).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), _bodies(held / np.maximum(total, 1)[:, None])], names=["id", "vec"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # deviations from the mean so far, so that nothing is lost to a difference of large sums
        rows, mean, square = 0, np.zeros(n), np.zeros(n)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, n)
            if len(x):
                m = x.mean(0)
                rows, mean, square = _merged((rows, mean, square), (len(x), m, ((x - m) ** 2).sum(0)))
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), _bodies(mean[None]), _bodies(square[None])], names=["rows", "mean", "square"])

    if not n:
        return tokens.select("id", F.lit(b"").alias("vec")).limit(0), 0
    frequencies = workspace.cut(tokens.mapInArrow(shares, "id bigint, vec binary"))
    workspace.drop(tokens)
    rows, mean, square = 0, np.zeros(n), np.zeros(n)
    for r in frequencies.select("vec").mapInArrow(moments, "rows bigint, mean binary, square binary").collect():
        if r["rows"]:
            rows, mean, square = _merged((rows, mean, square), (r["rows"], np.frombuffer(r["mean"]), np.frombuffer(r["square"])))
    sd = np.sqrt(square / (rows - 1)) if rows > 1 else np.zeros(n)
    varies = sd > 1e-15
    if not varies.any():
        return frequencies.limit(0), 0
    mean, sd = mean[varies], sd[varies]

    def standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), _bodies((x[:, varies] - mean) / sd)], names=["id", "vec"])

    made = workspace.cut(frequencies.where("id is not null").mapInArrow(standard, "id bigint, vec binary"))
    workspace.drop(frequencies)
    return made, len(mean)


def _bodies(x: np.ndarray) -> pa.Array:
    data, step = x.astype(np.float64).tobytes(), 8 * x.shape[1]
    return pa.array([data[i : i + step] for i in range(0, len(data), step)], pa.binary())


def _merged(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sums of squared deviations of two sets as those of both."""
    rows, apart = a[0] + b[0], b[1] - a[1]
    return rows, a[1] + apart * (b[0] / rows), a[2] + b[2] + apart * apart * (a[0] * b[0] / rows)


def delta_nearest(vectors: DataFrame, asked: DataFrame, k: int, words: int) -> DataFrame:
    """``src, dst, distance, place``: the ``k`` texts of the smallest mean absolute difference for each id in ``asked``."""
    return nearest_to(vectors.join(asked.select(F.col(asked.columns[0]).cast("bigint").alias("id")), "id", "left_semi"), vectors, words, k, "manhattan")


def measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per text: words, sentences, words a sentence, type-token ratio, and the rates of colons, commas, all punctuation and name-like words.

    Null and empty texts have zeros.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = (lambda pattern: F.size(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    rows = df.select(key, T.unicode_tokens(t).alias("tok"), count("[.!?]+").alias("stops"), count(":").alias("colon"), count(",").alias("comma"), count("[.,:;!?]").alias("punct"), count("(?<=[\\p{Ll},] )\\p{Lu}\\p{Ll}+").alias("names"))
    w = F.size("tok")
    rate = (lambda x: F.when(w > 0, F.round(F.col(x) / w, 9)).otherwise(0.0))
    return rows.select(key, w.alias("words"), F.greatest("stops", F.lit(1)).alias("sentences"), F.round(w / F.greatest("stops", F.lit(1)), 9).alias("words_per_sentence"), F.when(w > 0, F.round(F.size(F.array_distinct("tok")) / w, 9)).otherwise(0.0).alias("ttr"), rate("colon").alias("colon_rate"), rate("comma").alias("comma_rate"), rate("punct").alias("punct_rate"), rate("names").alias("name_rate"))
