"""Results that are kept between runs: what can be reused, what is pending, and batches with a place in the order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.stats import running_total

def reusable(corpus: DataFrame, kept: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """Kept rows whose key is in the corpus with a text of the same SHA-256, each once however often the corpus has it."""
    now = corpus.select(F.col(key).alias("_key"), F.sha2(text, 256).alias("_now"))
    return kept.join(now, (F.col(key) == F.col("_key")) & (F.col(digest) == F.col("_now")), "left_semi")


def pending(corpus: DataFrame, kept: DataFrame, key: str, text: str, digest: str) -> DataFrame:
    """Corpus rows without a kept row of the same key and text; null texts are never pending."""
    rows = corpus.where(F.col(text).isNotNull())
    have = kept.select(F.col(key).alias("_key"), F.col(digest).alias("_digest")).where("_key is not null and _digest is not null")
    return rows.join(have, (rows[key] == have["_key"]) & (F.sha2(rows[text], 256) == have["_digest"]), "left_anti")


def materialise(corpus: DataFrame, kept: DataFrame, key: str, text: str, digest: str, compute: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Reused rows and computed ones for what is pending; keys that left the corpus are gone. ``force`` computes all."""
    if force:
        return compute(corpus.where(F.col(text).isNotNull()))
    return reusable(corpus, kept, key, text, digest).unionByName(compute(pending(corpus, kept, key, text, digest)))


def unprocessed(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among those done."""
    return rows.join(done.select(*keys), list(keys), "left_anti")


def to_annotate(rows: DataFrame, column: str, allowed: list, force: bool = False) -> DataFrame:
    """Rows whose annotation is null or not allowed, or all of them."""
    c = F.col(column)
    return rows if force else rows.where(c.isNull() | ~c.isin(allowed))


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``batch`` and ``index`` in it: groups of about ``size`` by a hash of the key, so that none has to be ordered as a whole."""
    n = F.lit(max(1, -(-rows.count() // size)))
    numbered = rows.withColumn("batch", (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % n).cast("int"))
    return numbered.withColumn("index", F.row_number().over(Window.partitionBy("batch").orderBy(key)) - 1)


def as_requests(rows: DataFrame, text: str) -> DataFrame:
    """``batch, request``: each batch as a JSON array of index and text."""
    return rows.groupBy("batch").agg(F.to_json(F.sort_array(F.collect_list(F.struct("index", F.col(text).alias("query"))))).alias("request"))


def aligned(rows: DataFrame, answers: DataFrame, value: str) -> DataFrame:
    """Requests with their answers by batch and index; missing, repeated and foreign answers come with a ``problem``."""
    counted = answers.groupBy("batch", "index").agg(F.first(value).alias(value), F.count("*").alias("_n"))
    both = rows.select("batch", "index", F.lit(True).alias("_asked")).join(counted, ["batch", "index"], "full")
    problem = F.when(F.col("_asked").isNull(), "not asked").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return both.select("batch", "index", value, problem.alias("problem"))


def fingerprint(df: DataFrame, key: str, text: str) -> str:
    """A digest of all keys and texts: the sum of row digests, which no order of rows changes."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(part).alias("s")).first()
    return f"{r['n']}-{r['s'] or 0:x}" if isinstance(r["s"], int) else f"{r['n']}-{int(r['s'] or 0):x}"


def cached(df: DataFrame, path: str, mark: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table kept under ``path`` for this mark (see ``fingerprint``), computed and written if there is none."""
    spark = df.sparkSession
    where = f"{path.rstrip('/')}/{mark}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        compute(df).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def first_of_each(df: DataFrame, group: Column, order: list[str]) -> DataFrame:
    """The first row of each group; rows with a null group are left out.

    By the smallest struct of the order, combined before the shuffle, so that a
    hot group isn't sorted.
    """
    rows = df.withColumn("_g", group).where("_g is not null")
    packed = rows.groupBy("_g").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return packed.select("_r.*")


def prepared(df: DataFrame, key: str, text: str, language: str, accepted: tuple[str, ...] = ("en", "eng", "english")) -> DataFrame:
    """Rows of an accepted language (in any letter case), the first of each text in lower case with single blanks."""
    kept = df.where(F.lower(F.trim(language)).isin(list(accepted)) & F.col(text).isNotNull())
    return first_of_each(kept, F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")), [key])


def chosen_representatives(df: DataFrame, key: str, probability: str, words: str, fraction: float, most_words: int) -> DataFrame:
    """Of the ``floor(n * fraction)`` rows of the highest probability those of at most ``most_words`` words."""
    order = [F.desc(probability), F.asc(key)]
    wanted = int(df.count() * fraction)
    # the probability of the last row chosen, from a histogram; only rows of that probability are put in order
    counts = df.groupBy(F.col(probability).alias("_p")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, "_p", "_n", descending=True)
    last = F.broadcast(upto.where((F.col("_total") >= wanted) & (F.col("_total") - F.col("_n") < wanted)).select("_p", (F.lit(wanted) - F.col("_total") + F.col("_n")).alias("_left")))
    above = df.join(last, F.col(probability) > F.col("_p")).drop("_p", "_left")
    edge = df.join(last, F.col(probability) == F.col("_p")).withColumn("_place", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    chosen = above.unionByName(edge.where("_place <= _left").drop("_p", "_left", "_place"))
    return chosen.where(F.col(words) <= most_words)


def reduced_outliers(df: DataFrame, cluster: str, by_probability: str, by_similarity: str) -> DataFrame:
    """``df`` with ``final`` and ``method``: the original cluster, else the likeliest, else the most similar; -1 is none."""
    valid = (lambda c: F.when(F.col(c) >= 0, F.col(c)))
    method = F.when(valid(cluster).isNotNull(), "original_cluster").when(valid(by_probability).isNotNull(), "hdbscan_probability").when(valid(by_similarity).isNotNull(), "embedding_similarity")
    return df.withColumn("final", F.coalesce(valid(cluster), valid(by_probability), valid(by_similarity), F.lit(-1))).withColumn("method", method)


def eligible(paragraphs: DataFrame, key: str, text: str, existing: DataFrame, group: str, least_words: int = 20) -> DataFrame:
    """Paragraphs of at least ``least_words`` words that no existing row was made for; null keys are never eligible."""
    rows = paragraphs.where(F.col(key).isNotNull() & (T.word_count(F.col(text)) >= least_words))
    return rows.join(existing.select(F.col(group).alias(key)), key, "left_anti")


def running_totals(df: DataFrame, batch: str, amount: str) -> DataFrame:
    """``batch, n, total, n_so_far, total_so_far, mean_so_far``: what each batch brings and what there is after it."""
    per = df.groupBy(batch).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
    upto = running_total(running_total(per, batch, "n").withColumnRenamed("_total", "n_so_far"), batch, "total").withColumnRenamed("_total", "total_so_far")
    return upto.withColumn("mean_so_far", F.round(F.col("total_so_far") / F.col("n_so_far"), 6))
