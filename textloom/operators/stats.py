"""Counts, descriptions and contrasts of texts and ranks.

All operators take and give DataFrames. Null texts count as empty, null ranks
and labels are left out, ties go by the term or the stated key, an empty table
gives no rows (or a row of zeros where a single row is promised).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T


def nearest_rank(values: DataFrame, value: str, shares: Iterable[int]) -> DataFrame:
    """``share, value``: percentiles by nearest rank, at ``bround(share / 100 * n + 0.5)`` of the ordered values.

    The values are counted first and only the distinct ones are put in order, so
    nothing but a histogram is ordered.
    """
    histogram = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    whole = histogram.agg(F.sum("n").alias("all"))
    upto = running_total(histogram, "v", "n").withColumnRenamed("_total", "upto").crossJoin(F.broadcast(whole))  # by one row
    at = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    wanted = upto.select("v", "n", "upto", "all", at).withColumn("k", F.least(F.col("all"), F.greatest(F.lit(1), F.expr("bround(share / 100D * all + 0.5D, 0)").cast("bigint"))))
    return wanted.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select("share", F.col("v").alias("value"))


def running_total(df: DataFrame, order: str, amount: str, descending: bool = False, ranges: int = 64) -> DataFrame:
    """``df`` with ``_total``, the sum of ``amount`` up to and with the row; ``order`` is unique and not null.

    Rows are sorted in ranges, each summed on its own; the ranges' sums, one row
    each, are added up and joined back, so no task holds all rows.
    """
    by = F.desc(order) if descending else F.asc(order)
    parts = df.repartitionByRange(ranges, by).withColumn("_range", F.spark_partition_id())
    sums = parts.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))  # a row per range
    inside = F.sum(amount).over(Window.partitionBy("_range").orderBy(by))
    return parts.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn("_total", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def describe(values: DataFrame, value: str) -> DataFrame:
    """One row: count, min, quartiles by nearest rank, median, mean, max and sample deviation (0 for one value)."""
    x = F.col(value)
    base = values.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 2).alias("mean"), F.median(x).alias("median"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 2).alias("stdev"))
    ranks = nearest_rank(values, value, (25, 75, 90)).groupBy().pivot("share", [25, 75, 90]).agg(F.first("value"))
    ranks = ranks.toDF("p25", "p75", "p90")
    return base.crossJoin(F.broadcast(ranks))  # one row by one row


def describe_all(values: DataFrame, value: str) -> DataFrame:
    """One row: sum, min, mean, median, max and population deviation."""
    x = F.col(value)
    return values.agg(F.sum(x).alias("total"), F.min(x).alias("min"), F.round(F.avg(x), 6).alias("mean"), F.median(x).alias("median"), F.max(x).alias("max"), F.round(F.stddev_pop(x), 6).alias("stdev"))


def occurrences(tokens: DataFrame, token_column: str, *by: str) -> DataFrame:
    """``by..., term, n``: how often each token occurs."""
    return tokens.select(*by, F.explode(token_column).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))


def record_frequency(tokens: DataFrame, token_column: str, *by: str) -> DataFrame:
    """``by..., term, n``: in how many records each token occurs."""
    return tokens.select(*by, F.explode(F.array_distinct(token_column)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame, token_column: str, *by: str) -> DataFrame:
    """Tokens, types, type-token ratio, words that occur once and their share of the types."""
    terms = occurrences(tokens, token_column, *by)
    made = terms.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"))
    ratio = (lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0))
    return made.withColumns({"ttr": ratio("types", "tokens"), "once_share": ratio("once", "types")})


def duplicate_texts(df: DataFrame, text: str) -> DataFrame:
    """One row ``repeats``: rows beyond the first of each text, compared in lower case without outer blanks."""
    sizes = df.groupBy(F.lower(F.trim(text)).alias("t")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.when(F.col("t").isNotNull() & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("repeats"))


def top(terms: DataFrame, k: int, *by: str, order: Iterable[Column] = ()) -> DataFrame:
    """The ``k`` terms of the highest ``n`` (of each group), ties by term; with their ``place``.

    Grouped, each salt keeps its own ``k`` first, so a group of any size is
    ordered in parts.
    """
    ranking = [F.desc("n"), *(order or [F.asc("term")])]
    if not by:
        few = terms.orderBy(*ranking).limit(k)
        return few.withColumn("place", F.row_number().over(Window.orderBy(*ranking)))
    salted = terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(16)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*ranking))).where(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*ranking))).where(F.col("place") <= k).drop("_salt")


def rank_metrics(ranks: DataFrame, rank: str, *by: str, depths: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """Queries, mean and median rank, mean reciprocal rank and recall at some depths; null ranks don't count."""
    r = F.col(rank)
    aggs = [F.count(r).alias("queries"), F.round(F.avg(r), 6).alias("mean_rank"), F.median(r).alias("median_rank"), F.round(F.avg(1 / r), 6).alias("mrr")]
    aggs += [F.round(F.avg((r <= d).cast("int")), 6).alias(f"recall_{d}") for d in depths]
    return ranks.where(r.isNotNull()).groupBy(*by).agg(*aggs)


def rank_rollup(ranks: DataFrame, rank: str, by: str) -> DataFrame:
    """``rank_metrics`` for each value of ``by`` and over all (``by`` null, ``whole`` 1), from one rollup."""
    r = F.col(rank)
    rows = ranks.where(r.isNotNull() & F.col(by).isNotNull())
    made = rows.rollup(by).agg(F.grouping(by).cast("int").alias("whole"), F.count(r).alias("queries"), F.round(F.avg(1 / r), 6).alias("mrr"), F.round(F.avg((r <= 10).cast("int")), 6).alias("recall_10"))
    return made


def failures_by_suffix(ranks: DataFrame, key: str, rank: str, suffixes: Iterable[str], threshold: int = 60) -> DataFrame:
    """For each id ending: queries, those ranked below ``threshold``, their percentage; a suffix without queries has zeros."""
    spark = ranks.sparkSession
    names = spark.createDataFrame([(s,) for s in suffixes], "suffix string")
    tested = F.explode(F.filter(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(F.col(key), s)))
    counts = ranks.where(F.col(rank).isNotNull()).select(tested.alias("suffix"), rank).groupBy("suffix").agg(F.count("*").alias("total"), F.count_if(F.col(rank) > threshold).alias("worse"))
    out = names.join(F.broadcast(counts), "suffix", "left").select("suffix", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("worse", F.lit(0)).alias("worse"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("worse") / F.col("total"), 4)).otherwise(0.0))


def histogram(values: DataFrame, value: str) -> DataFrame:
    """``value, n, density`` of whole numbers."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """``a * d / (b * c)``; infinity for a zero denominator only, null where both products are zero."""
    over, under = (a * d).cast("double"), (b * c).cast("double")
    return F.when(under != 0, F.round(over / under, 2)).when(over != 0, F.lit(float("inf")))


def contrast(tokens: DataFrame, token_column: str, label: str, least: int = 1) -> DataFrame:
    """Per term: records of label 1 and 0 that hold it, the expected number under independence, and the odds ratio."""
    held = tokens.where(F.col(label).isin(0, 1)).select(label, F.explode(F.array_distinct(token_column)).alias("term"))
    counts = held.groupBy("term").agg(F.count_if(F.col(label) == 1).alias("hard"), F.count_if(F.col(label) == 0).alias("easy")).where(F.col("hard") >= least)
    sums = tokens.where(F.col(label).isin(0, 1)).agg(F.count_if(F.col(label) == 1).alias("all_hard"), F.count_if(F.col(label) == 0).alias("all_easy"))
    both = counts.crossJoin(F.broadcast(sums))  # the right side is one row
    share = F.round(100.0 * F.col("hard") / (F.col("hard") + F.col("easy")), 4)
    expected = F.round((F.col("hard") + F.col("easy")) * F.col("all_hard") / (F.col("all_hard") + F.col("all_easy")), 4)
    odds = odds_ratio(F.col("hard"), F.col("easy"), F.col("all_hard") - F.col("hard"), F.col("all_easy") - F.col("easy"))
    return both.select("term", "hard", "easy", share.alias("hard_percent"), expected.alias("expected_hard"), odds.alias("odds_ratio"))


def lexicon_table(tokens: DataFrame, token_column: str, label: str, lexicons: dict[str, Iterable[str]]) -> DataFrame:
    """Per lexicon the 2 x 2 counts of records with one of its words, by label, and the odds ratio."""
    entries = F.array(*[F.struct(F.lit(name).alias("lexicon"), F.array(*[F.lit(w) for w in sorted(set(ws))]).alias("words")) for name, ws in lexicons.items()])
    rows = tokens.where(F.col(label).isin(0, 1)).select(label, token_column, F.explode(entries).alias("e"))
    rows = rows.select(F.col("e.lexicon").alias("lexicon"), (F.col(label) == 1).alias("h"), F.arrays_overlap(token_column, "e.words").alias("w"))
    h, w = F.col("h"), F.col("w")
    table = rows.groupBy("lexicon").agg(F.count_if(h & w).alias("hard_with"), F.count_if(~h & w).alias("easy_with"), F.count_if(h & ~w).alias("hard_without"), F.count_if(~h & ~w).alias("easy_without"))
    return table.withColumn("odds_ratio", odds_ratio(F.col("hard_with"), F.col("easy_with"), F.col("hard_without"), F.col("easy_without")))


def openings(tokens: DataFrame, token_column: str, label: str, lengths: Iterable[int] = (2, 3, 4, 5, 6), least_percent: float = 90.0) -> DataFrame:
    """Openings of some lengths with their counts by label; those with more than ``least_percent`` of label 1."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), T.opening(F.col(token_column), k).alias("opening")) for k in lengths]))
    rows = tokens.where(F.col(label).isin(0, 1)).select(label, each.alias("o")).select(label, "o.k", "o.opening").where("opening is not null")
    counts = rows.groupBy("k", "opening").agg(F.count_if(F.col(label) == 1).alias("hard"), F.count_if(F.col(label) == 0).alias("easy"))
    return counts.where(100.0 * F.col("hard") / (F.col("hard") + F.col("easy")) > least_percent)


def leak_reasons(queries: DataFrame, text: str, source_words: str, rare: DataFrame, key: str, longest: int = 35, shared: int = 3) -> DataFrame:
    """``key, reason``: why a query gives its source away (too long, a rare word, too many shared words); null if it doesn't.

    ``source_words`` are the topic words of the source, worked out once for all its queries; ``key`` is unique.
    """
    rows = queries.select(key, T.word_count(F.col(text)).alias("words"), F.explode_outer(F.array_intersect(T.topic_words(F.col(text)), source_words)).alias("term"))
    held = rows.join(rare.select("term", F.lit(True).alias("_rare")), "term", "left").groupBy(key).agg(F.max("words").alias("words"), F.count("term").alias("common"), F.max("_rare").alias("rare"))
    reason = F.when(F.col("words") > longest, "long").when(F.col("rare"), "rare word").when(F.col("common") > shared, "shared words")
    return held.select(key, reason.alias("reason"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: the weights that make all classes count alike."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return counts.withColumn("weight", F.round(F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n")), 9))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: the 2 x 2 counts, balanced accuracy, and precision, recall and F1 of label 1 (0 where undefined)."""
    y, p = F.col(label), F.col(predicted)
    c = df.where(y.isin(0, 1) & p.isin(0, 1)).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    div = (lambda a, b: F.when(b > 0, a / b).otherwise(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    precision, recall = div(tp, tp + fp), div(tp, tp + fn)
    return c.select("tn", "fp", "fn", "tp", F.round((div(tn, tn + fp) + recall) / 2, 9).alias("balanced_accuracy"), F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(div(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))
