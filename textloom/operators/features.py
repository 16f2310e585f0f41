"""Symbol sequences of annotated texts, n-gram counts and vocabularies, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T

#: A token of an annotated text; ``head`` is the place of its governor.
TOKEN = "array<struct<i:int,head:int,text:string,lower:string,lemma:string,pos:string,dependency:string,morphology:string,entity:string,is_punct:boolean,like_num:boolean>>"
#: Families of feature numbers, by their tens.
FAMILIES = {0: "word", 1: "word", 2: "pair", 3: "pos", 4: "dependency", 5: "morphology", 6: "entity"}


def annotate(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``tokens``: words and punctuation with what can be told without a trained tagger.

    Lemmas are lower-case words; the governor of a token is the one before it;
    a part of speech is NUM, PUNCT, PROPN (capital within a sentence) or X; there
    are no entities. A trained tagger can be put in its place, see ``providers``.
    """
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[\\p{L}\\p{N}]+(?:['’\\-][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]"), F.lit(0))

    def token(word: Column, i: Column) -> Column:
        punct, num = ~word.rlike("[\\p{L}\\p{N}]"), word.rlike("^[0-9]+([.,'’\\-][0-9]+)*$")
        pos = F.when(punct, "PUNCT").when(num, "NUM").when((i > 0) & word.rlike("^\\p{Lu}\\p{Ll}"), "PROPN").otherwise("X")
        return F.struct(i.cast("int").alias("i"), F.greatest(i - 1, F.lit(0)).cast("int").alias("head"), word.alias("text"), F.lower(word).alias("lower"), F.lower(word).alias("lemma"), pos.alias("pos"), F.when(i == 0, "root").when(punct, "punct").otherwise("dep").alias("dependency"), F.when(num, "NumType=Card").otherwise("").alias("morphology"), F.lit("").alias("entity"), punct.alias("is_punct"), num.alias("like_num"))

    return df.withColumn("tokens", F.transform(raw, token))


def symbols(tokens: Column, mode: int) -> Column:
    """The symbol sequence of a feature number.

    10 words, 11 lemmas, 12 and 13 the same with entity types in their place;
    20 to 23 governor_dependent pairs of those, numerals not as dependents;
    30 parts of speech, 31 without punctuation, 32 without spaces; 40 dependency
    labels; 50 morphology, 51 without punctuation, 52 with entity types; 60
    entity types, 61 entity texts.
    """
    kept = F.filter(tokens, lambda t: ~t["is_punct"])

    def named(t: Column, field: str, entity: bool) -> Column:
        return F.when(t["entity"] == "", t[field]).otherwise(t["entity"]) if entity else t[field]

    if mode in (10, 11, 12, 13):
        return F.transform(kept, lambda t: named(t, "lower" if mode % 2 == 0 else "lemma", mode >= 12))
    if mode in (20, 21, 22, 23):
        field, entity = ("lower" if mode % 2 == 0 else "lemma"), mode >= 22

        def pairs(tok: Column) -> Column:
            children = F.filter(tok, lambda t: (t["head"] != t["i"]) & ~t["like_num"])
            ordered = F.array_sort(F.transform(children, lambda t: F.struct(t["head"].alias("h"), t["i"].alias("i"), named(t, field, entity).alias("w"))))
            return F.transform(ordered, lambda t: F.concat(named(F.element_at(tok, t["h"] + 1), field, entity), F.lit("_"), t["w"]))

        return T.bound(tokens, pairs)
    if mode == 30:
        return F.transform(tokens, lambda t: t["pos"])
    if mode == 31:
        return F.transform(kept, lambda t: t["pos"])
    if mode == 32:
        return F.transform(F.filter(tokens, lambda t: t["pos"] != "SPACE"), lambda t: t["pos"])
    if mode == 40:
        return F.transform(kept, lambda t: t["dependency"])
    if mode == 50:
        return F.transform(tokens, lambda t: t["morphology"])
    if mode == 51:
        return F.transform(kept, lambda t: t["morphology"])
    if mode == 52:
        return F.transform(tokens, lambda t: named(t, "morphology", True))
    if mode == 60:
        return F.transform(tokens, lambda t: t["entity"])
    if mode == 61:
        return F.transform(F.filter(tokens, lambda t: t["entity"] != ""), lambda t: t["text"])
    raise ValueError(f"no feature number {mode}")


def as_json(df: DataFrame, key: str, text: str, tokens: str) -> DataFrame:
    """``key, document``: annotated texts as JSON objects."""
    return df.select(key, F.to_json(F.struct(F.col(key), F.col(text), F.col(tokens))).alias("document"))


def _named(tokens: str, modes: list[int], low: int, high: int) -> Column:
    """The n-grams of a row's symbols in all modes, with their names."""
    def named(mode: int, tok: Column) -> Column:
        return F.transform(T.ngrams_between(symbols(tok, mode), low, high), lambda g: F.concat(g, F.lit(f"_{mode}")))

    def named_all(tok: Column) -> Column:
        return F.flatten(F.array(*[named(m, tok) for m in modes]))

    return T.bound(F.col(tokens), named_all)


def counts(df: DataFrame, key: str, tokens: str, modes: list[int], low: int = 1, high: int = 3) -> DataFrame:
    """``key, feature, n``: n-grams of the symbols of each mode, named ``ngram_mode``; empty symbols are dropped first."""
    return df.select(key, F.explode(_named(tokens, modes, low, high)).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("n"))


def corpus_counts(df: DataFrame, tokens: str, modes: list[int], low: int = 1, high: int = 3, least_rows: int = 1) -> DataFrame:
    """``feature, rows, n`` over all rows, as ``vocabulary`` of ``counts`` without the counts of each row.

    A row's features are put in order, so that the first of equal ones can be
    told and rows and occurrences are summed in one step, within the tasks first.
    """
    def marked(x: Column) -> Column:
        return F.transform(x, lambda f, i: F.struct(f.alias("feature"), ((i == 0) | (f != F.get(x, i - 1))).cast("int").alias("first")))

    each = df.select(F.explode(T.bound(F.sort_array(_named(tokens, modes, low, high)), marked)).alias("e"))
    made = each.groupBy(F.col("e.feature").alias("feature")).agg(F.sum("e.first").alias("rows"), F.count("*").alias("n"))
    return made.where(F.col("rows") >= least_rows)


def vocabulary(long: DataFrame, rows: DataFrame, least_share: float = 0.0, most_share: float = 1.0, least_rows: int = 1, most_features: int | None = None) -> DataFrame:
    """``feature, rows, n``: features within shares of all ``rows``, those without any feature too; the most frequent ones if there is a limit, ties by name."""
    total = rows.agg(F.count("*").alias("all"))
    terms = long.groupBy("feature").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    kept = terms.crossJoin(F.broadcast(total)).where((F.col("rows") >= least_rows) & (F.col("rows") >= least_share * F.col("all")) & (F.col("rows") <= most_share * F.col("all"))).drop("all")  # by one row
    return kept.orderBy(F.desc("n"), "feature").limit(most_features) if most_features else kept


def recount(long: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The counts of a given vocabulary only; what a text lacks has no row."""
    return long.join(vocabulary.select("feature"), "feature", "left_semi")


def frame_summary(long: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows with a feature, features, counts that aren't zero, and their share of rows times features."""
    held = long.agg(F.countDistinct(key).alias("filled"), F.countDistinct("feature").alias("features"), F.count("*").alias("counts"))
    whole = rows.agg(F.count("*").alias("rows"))
    share = F.when(F.col("rows") * F.col("features") > 0, F.round(F.col("counts") / (F.col("rows") * F.col("features")), 9)).otherwise(0.0)
    return whole.crossJoin(F.broadcast(held)).select("rows", "filled", "features", "counts", share.alias("density"))  # by one row
