import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions import text as T


def value(spark, f, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_says_length(spark):
    rows = {"write an answer in 150 words please": 1, "Summarize this in 20 WORDS.": 1, "words about 150 topics": 0, "use 150 characters": 0, "a short text": 1, "LONG TEXT please": 1, "please write a short text": 0, None: 0, "": 0}
    assert value(spark, T.says_length, *rows) == list(rows.values())


def test_tokenizers(spark):
    assert value(spark, T.ascii_tokens, "Don't stop wire-service's 2nd naïve!", None, "") == [["don't", "stop", "wire-service's", "2nd", "na", "ve"], [], []]
    assert value(spark, T.unicode_tokens, "Naïve ÉTÉ's a_b 東京") == [["naïve", "été's", "a", "b", "東京"]]
    odd = "Straße ΣΟΦΌΣ ſo ﬁn µ ΐ Plain"
    assert value(spark, T.unicode_tokens, odd) == [[w.casefold() for w in odd.split()]]
    assert value(spark, T.style_tokens, "Well, it's 5 o’clock") == [["well", ",", "it's", "o’clock"]]
    assert value(spark, T.word_count, " a  b\nc ", None, "") == [3, 0, 0]


def test_stems_and_topics(spark):
    assert value(spark, T.crude_stem, "transported", "transport", "walking", "sing", "boxes", "churches", "cats", "gas") == ["transport", "transport", "walk", "sing", "boxe", "church", "cats", "gas"]
    assert value(spark, T.topic_words, "The engines transported the engine of Ab") == [["engin", "transport", "engine"]]


def test_ngrams_and_openings(spark):
    f = lambda n: (lambda t: T.ngrams(T.plain_words(t), n))
    assert value(spark, f(2), "a b c", "a", None) == [["a b", "b c"], [], []]
    assert value(spark, lambda t: T.ngrams_between(F.split(t, ","), 1, 2), "a,,b") == [["a", "b", "a b"]]
    assert value(spark, lambda t: T.opening(T.plain_words(t), 2), "a b c", "a") == ["a b", None]
    assert value(spark, lambda t: T.first_token(T.plain_words(t)), "a b", "") == ["a", None]


def test_ids_and_names(spark):
    assert value(spark, T.id_prefix, "fm-1", "-x", "plain", None) == ["fm", "other", "other", "other"]
    assert value(spark, lambda t: T.with_suffix(t, "_m"), "a", "a_m", None) == ["a_m", "a_m", None]
    assert value(spark, T.feature_label, "Case=Nom_50", "cat_10") == ["Case:Nom", "cat"]
    assert value(spark, lambda t: T.has_word(t, "answer"), "Answer me", "éanswer", "unanswered", None) == [True, False, False, False]
    assert value(spark, lambda t: T.render("{{N}}: {{TEXT}}", {"N": F.lit(3), "TEXT": t}), "a{{N}}", None) == ["3: a{{N}}", "3: "]


@pytest.mark.parametrize(("a", "ok"), [([1.0, 0.0], True), ([0.0, 0.0], False), ([1.0], False), ([float("nan"), 1.0], False), ([float("inf"), 1.0], False), ([None, 1.0], False), (None, False)])
def test_usable_vectors(spark, a, ok):
    df = spark.createDataFrame([(a,)], "v array<double>")
    assert df.select(A.usable(F.col("v"), 2).alias("u")).first()["u"] is ok


def test_vector_arithmetic(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(A.norm(F.col("a")).alias("n"), A.dot(F.col("a"), F.col("b")).alias("d"), A.euclidean(F.col("a"), F.col("b")).alias("e"), A.cosine_distance(F.col("a"), F.col("z")).alias("c"), A.unit(F.col("z")).alias("u")).first()
    assert (r["n"], r["d"], round(r["e"], 9), r["c"], r["u"]) == (5.0, 24.0, 1.414213562, 1.0, None)
