import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import frequency, queries
from textloom.llm.suffixes import common_prefixes, search, suffix_array
from textloom.llm.words import words


def brute(texts, max_n):
    cf, df = Counter(), Counter()
    for t in texts:
        w = words(t)
        grams = [(" ".join(w[i : i + n]), n) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (cf[g], df[g]) for g in cf}


def run(spark, texts, max_n=1):
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, term string").repartition(3)
    return {(r["term"], r["n"]): (r["occurrences"], r["records"]) for r in frequency.term_counts(df, "text", max_n).collect()}


def test_counts(spark):
    random.seed(1)
    texts = [" ".join(random.choice("a b c d É1 ß".split()) for _ in range(random.randint(0, 12))) for _ in range(200)] + [None, "", "..", "x " * 3000]
    assert run(spark, texts, 3) == brute(texts, 3)
    assert run(spark, []) == {}


def spelt_out(rows):
    out = Counter()
    for r in rows:
        w = r["term"].split(" ")
        assert len(w) == r["longest"]
        for n in range(r["shortest"], r["longest"] + 1):
            out[(" ".join(w[:n]), n)] += 1
    return out


def test_classes_hold_every_ngram_once(spark):
    random.seed(2)
    texts = [" ".join(random.choice("a b c É1 ß".split()) for _ in range(random.randint(0, 9))) for _ in range(150)] + [None, "", "..", "x " * 40, "a b c ß a b", "a b c ß a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = frequency.ngram_classes(df, "text", group=200).collect()
    want = brute(texts, 50)
    assert spelt_out(rows) == Counter(dict.fromkeys(want, 1))
    got = {(" ".join(r["term"].split(" ")[:n]), n): (r["occurrences"], r["records"]) for r in rows for n in range(r["shortest"], r["longest"] + 1)}
    assert got == want
    assert frequency.ngram_classes(df.limit(0), "text").count() == 0


def test_rare_and_long_ngrams_come_out_of_the_query(spark, tmp_path):
    rows = ["one two three four"] * 2 + ["one two"] * 30 + [None] * 4
    spark.createDataFrame([(t,) for t in rows], "query string").write.parquet(f"{tmp_path}/query_record.parquet")
    got = {(r["term"], r["shortest"], r["longest"]): (r["records"], r["mark"]) for r in queries.queries()["p6_all"](spark, str(tmp_path)).collect()}
    assert got[("one two", 2, 2)] == (32, "common")
    assert got[("two three", 2, 2)] == (2, "rare")
    assert got[("one two three four", 3, 4)] == (2, "rare")


def test_marks(spark):
    rows = [("common",)] * 12 + [("common rare",)] * 2 + [(None,)] * 6 + [("middle",)] * 3
    df = spark.createDataFrame(rows, "text string")
    got = {r["term"]: r["mark"] for r in frequency.marked_terms(df, "text", common=0.5).collect()}
    assert got == {"common": "common", "rare": "rare", "middle": None}
    # exactly the share isn't more than it
    assert {r["term"]: r["mark"] for r in frequency.marked_terms(df, "text", common=14 / 23).collect()}["common"] is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), max_size=8), st.integers(1, 4))
def test_intervals_equal_counting(texts, max_n):
    terms, sizes, cf, df = frequency.intervals(texts, max_n)
    assert {(t, n): (a, b) for t, n, a, b in zip(terms, sizes, cf, df, strict=True)} == brute(texts, max_n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=4))
def test_suffix_array_and_search(ids, pattern):
    seq = np.array([*ids, 99], np.int64)
    order, ranks = suffix_array(seq)
    suffixes = [seq[i:].tolist() for i in range(len(seq))]
    assert order.tolist() == sorted(range(len(seq)), key=lambda i: suffixes[i])
    lcp = common_prefixes(order, ranks)
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    low, high = search(seq, order, np.array([pattern]), np.array([len(pattern)]))
    assert sorted(order[low[0] : high[0]].tolist()) == [i for i, s in enumerate(suffixes) if s[: len(pattern)] == pattern]
