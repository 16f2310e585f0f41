"""Every operator as a query over the test tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions import text as T
from textloom.functions.lexicons import COMMON_WORDS, FORM_WORDS, ID_SUFFIXES, LEXICONS, QUERY_STOPWORDS, TOPIC_STOPWORDS
from textloom.operators import classify, clustering, features, graph, incremental, manifold, providers, ranking, sampling, stats, stylometry, validation
from textloom.operators import tests_of_association as association
from textloom.plans.materialize import Workspace
from textloom.sources import indexes
from textloom.streaming.incremental import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Hard queries (rank above 60) as 1, easy ones (rank 1) as 0."""
    rows = _t(spark, folder, "ranking_result").where("rank > 60 or rank = 1")
    return rows.withColumn("label", (F.col("rank") > 60).cast("int"))


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_ASCII = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+(?:[''’-][a-z0-9]+)*')"
_UNICODE = "list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*'), lambda x: lower(x))"
_STYLE = "list_transform(regexp_extract_all(coalesce({0}, ''), '[\\p{{L}}]+(?:[''’][\\p{{L}}]+)*|,'), lambda x: lower(x))"
_WORDS = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> ''))"
_LAB = "lab AS (SELECT *, CASE WHEN rank > 60 THEN 1 ELSE 0 END AS label FROM ranking_result WHERE rank > 60 OR rank = 1)"
_Q = f"q AS (SELECT row_id, {_ASCII.format('query')} AS tok FROM query_record)"
_BIGRAMS = "CASE WHEN len(tok) >= 2 THEN list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) ELSE [] END"
_STEM = "CASE WHEN w LIKE '%ing' AND length(w) > 6 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) > 5 THEN w[:-3] WHEN w LIKE '%es' AND length(w) > 5 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 4 THEN w[:-2] ELSE w END"
_TOPIC = f"(SELECT DISTINCT row_id, {_STEM} AS term FROM (SELECT row_id, unnest(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9'']+')) AS w FROM {{1}}) WHERE length(w) > 2 AND NOT list_contains({_quoted((*TOPIC_STOPWORDS, *FORM_WORDS))}, w))"


# ---- tokenizers, terms, vocabularies


def _query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "query_record").select("row_id", "id", "query", T.ascii_tokens(F.col("query")).alias("tok"))


@query(f"WITH {_Q} SELECT term, count(*) AS n FROM (SELECT unnest(tok) AS term FROM q) GROUP BY term")
def text_ascii_terms(spark, folder):
    return stats.occurrences(_query_tokens(spark, folder), "tok")


@query(f"SELECT term, count(*) AS n FROM (SELECT replace(translate(unnest({_UNICODE.format('text')}), 'ςſµ', 'σsμ'), 'ß', 'ss') AS term FROM documents) GROUP BY term")
def text_unicode_terms(spark, folder):
    return stats.occurrences(_t(spark, folder, "documents").select(T.unicode_tokens(F.col("text")).alias("tok")), "tok")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_STYLE.format('text')}) AS term FROM corpus_record) GROUP BY term")
def text_style_terms(spark, folder):
    return stats.occurrences(_t(spark, folder, "corpus_record").select(T.style_tokens(F.col("text")).alias("tok")), "tok")


@query(f"SELECT term, count(*) AS n FROM {_TOPIC.format('text', 'corpus_record')} GROUP BY term HAVING count(*) <= 10")
def text_rare_topics(spark, folder):
    return _rare_topics(spark, folder)


def _rare_topics(spark, folder):
    words = _t(spark, folder, "corpus_record").select(T.topic_words(F.col("text")).alias("w"))
    return stats.record_frequency(words, "w").where("n <= 10")


@query(f"WITH {_Q} SELECT term, count(*) AS n FROM (SELECT unnest({_BIGRAMS}) AS term FROM q) GROUP BY term")
def text_bigrams(spark, folder):
    rows = _query_tokens(spark, folder).select(T.ngrams(F.col("tok"), 2).alias("b"))
    return stats.occurrences(rows, "b")


@query(f"WITH {_Q} SELECT term, count(*) AS n FROM (SELECT DISTINCT row_id, term FROM (SELECT row_id, unnest({_BIGRAMS}) AS term FROM q)) WHERE term <> 'a text' GROUP BY term")
def text_phrases(spark, folder):
    rows = _query_tokens(spark, folder).select(F.array_except(T.ngrams(F.col("tok"), 2), F.array(F.lit("a text"))).alias("b"))
    return stats.record_frequency(rows, "b")


@query(f"WITH {_Q} SELECT tok[1] AS term, count(*) AS n FROM q WHERE len(tok) > 0 GROUP BY 1")
def text_first_words(spark, folder):
    return _query_tokens(spark, folder).select(T.first_token(F.col("tok")).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_Q} SELECT term, count(*) AS n FROM (SELECT unnest(tok) AS term FROM q) WHERE NOT list_contains({_quoted(QUERY_STOPWORDS)}, term) GROUP BY term")
def text_content_words(spark, folder):
    return stats.occurrences(_query_tokens(spark, folder).select(T.content_words(F.col("tok")).alias("w")), "w")


@query("SELECT row_id, sha256(text) AS digest FROM corpus_record WHERE text IS NOT NULL")
def text_digests(spark, folder):
    return _t(spark, folder, "corpus_record").where("text is not null").select("row_id", F.sha2("text", 256).alias("digest"))


@query("SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(concat(row_id, '|', coalesce(text, ''))), 1, 12)) AS BIGINT)) AS DOUBLE) AS fingerprint FROM corpus_record")
def text_fingerprint(spark, folder):
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "row_id", F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return _t(spark, folder, "corpus_record").agg(F.count("*").alias("n"), F.sum(part).cast("double").alias("fingerprint"))


@query("SELECT row_id, replace(replace('Write {{N}} questions on: {{TEXT}}', '{{N}}', '3'), '{{TEXT}}', coalesce(text, '')) AS prompt FROM corpus_record")
def text_rendered(spark, folder):
    return _t(spark, folder, "corpus_record").select("row_id", T.render("Write {{N}} questions on: {{TEXT}}", {"N": F.lit(3), "TEXT": F.col("text")}).alias("prompt"))


@query("SELECT row_id FROM query_record WHERE lower(query) LIKE 'text where%' OR lower(query) LIKE 'text that%' OR lower(query) LIKE 'text beginning with%'")
def text_form_openings(spark, folder):
    low = F.lower("query")
    return _t(spark, folder, "query_record").where(low.startswith("text where") | low.startswith("text that") | low.startswith("text beginning with")).select("row_id")


@query(f"WITH {_Q}, g AS (SELECT row_id, unnest(list_concat(list_concat(tok, {_BIGRAMS}), CASE WHEN len(tok) >= 3 THEN list_transform(range(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2]) ELSE [] END)) AS term FROM q) SELECT term, count(*) AS n, count(DISTINCT row_id) AS records FROM g GROUP BY term")
def text_ngrams_to_three(spark, folder):
    rows = _query_tokens(spark, folder).select("row_id", F.explode(T.ngrams_between(F.col("tok"), 1, 3)).alias("term"))
    return rows.groupBy("row_id", "term").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("records"))


# ---- filters and derived fields


@query(f"SELECT row_id, {_WORDS.format('text')} AS words FROM corpus_record WHERE {_WORDS.format('text')} >= 20")
def filter_words_at_least(spark, folder):
    return _t(spark, folder, "corpus_record").select("row_id", T.word_count(F.col("text")).cast("bigint").alias("words")).where("words >= 20")


@query(f"SELECT row_id, {_WORDS.format('text')} AS words FROM corpus_record WHERE {_WORDS.format('text')} > 40")
def filter_words_above(spark, folder):
    return _t(spark, folder, "corpus_record").select("row_id", T.word_count(F.col("text")).cast("bigint").alias("words")).where("words > 40")


@query("SELECT row_id, CASE WHEN id LIKE '%\\_m' ESCAPE '\\' THEN id ELSE id || '_m' END AS new_id, id LIKE '%\\_m' ESCAPE '\\' AS unchanged FROM query_record WHERE id IS NOT NULL")
def filter_suffix_appended(spark, folder):
    return _t(spark, folder, "query_record").where("id is not null").select("row_id", T.with_suffix(F.col("id"), "_m").alias("new_id"), F.col("id").endswith("_m").alias("unchanged"))


@query(f"WITH {_LAB} SELECT label, count(*) AS n FROM lab WHERE regexp_matches(coalesce(query, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])text([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY label")
def filter_word_by_label(spark, folder):
    return _labelled(spark, folder).where(T.has_word(F.col("query"), "text")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT row_id FROM query_record WHERE contains(id, '_hard')")
def filter_id_contains(spark, folder):
    return _t(spark, folder, "query_record").where(F.col("id").contains("_hard")).select("row_id")


@query("SELECT row_id, CASE WHEN instr(id, '-') > 1 THEN split_part(id, '-', 1) ELSE 'other' END AS prefix FROM corpus_record")
def filter_id_prefix(spark, folder):
    return _t(spark, folder, "corpus_record").select("row_id", T.id_prefix(F.col("id")).alias("prefix"))


@query("SELECT row_id, query_id, rank, CASE WHEN rank > 60 THEN 'hard' ELSE 'easy' END AS kind FROM ranking_result WHERE rank > 60 OR rank = 1")
def filter_hard_and_easy(spark, folder):
    return _labelled(spark, folder).select("row_id", "query_id", "rank", F.when(F.col("label") == 1, "hard").otherwise("easy").alias("kind"))


@query(f"SELECT row_id, CAST(regexp_matches(coalesce(query, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])[0-9]+\\s+words([^\\p{{L}}\\p{{N}}_]|$)') OR ({_WORDS.format('query')} < 5 AND regexp_matches(coalesce(query, ''), '(?i)(^|[^\\p{{L}}\\p{{N}}_])(short|long)\\s+text([^\\p{{L}}\\p{{N}}_]|$)')) AS INT) AS says_length FROM query_record")
def filter_says_length(spark, folder):
    return _t(spark, folder, "query_record").select("row_id", T.says_length(F.col("query")).alias("says_length"))


@query("SELECT row_id, regexp_extract(id, '^(.+)_hard([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(id, '^(.+)_hard([1-9][0-9]*)$', 2) AS INT) AS number FROM query_record WHERE regexp_matches(id, '^(.+)_hard([1-9][0-9]*)$')")
def filter_hard_number(spark, folder):
    rows = _t(spark, folder, "query_record").where(F.col("id").rlike("^(.+)_hard([1-9][0-9]*)$"))
    return rows.select("row_id", F.regexp_extract("id", "^(.+)_hard([1-9][0-9]*)$", 1).alias("base"), F.regexp_extract("id", "^(.+)_hard([1-9][0-9]*)$", 2).cast("int").alias("number"))


@query(f"WITH {_Q} SELECT row_id, " + ", ".join(f"list_has_any(tok, {_quoted(ws)}) AS {name}" for name, ws in LEXICONS.items()) + " FROM q")
def filter_lexicon_flags(spark, folder):
    return _query_tokens(spark, folder).select("row_id", *[T.has_any(F.col("tok"), ws).alias(name) for name, ws in LEXICONS.items()])


@query("SELECT row_id, coalesce(nullif(trim(query, ' '), ''), nullif(id, ''), 'Point ' || row_id) AS hover FROM query_record")
def filter_hover_text(spark, folder):
    return _t(spark, folder, "query_record").select("row_id", F.coalesce(F.nullif(F.trim("query"), F.lit("")), F.nullif("id", F.lit("")), F.concat(F.lit("Point "), "row_id")).alias("hover"))


@query("SELECT row_id, 'query_' || lpad(CAST(row_id AS VARCHAR), CAST((SELECT greatest(5, max(length(CAST(row_id AS VARCHAR)))) FROM embedded_query) AS INT), '0') AS name FROM embedded_query")
def filter_padded_names(spark, folder):
    rows = _t(spark, folder, "embedded_query").select("row_id", F.col("row_id").cast("string").alias("s"))
    width = rows.agg(F.greatest(F.lit(5), F.max(F.length("s"))).alias("w"))
    return rows.crossJoin(F.broadcast(width)).select("row_id", F.expr("concat('query_', lpad(s, w, '0'))").alias("name"))  # by one row


@query("SELECT row_id, CASE WHEN rank > 60 THEN 2 WHEN rank > 1 THEN 1 ELSE 0 END AS query_type, CAST(coalesce(rank, 0) > 60 AS DOUBLE) AS qt2, CAST(coalesce(rank, 0) BETWEEN 2 AND 60 AS DOUBLE) AS qt1, CAST(coalesce(rank, 0) <= 1 AS DOUBLE) AS qt0 FROM ranking_result")
def filter_one_hot(spark, folder):
    kind = F.when(F.col("rank") > 60, 2).when(F.col("rank") > 1, 1).otherwise(0)
    rows = _t(spark, folder, "ranking_result").select("row_id", kind.alias("query_type"))
    return rows.select("row_id", "query_type", *[(F.col("query_type") == k).cast("double").alias(f"qt{k}") for k in range(3)])


# ---- aggregates


@query(f"WITH w AS (SELECT {_WORDS.format('query')} AS v FROM query_record), s AS (SELECT list_sort(list(v)) AS l, count(*) AS n FROM w) SELECT (SELECT n FROM s) AS n, min(v) AS min, max(v) AS max, round(avg(v), 2) AS mean, median(v) AS median, round(coalesce(stddev_samp(v), 0), 2) AS stdev, " + ", ".join(f"(SELECT l[least(n, greatest(1, CAST(round_even(CAST({p} / 100.0 * n + 0.5 AS DOUBLE), 0) AS BIGINT)))] FROM s) AS p{p}" for p in (25, 75, 90)) + " FROM w")
def agg_describe(spark, folder):
    words = _t(spark, folder, "query_record").select(T.word_count(F.col("query")).cast("bigint").alias("v"))
    return stats.describe(words, "v")


@query(f"WITH {_LAB}, w AS (SELECT label, {_WORDS.format('query')} AS v FROM lab WHERE label = 1) SELECT CAST(sum(v) AS BIGINT) AS total, min(v) AS min, round(avg(v), 6) AS mean, median(v) AS median, max(v) AS max, round(stddev_pop(v), 6) AS stdev FROM w")
def agg_describe_hard(spark, folder):
    words = _labelled(spark, folder).where("label = 1").select(T.word_count(F.col("query")).cast("bigint").alias("v"))
    return stats.describe_all(words, "v")


@query(f"WITH {_Q}, t AS (SELECT term, count(*) AS n FROM (SELECT unnest(tok) AS term FROM q) GROUP BY term) SELECT CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count_if(n = 1) AS once, round(count(*) / sum(n), 4) AS ttr, round(count_if(n = 1) / count(*), 4) AS once_share FROM t")
def agg_vocabulary(spark, folder):
    return stats.vocabulary(_query_tokens(spark, folder), "tok")


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeats FROM (SELECT lower(trim(query, ' ')) AS t, count(*) AS n FROM query_record WHERE query IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def agg_duplicates(spark, folder):
    return stats.duplicate_texts(_t(spark, folder, "query_record"), "query")


_PREFIX = "CASE WHEN instr(id, '-') > 1 THEN split_part(id, '-', 1) ELSE 'other' END"


@query(f"WITH q AS (SELECT {_PREFIX} AS corpus, length(query) AS c, {_ASCII.format('query')} AS tok FROM query_record WHERE query IS NOT NULL), t AS (SELECT corpus, term, count(*) AS k FROM (SELECT corpus, unnest(tok) AS term FROM q) GROUP BY 1, 2) SELECT a.corpus, a.queries, a.mean_chars, a.mean_words, b.types FROM (SELECT corpus, count(*) AS queries, round(avg(c), 6) AS mean_chars, round(avg(len(tok)), 6) AS mean_words FROM q GROUP BY corpus) a JOIN (SELECT corpus, count(*) AS types FROM t GROUP BY corpus) b USING (corpus)")
def agg_by_corpus(spark, folder):
    rows = _t(spark, folder, "query_record").where("query is not null").select(T.id_prefix(F.col("id")).alias("corpus"), F.length("query").alias("c"), T.ascii_tokens(F.col("query")).alias("tok"))
    sizes = rows.groupBy("corpus").agg(F.count("*").alias("queries"), F.round(F.avg("c"), 6).alias("mean_chars"), F.round(F.avg(F.size("tok")), 6).alias("mean_words"))
    return sizes.join(stats.vocabulary(rows, "tok", "corpus").select("corpus", "types"), "corpus")


@query(f"WITH q AS (SELECT {_PREFIX} AS corpus, {_ASCII.format('query')} AS tok FROM query_record), t AS (SELECT corpus, term, count(*) AS n FROM (SELECT corpus, unnest(tok) AS term FROM q) WHERE NOT list_contains({_quoted(QUERY_STOPWORDS)}, term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, term) AS place FROM t) SELECT corpus, term, n, CAST(place AS INT) AS place FROM r WHERE place <= 10")
def agg_top_by_corpus(spark, folder):
    rows = _t(spark, folder, "query_record").select(T.id_prefix(F.col("id")).alias("corpus"), T.content_words(T.ascii_tokens(F.col("query"))).alias("tok"))
    return stats.top(stats.occurrences(rows, "tok", "corpus"), 10, "corpus")


@query("SELECT count(*) AS queries, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS recall_1, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_5, round(avg(CAST(rank <= 10 AS INT)), 6) AS recall_10 FROM ranking_result WHERE rank IS NOT NULL")
def agg_rank_metrics(spark, folder):
    return stats.rank_metrics(_t(spark, folder, "ranking_result"), "rank")


@query("SELECT source, CAST(grouping(source) AS INT) AS whole, count(*) AS queries, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 10 AS INT)), 6) AS recall_10 FROM ranking_result WHERE rank IS NOT NULL AND source IS NOT NULL GROUP BY ROLLUP (source)")
def agg_rank_by_source(spark, folder):
    return stats.rank_rollup(_t(spark, folder, "ranking_result"), "rank", "source")


@query(f"WITH s AS (SELECT unnest({_quoted(ID_SUFFIXES)}) AS suffix), c AS (SELECT suffix, count(*) AS total, count_if(rank > 60) AS worse FROM s JOIN ranking_result ON ends_with(query_id, suffix) WHERE rank IS NOT NULL GROUP BY suffix) SELECT suffix, coalesce(total, 0) AS total, coalesce(worse, 0) AS worse, CASE WHEN coalesce(total, 0) > 0 THEN round(100.0 * worse / total, 4) ELSE 0.0 END AS percent FROM s LEFT JOIN c USING (suffix)")
def agg_failures_by_suffix(spark, folder):
    return stats.failures_by_suffix(_t(spark, folder, "ranking_result"), "query_id", "rank", ID_SUFFIXES)


@query(f"WITH {_LAB} SELECT count_if(label = 1) AS hard, count_if(label = 0) AS easy, count(*) AS total, round(avg(label), 6) AS share FROM lab")
def agg_class_summary(spark, folder):
    return _labelled(spark, folder).agg(F.count_if(F.col("label") == 1).alias("hard"), F.count_if(F.col("label") == 0).alias("easy"), F.count("*").alias("total"), F.round(F.avg("label"), 6).alias("share"))


_LEX_VALUES = ", ".join(f"('{n}', {_quoted(ws)})" for n, ws in LEXICONS.items())


@query(f"WITH {_LAB}, l(lexicon, words) AS (VALUES {_LEX_VALUES}), c AS (SELECT lexicon, count_if(label = 1 AND list_has_any(tok, words)) AS hard_with, count_if(label = 0 AND list_has_any(tok, words)) AS easy_with, count_if(label = 1 AND NOT list_has_any(tok, words)) AS hard_without, count_if(label = 0 AND NOT list_has_any(tok, words)) AS easy_without FROM (SELECT label, {_ASCII.format('query')} AS tok FROM lab), l GROUP BY lexicon) SELECT *, CASE WHEN easy_with * hard_without <> 0 THEN round(hard_with * easy_without / CAST(easy_with * hard_without AS DOUBLE), 2) WHEN hard_with * easy_without <> 0 THEN CAST('inf' AS DOUBLE) END AS odds_ratio FROM c")
def agg_lexicon_odds(spark, folder):
    rows = _labelled(spark, folder).select("label", T.ascii_tokens(F.col("query")).alias("tok"))
    return stats.lexicon_table(rows, "tok", "label", LEXICONS)


def _contrast_sql(tokens: str) -> str:
    return f"WITH {_LAB}, r AS (SELECT row_id, label, tok FROM (SELECT row_id, label, {_ASCII.format('query')} AS tok FROM lab)), d AS (SELECT DISTINCT row_id, label, term FROM (SELECT row_id, label, unnest({tokens}) AS term FROM r)), c AS (SELECT term, count_if(label = 1) AS hard, count_if(label = 0) AS easy FROM d GROUP BY term HAVING count_if(label = 1) >= 1), s AS (SELECT count_if(label = 1) AS h, count_if(label = 0) AS e FROM lab) SELECT term, hard, easy, round(100.0 * hard / (hard + easy), 4) AS hard_percent, round((hard + easy) * h / CAST(h + e AS DOUBLE), 4) AS expected_hard, CASE WHEN easy * (h - hard) <> 0 THEN round(CAST(hard * (e - easy) AS DOUBLE) / (easy * (h - hard)), 2) WHEN hard * (e - easy) <> 0 THEN CAST('inf' AS DOUBLE) END AS odds_ratio FROM c, s"


@query(_contrast_sql("tok"))
def agg_word_odds(spark, folder):
    rows = _labelled(spark, folder).select("label", T.ascii_tokens(F.col("query")).alias("tok"))
    return stats.contrast(rows, "tok", "label")


@query(_contrast_sql(_BIGRAMS))
def agg_phrase_odds(spark, folder):
    rows = _labelled(spark, folder).select("label", T.ngrams(T.ascii_tokens(F.col("query")), 2).alias("tok"))
    return stats.contrast(rows, "tok", "label")


@query(_contrast_sql("tok") + " WHERE 100.0 * hard / (hard + easy) > 70")
def agg_hard_words(spark, folder):
    rows = _labelled(spark, folder).select("label", T.ascii_tokens(F.col("query")).alias("tok"))
    return stats.contrast(rows, "tok", "label").where(100.0 * F.col("hard") / (F.col("hard") + F.col("easy")) > 70)


@query(f"WITH {_LAB}, r AS (SELECT label, {_ASCII.format('query')} AS tok FROM lab), o AS (SELECT label, k, array_to_string(tok[1:k], ' ') AS opening FROM r, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE len(tok) >= k) SELECT CAST(k AS INT) AS k, opening, count_if(label = 1) AS hard, count_if(label = 0) AS easy FROM o GROUP BY k, opening HAVING 100.0 * count_if(label = 1) / count(*) > 90")
def agg_openings(spark, folder):
    rows = _labelled(spark, folder).select("label", T.ascii_tokens(F.col("query")).alias("tok"))
    return stats.openings(rows, "tok", "label")


@query(f"SELECT value, n, round(n / sum(n) OVER (), 9) AS density FROM (SELECT {_WORDS.format('query')} AS value, count(*) AS n FROM query_record GROUP BY 1)")
def agg_histogram(spark, folder):
    return stats.histogram(_t(spark, folder, "query_record").select(T.word_count(F.col("query")).cast("bigint").alias("v")), "v")


_PAIRS = "p AS (SELECT q.row_id, q.query, c.text FROM query_record q JOIN (SELECT id, arg_min(text, row_id) AS text FROM corpus_record WHERE text IS NOT NULL GROUP BY id) c ON q.paragraph_id = c.id WHERE q.query IS NOT NULL)"


@query(f"WITH {_PAIRS}, rare AS (SELECT term FROM {_TOPIC.format('text', 'corpus_record')} GROUP BY term HAVING count(*) <= 10), a AS {_TOPIC.format('query', 'p')}, b AS {_TOPIC.format('text', 'p')}, s AS (SELECT a.row_id, count(*) AS common, count(rare.term) AS rare FROM a JOIN b ON a.row_id = b.row_id AND a.term = b.term LEFT JOIN rare ON rare.term = a.term GROUP BY a.row_id) SELECT p.row_id, CASE WHEN {_WORDS.format('query')} > 35 THEN 'long' WHEN rare > 0 THEN 'rare word' WHEN common > 3 THEN 'shared words' END AS reason FROM p LEFT JOIN s USING (row_id)")
def agg_leak_reasons(spark, folder):
    first = _t(spark, folder, "corpus_record").where("text is not null").groupBy("id").agg(F.min_by("text", "row_id").alias("text")).select("id", T.topic_words(F.col("text")).alias("theirs"))
    pairs = _t(spark, folder, "query_record").where("query is not null").select("row_id", "query", "paragraph_id").join(first, F.col("paragraph_id") == F.col("id"))
    return stats.leak_reasons(pairs, "query", "theirs", _rare_topics(spark, folder), "row_id")


@query(f"WITH {_LAB}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c")
def agg_class_weights(spark, folder):
    return stats.class_weights(_labelled(spark, folder), "label")


@query(f"WITH {_LAB}, c AS (SELECT count_if(label = 0 AND p = 0) AS tn, count_if(label = 0 AND p = 1) AS fp, count_if(label = 1 AND p = 0) AS fn, count_if(label = 1 AND p = 1) AS tp FROM (SELECT label, CAST(coalesce(cosine_similarity, 0) < 0.7 AS INT) AS p FROM lab)) SELECT *, round((coalesce(tn / nullif(tn + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0)) / 2, 9) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c")
def agg_confusion(spark, folder):
    rows = _labelled(spark, folder).withColumn("p", (F.coalesce("cosine_similarity", F.lit(0.0)) < 0.7).cast("int"))
    return stats.confusion(rows, "label", "p")


@query("SELECT paragraph_id, count(*) AS n FROM query_record WHERE paragraph_id IS NOT NULL GROUP BY paragraph_id")
def agg_per_paragraph(spark, folder):
    return _t(spark, folder, "query_record").where("paragraph_id is not null").groupBy("paragraph_id").agg(F.count("*").alias("n"))


# ---- top, windows, samples, sets


@query(f"WITH {_Q} SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, f) AS INT) AS place FROM (SELECT term, count(*) AS n, min(row_id * 1000000 + p) AS f FROM (SELECT row_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS p FROM q) GROUP BY term) ORDER BY n DESC, f LIMIT 25")
def top_terms(spark, folder):
    """The most frequent terms, ties by their first occurrence."""
    terms = _query_tokens(spark, folder).select("row_id", F.posexplode("tok").alias("p", "term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "p")).alias("first"))
    return stats.top(counts, 25, order=[F.asc("first")]).select("term", "n", "place")


@query(f"WITH w AS (SELECT DISTINCT row_id, term FROM (SELECT row_id, replace(translate(unnest({_UNICODE.format('query')}), 'ςſµ', 'σsμ'), 'ß', 'ss') AS term FROM query_record)) SELECT term, count(*) AS n FROM w WHERE NOT list_contains({_quoted(COMMON_WORDS)}, term) GROUP BY term ORDER BY n DESC, term LIMIT 30")
def top_words_by_records(spark, folder):
    """The 30 words in most records, without those that are common anywhere."""
    words = _t(spark, folder, "query_record").select(T.content_words(T.unicode_tokens(F.col("query")), COMMON_WORDS).alias("w"))
    return stats.top(stats.record_frequency(words, "w"), 30).select("term", "n")


@query(f"WITH {_Q} SELECT term, count(*) AS n FROM (SELECT DISTINCT row_id, term FROM (SELECT row_id, unnest({_BIGRAMS}) AS term FROM q)) WHERE term <> 'a text' GROUP BY term ORDER BY n DESC, term LIMIT 30")
def top_phrases_by_records(spark, folder):
    return stats.top(text_phrases(spark, folder), 30).select("term", "n")


@query("SELECT row_id, query_id, rank FROM ranking_result WHERE rank IS NOT NULL ORDER BY rank DESC, row_id LIMIT 20")
def top_worst_ranks(spark, folder):
    return _t(spark, folder, "ranking_result").where("rank is not null").orderBy(F.desc("rank"), "row_id").limit(20).select("row_id", "query_id", "rank")


@query("SELECT source, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT source, count(*) AS n FROM query_record WHERE source IS NOT NULL GROUP BY source)")
def win_shares(spark, folder):
    counts = _t(spark, folder, "query_record").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("SELECT row_id, paragraph_id, CAST(row_number() OVER (PARTITION BY paragraph_id ORDER BY row_id) + n AS BIGINT) AS number FROM query_record JOIN (SELECT id AS paragraph_id, count(*) AS n FROM corpus_record GROUP BY id) USING (paragraph_id)")
def win_continued_numbers(spark, folder):
    existing = _t(spark, folder, "corpus_record").select(F.col("id").alias("paragraph_id"))
    new = _t(spark, folder, "query_record").select("row_id", "paragraph_id").join(existing.distinct(), "paragraph_id", "left_semi")
    return sampling.continue_numbers(new, existing, "paragraph_id", ["row_id"]).select("row_id", "paragraph_id", F.col("number").cast("bigint").alias("number"))


_HARD = "h AS (SELECT regexp_extract(id, '^(.+)_hard([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(id, '^(.+)_hard([1-9][0-9]*)$', 2) AS INT) AS number FROM query_record WHERE regexp_matches(id, '^(.+)_hard([1-9][0-9]*)$'))"


@query(f"WITH {_HARD} SELECT base, CAST(g AS INT) AS number FROM (SELECT DISTINCT base FROM h), (SELECT unnest([1, 2, 3, 4]) AS g) WHERE (base, g) NOT IN (SELECT (base, number) FROM h)")
def win_missing_numbers(spark, folder):
    return sampling.missing_numbers(filter_hard_number(spark, folder), "base", "number", 4)


@query(f"WITH {_LAB}, m AS (SELECT row_id, md5('42|' || row_id) AS h FROM lab WHERE label = 0), k AS (SELECT CAST(round_even(CAST(count(*) * 0.1 AS DOUBLE), 0) AS BIGINT) AS keep FROM m) SELECT row_id FROM lab WHERE label = 1 UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS r FROM m), k WHERE r <= keep")
def sample_thinned(spark, folder):
    return sampling.thin_matching(_labelled(spark, folder), "row_id", F.col("label") == 0, 0.1).select("row_id")


@query(f"WITH {_LAB}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || row_id), row_id) AS r FROM lab), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM lab GROUP BY label)) SELECT row_id, label FROM r, m WHERE r <= n")
def sample_balanced(spark, folder):
    return sampling.balanced(_labelled(spark, folder), "row_id", "label").select("row_id", "label")


@query(f"WITH {_LAB} SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) - 1) % 10 AS INT) AS fold FROM lab")
def sample_folds(spark, folder):
    return sampling.folds(_labelled(spark, folder), "row_id", "label", 10).select("row_id", "label", "fold")


@query(f"WITH {_LAB}, r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || row_id), row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM lab) SELECT row_id, label, r <= CAST(round_even(CAST(n * 0.2 AS DOUBLE), 0) AS BIGINT) AS test FROM r")
def sample_holdout(spark, folder):
    return sampling.holdout(_labelled(spark, folder), "row_id", "label").select("row_id", "label", "test")


@query("SELECT 0 AS part, row_id, query FROM ranking_result WHERE rank = 1 UNION ALL SELECT 1, row_id, query FROM ranking_result WHERE rank > 60")
def set_union(spark, folder):
    rows = _t(spark, folder, "ranking_result")
    easy = rows.where("rank = 1").select(F.lit(0).alias("part"), "row_id", "query")
    return easy.unionByName(rows.where("rank > 60").select(F.lit(1).alias("part"), "row_id", "query"))


@query(f"WITH {_PAIRS}, a AS {_TOPIC.format('query', 'p')}, b AS {_TOPIC.format('text', 'p')} SELECT p.row_id, coalesce(x.common, 0) AS common, coalesce(y.own, 0) - coalesce(x.common, 0) AS own_only FROM p LEFT JOIN (SELECT a.row_id, count(*) AS common FROM a JOIN b ON a.row_id = b.row_id AND a.term = b.term GROUP BY 1) x USING (row_id) LEFT JOIN (SELECT row_id, count(*) AS own FROM a GROUP BY 1) y USING (row_id)")
def set_word_overlap(spark, folder):
    first = _t(spark, folder, "corpus_record").where("text is not null").groupBy("id").agg(F.min_by("text", "row_id").alias("text"))
    rows = _t(spark, folder, "query_record").where("query is not null").select("row_id", "query", "paragraph_id").join(first, F.col("paragraph_id") == F.col("id"))
    a, b = T.topic_words(F.col("query")), T.topic_words(F.col("text"))
    return rows.select("row_id", F.size(F.array_intersect(a, b)).cast("bigint").alias("common"), F.size(F.array_except(a, b)).cast("bigint").alias("own_only"))


# ---- joins and results kept between runs


@query("SELECT q.row_id, q.paragraph_id, c.row_id AS corpus_row FROM query_record q JOIN corpus_record c ON q.paragraph_id = c.id")
def join_inner(spark, folder):
    q, c = _t(spark, folder, "query_record").select("row_id", "paragraph_id"), _t(spark, folder, "corpus_record").select(F.col("id").alias("paragraph_id"), F.col("row_id").alias("corpus_row"))
    return q.join(c, "paragraph_id").select("row_id", "paragraph_id", "corpus_row")


@query("SELECT row_id FROM query_record WHERE id IN (SELECT id FROM embedded_query)")
def join_semi(spark, folder):
    return _t(spark, folder, "query_record").join(_t(spark, folder, "embedded_query").select("id"), "id", "left_semi").select("row_id")


@query("SELECT row_id FROM corpus_record c WHERE NOT EXISTS (SELECT 1 FROM query_record q WHERE q.paragraph_id = c.id)")
def join_anti(spark, folder):
    return _t(spark, folder, "corpus_record").join(_t(spark, folder, "query_record").select(F.col("paragraph_id").alias("id")), "id", "left_anti").select("row_id")


@query("SELECT row_id FROM query_record q WHERE NOT EXISTS (SELECT 1 FROM ranking_result r WHERE r.query_id = q.id AND r.query = q.query)")
def join_anti_two_keys(spark, folder):
    done = _t(spark, folder, "ranking_result").select(F.col("query_id").alias("id"), "query")
    return incremental.unprocessed(_t(spark, folder, "query_record"), done, "id", "query").select("row_id")


@query("SELECT source, count(*) AS skipped FROM query_record WHERE id IS NULL OR id NOT IN (SELECT id FROM embedded_query WHERE id IS NOT NULL) GROUP BY source")
def join_skipped_by_source(spark, folder):
    left = _t(spark, folder, "query_record").join(_t(spark, folder, "embedded_query").select("id"), "id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("skipped"))


@query("SELECT vec_id FROM corpus_embedding e WHERE EXISTS (SELECT 1 FROM corpus_record c WHERE e.id = c.id AND e.text_sha256 = sha256(c.text))")
def inc_reusable(spark, folder):
    return incremental.reusable(_t(spark, folder, "corpus_record").select("id", "text"), _t(spark, folder, "corpus_embedding").select("vec_id", "id", "text_sha256"), "id", "text", "text_sha256").select("vec_id")


@query("SELECT row_id FROM corpus_record c WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus_embedding e WHERE e.id = c.id AND e.text_sha256 = sha256(c.text))")
def inc_pending(spark, folder):
    return incremental.pending(_t(spark, folder, "corpus_record"), _t(spark, folder, "corpus_embedding").select("id", "text_sha256"), "id", "text", "text_sha256").select("row_id")


@query("SELECT row_id FROM embedded_query WHERE rank IS NULL OR rank NOT BETWEEN 1 AND 100")
def inc_to_annotate(spark, folder):
    return incremental.to_annotate(_t(spark, folder, "embedded_query"), "rank", list(range(1, 101))).select("row_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) ORDER BY doc_id) AS r FROM documents WHERE lower(trim(lang, ' ')) IN ('en', 'eng', 'english') AND text IS NOT NULL) WHERE r = 1")
def inc_prepared(spark, folder):
    return incremental.prepared(_t(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang").select("doc_id")


@query("WITH q AS (SELECT row_id, query, CAST('0x' || substr(md5(CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) FROM query_record WHERE query IS NOT NULL) AS b FROM query_record WHERE query IS NOT NULL) SELECT CAST(b AS INT) AS batch, CAST(row_number() OVER (PARTITION BY b ORDER BY row_id) - 1 AS INT) AS index, query FROM q")
def inc_requests(spark, folder):
    """The items of every request, read back from its JSON."""
    rows = _t(spark, folder, "query_record").where("query is not null").select("row_id", "query")
    sent = incremental.as_requests(incremental.batches(rows, "row_id", 50), "query")
    return sent.select("batch", F.explode(F.from_json("request", "array<struct<index:int,query:string>>")).alias("r")).select("batch", "r.index", "r.query")


@query(f"SELECT id FROM corpus_record c WHERE id IS NOT NULL AND {_WORDS.format('text')} >= 20 AND NOT EXISTS (SELECT 1 FROM query_record q WHERE q.paragraph_id = c.id)")
def inc_eligible(spark, folder):
    return incremental.eligible(_t(spark, folder, "corpus_record"), "id", "text", _t(spark, folder, "query_record"), "paragraph_id").select("id")


@query("WITH b AS (SELECT CAST(loaded_at AS DATE) AS day, count(*) AS n, CAST(coalesce(sum(length(query)), 0) AS BIGINT) AS total FROM query_record WHERE loaded_at IS NOT NULL GROUP BY 1), s AS (SELECT day, n, total, CAST(sum(n) OVER w AS BIGINT) AS n_so_far, CAST(sum(total) OVER w AS BIGINT) AS total_so_far FROM b WINDOW w AS (ORDER BY day)) SELECT *, round(total_so_far / n_so_far, 6) AS mean_so_far FROM s")
def agg_running_totals(spark, folder):
    rows = _t(spark, folder, "query_record").where("loaded_at is not null").select(F.to_date("loaded_at").alias("day"), F.length("query").alias("chars"))
    return incremental.running_totals(rows, "day", "chars")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, folder):
    return windowed(_t(spark, folder, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 6))


@query()
def inc_hashed_embedding(spark, folder):
    return providers.called(_t(spark, folder, "corpus_record"), "row_id", "text", providers.HashedWords(64), "embedding", "array<double>")


@query("SELECT id, text_sha256, len(embedding) AS dim, false AS made FROM corpus_embedding e WHERE EXISTS (SELECT 1 FROM corpus_record c WHERE e.id = c.id AND e.text_sha256 = sha256(c.text)) UNION ALL SELECT id, sha256(text), 64, true FROM corpus_record c WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM corpus_embedding e WHERE e.id = c.id AND e.text_sha256 = sha256(c.text))")
def inc_materialised(spark, folder):
    corpus, kept = _t(spark, folder, "corpus_record").select("row_id", "id", "text"), _t(spark, folder, "corpus_embedding").select("id", "text_sha256", F.size("embedding").cast("bigint").alias("dim"), F.lit(False).alias("made"))

    def compute(rows: DataFrame) -> DataFrame:
        made = providers.called(rows, "row_id", "text", providers.HashedWords(64), "embedding", "array<double>")
        return rows.join(made, "row_id").select("id", F.sha2("text", 256).alias("text_sha256"), F.size("embedding").cast("bigint").alias("dim"), F.lit(True).alias("made"))

    return incremental.materialise(corpus, kept, "id", "text", "text_sha256", compute).select("id", "text_sha256", "dim", "made")


# ---- checks


@query("SELECT row_id, field FROM (SELECT row_id, 'id' AS field FROM corpus_record WHERE id IS NULL OR trim(id, ' ') = '' UNION ALL SELECT row_id, 'text' FROM corpus_record WHERE text IS NULL OR trim(text, ' ') = '')")
def val_blank(spark, folder):
    return validation.blank(_t(spark, folder, "corpus_record"), "row_id", "id", "text")


@query("SELECT id, count(*) AS n FROM corpus_record GROUP BY id HAVING count(*) > 1")
def val_repeated(spark, folder):
    return validation.repeated(_t(spark, folder, "corpus_record"), "id")


@query("SELECT vec_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' ELSE 'zero' END AS reason FROM corpus_embedding WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0")
def val_bad_vectors(spark, folder):
    return validation.bad_vectors(_t(spark, folder, "corpus_embedding"), "vec_id", "embedding", 64)


@query("SELECT doc_id, lang AS value FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de', 'fr', 'es', 'ru', 'ja', 'el')")
def val_outside(spark, folder):
    return validation.outside(_t(spark, folder, "documents"), "doc_id", "lang", ["en", "de", "fr", "es", "ru", "ja", "el"])


@query("SELECT c AS class, coalesce(n, 0) AS n FROM (SELECT unnest([0, 1, 2]) AS c) LEFT JOIN (SELECT toxic, count(*) AS n FROM doc_label GROUP BY toxic) ON c = toxic WHERE coalesce(n, 0) < 10")
def val_rare_classes(spark, folder):
    return validation.rare_classes(_t(spark, folder, "doc_label"), "toxic", 10, [0, 1, 2])


@query("SELECT row_id, paragraph_id FROM query_record WHERE paragraph_id IS NOT NULL AND paragraph_id NOT IN (SELECT id FROM corpus_record WHERE id IS NOT NULL)")
def val_orphans(spark, folder):
    return validation.orphans(_t(spark, folder, "query_record").select("row_id", "paragraph_id"), "paragraph_id", _t(spark, folder, "corpus_record"), "id").select("row_id", "paragraph_id")


@query("SELECT e.row_id, q.query AS there, e.query AS here FROM embedded_query e JOIN query_record q USING (row_id) WHERE e.query IS DISTINCT FROM q.query")
def val_disagreement(spark, folder):
    found = validation.disagreement(_t(spark, folder, "embedded_query"), _t(spark, folder, "query_record"), "row_id", "query")
    return found.select("row_id", "there", "here")


@query("SELECT embedding_model, len(embedding) AS dim, count(*) AS n FROM corpus_embedding WHERE embedding IS NOT NULL GROUP BY 1, 2")
def val_dimensions(spark, folder):
    return _t(spark, folder, "corpus_embedding").where("embedding is not null").groupBy("embedding_model", F.size("embedding").cast("bigint").alias("dim")).agg(F.count("*").alias("n"))


# ---- vectors and graphs

_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_OK = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"SELECT row_id, round(sqrt(list_dot_product({_D}, {_D})), 6) AS length FROM embedded_query WHERE {_OK}")
def vec_norms(spark, folder):
    return _t(spark, folder, "embedded_query").where(A.usable(F.col("embedding"), 64)).select("row_id", F.round(A.norm(F.col("embedding")), 6).alias("length"))


@query("WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(embedding), lambda e: CAST(e[i] AS DOUBLE)))) AS m FROM embeddings GROUP BY label) SELECT vec_id, e.label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - m[i]) * (CAST(embedding[i] AS DOUBLE) - m[i])))), 6) AS distance, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), m), 6) AS cosine_distance FROM embeddings e JOIN c ON e.label = c.label")
def vec_centroid_distances(spark, folder):
    rows = _t(spark, folder, "embeddings")
    centres = F.broadcast(clustering.centroids(rows, "label", "embedding", 64))
    return rows.join(centres, "label").select("vec_id", "label", F.round(A.euclidean(F.col("embedding"), F.col("centroid")), 6).alias("distance"), F.round(A.cosine_distance(F.col("embedding"), F.col("centroid")), 6).alias("cosine_distance"))


def _rank_inputs(spark, folder):
    """Queries whose row id is divisible by 20 with the paragraph they were written for, and the first usable vector of each paragraph."""
    model = _t(spark, folder, "corpus_embedding").where("embedding_model = 'embed-small-a' and id is not null")
    corpus = ranking.unit_rows(model, "vec_id", "embedding", 64, "id")
    first = corpus.groupBy(F.col("id").alias("doc_id")).agg(F.min_by(F.struct("vec_id", "unit"), "vec_id").alias("r")).select("doc_id", F.col("r.vec_id").alias("pos"), "r.unit")
    paragraphs = _t(spark, folder, "query_record").where("id is not null and paragraph_id is not null").groupBy("id").agg(F.min_by("paragraph_id", "row_id").alias("target"))
    asked = _t(spark, folder, "embedded_query").where(F.col("row_id") % 20 == 0).select("row_id", "id", "embedding").join(paragraphs, "id")
    queries = ranking.unit_rows(asked, "row_id", "embedding", 64, "target").withColumnRenamed("row_id", "query_id")
    return queries, first


_RANKS = f"""WITH c AS (SELECT id AS doc_id, min(vec_id) AS pos, arg_min({_D}, vec_id) AS v FROM corpus_embedding WHERE embedding_model = 'embed-small-a' AND id IS NOT NULL AND {_OK} GROUP BY id),
p AS (SELECT id, arg_min(paragraph_id, row_id) AS target FROM query_record WHERE id IS NOT NULL AND paragraph_id IS NOT NULL GROUP BY id),
q AS (SELECT row_id AS query_id, target, {_D} AS v FROM embedded_query JOIN p USING (id) WHERE row_id % 20 = 0 AND {_OK}),
s AS (SELECT query_id, target, doc_id, pos, round(list_cosine_similarity(q.v, c.v), 9) AS s FROM q, c),
own AS (SELECT query_id, s AS own, pos AS own_pos FROM s WHERE doc_id = target),
r AS (SELECT query_id, target, 1 + count_if(s > own OR (s = own AND pos < own_pos)) AS rank, round(any_value(own), 6) AS cosine_similarity FROM s JOIN own USING (query_id) GROUP BY query_id, target)
"""


@query(_RANKS + "SELECT * FROM r")
def rank_expected_20th(spark, folder):
    queries, corpus = _rank_inputs(spark, folder)
    return ranking.rank_expected(queries, corpus, 64).withColumn("cosine_similarity", F.round("cosine_similarity", 6))


@query(_RANKS + "SELECT count(*) AS queries, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, round(avg(1.0 / rank), 6) AS mrr, round(avg(CAST(rank <= 1 AS INT)), 6) AS recall_1, round(avg(CAST(rank <= 5 AS INT)), 6) AS recall_5, round(avg(CAST(rank <= 10 AS INT)), 6) AS recall_10 FROM r")
def rank_report_20th(spark, folder):
    """Measures of the ranks asked for: one query in twenty, against all vectors of a model."""
    return stats.rank_metrics(rank_expected_20th(spark, folder), "rank")


def _packed(spark, folder, condition: str = "true") -> DataFrame:
    return ranking.unit_rows(_t(spark, folder, "embeddings").where(condition), "vec_id", "embedding", 64).select(F.col("vec_id").alias("id"), F.col("unit").alias("vec"))


_KNN = f"e AS (SELECT vec_id, list_transform({_D}, lambda x: x / sqrt(list_dot_product({_D}, {_D}))) AS v FROM embeddings WHERE {_OK}), d AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.v, b.v))), 9) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id), k AS (SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM d)"


def _knn(spark, folder, k: int = 10) -> DataFrame:
    rows = _packed(spark, folder)
    return ranking.nearest_to(rows, rows, 64, k)


@query(f"WITH {_KNN} SELECT src, dst, round(distance, 6) AS distance, CAST(place AS INT) AS place FROM k WHERE place <= 10")
def graph_knn(spark, folder):
    return _knn(spark, folder).select("src", "dst", F.round("distance", 6).alias("distance"), F.col("place").cast("int").alias("place"))


_SYM = f"{_KNN}, s AS (SELECT src, dst FROM k WHERE place <= 10 UNION SELECT dst, src FROM k WHERE place <= 10)"


@query(f"WITH {_SYM} SELECT src, dst FROM s")
def graph_symmetric(spark, folder):
    return graph.symmetric(_knn(spark, folder))


@query(f"WITH {_SYM} SELECT src AS i, src AS j, count(*) AS value FROM s GROUP BY src UNION ALL SELECT src, dst, -1 FROM s")
def graph_laplacian(spark, folder):
    return graph.laplacian(graph.symmetric(_knn(spark, folder)))


@query(f"WITH {_SYM} SELECT count(*) // 2 AS edges, count(DISTINCT src) AS nodes FROM s")
def graph_size(spark, folder):
    return graph.symmetric(_knn(spark, folder)).agg((F.count("*") / 2).cast("bigint").alias("edges"), F.countDistinct("src").alias("nodes"))


@query()
def graph_eigenmap(spark, folder):
    return spark.createDataFrame(graph.eigenmap(graph.symmetric(_knn(spark, folder)), 2))


@query()
def graph_spectral(spark, folder):
    return spark.createDataFrame(graph.eigenmap(graph.symmetric(_knn(spark, folder)), 2, normalised=True))


@query()
def graph_swiss_roll(spark, folder):
    return graph.swiss_roll(spark, 2000).unionByName(graph.s_curve(spark, 2000))


@query()
def manifold_components(spark, folder):
    return manifold.principal_components(_t(spark, folder, "embeddings"), "vec_id", "embedding", 64)


def _embeddings(spark, folder) -> pd.DataFrame:
    return graph.guarded(_t(spark, folder, "embeddings").select("vec_id", "embedding", "label").orderBy("vec_id"))


@query()
def manifold_mds(spark, folder):
    rows = _embeddings(spark, folder)
    y = graph.classical_mds(np.stack(rows["embedding"]).astype(float))
    return spark.createDataFrame(pd.DataFrame({"vec_id": rows["vec_id"], "x": y[:, 0], "y": y[:, 1]}))


@query()
def manifold_layout(spark, folder):
    rows = _embeddings(spark, folder)
    y = manifold.neighbour_layout(np.stack(rows["embedding"]).astype(float))
    return spark.createDataFrame(pd.DataFrame({"vec_id": rows["vec_id"], "x": y[:, 0], "y": y[:, 1]}))


# ---- clusters


@query()
def cluster_hierarchical(spark, folder):
    rows = _embeddings(spark, folder)
    d = clustering.distance_matrix(np.stack(rows["embedding"]).astype(float))
    return spark.createDataFrame(pd.DataFrame({"vec_id": rows["vec_id"], "cluster": clustering.cut(clustering.linkage(d, "ward"), len(d), 10)}))


@query()
def cluster_chosen(spark, folder):
    rows = _embeddings(spark, folder)
    d = clustering.distance_matrix(np.stack(rows["embedding"]).astype(float))
    return spark.createDataFrame(clustering.choose_clusters(d, clustering.linkage(d, "average"), 2, 15)[1])


@query()
def cluster_density(spark, folder):
    rows = _embeddings(spark, folder)
    d = clustering.distance_matrix(np.stack(rows["embedding"]).astype(float))
    return spark.createDataFrame(pd.concat([rows[["vec_id"]], clustering.density_clusters(d)], axis=1))


@query("SELECT count(*) AS rows, count(DISTINCT CASE WHEN c >= 0 THEN c END) AS clusters, count_if(c < 0) AS noise, round(avg(CASE WHEN c >= 0 THEN p END), 6) AS mean_probability, round(100.0 * count_if(c < 0) / count(*), 4) AS noise_percent FROM (SELECT CASE WHEN rank > 60 THEN -1 ELSE rank % 7 END AS c, coalesce(cosine_similarity, 0) AS p FROM ranking_result WHERE rank IS NOT NULL)")
def cluster_noise(spark, folder):
    rows = _t(spark, folder, "ranking_result").where("rank is not null").select(F.when(F.col("rank") > 60, -1).otherwise(F.col("rank") % 7).alias("c"), F.coalesce("cosine_similarity", F.lit(0.0)).alias("p"))
    return clustering.noise_report(rows, "c", "p")


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3), r AS (SELECT vec_id, label, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY 1, 2) SELECT vec_id, CAST(label AS INT) AS label, round(coalesce(a, 0), 6) AS a, round(b, 6) AS b, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS width FROM r")
def cluster_silhouettes(spark, folder):
    return clustering.silhouettes(_t(spark, folder, "embeddings"), "vec_id", "embedding", "label", 64)


@query("WITH c AS (SELECT label, count(*) AS n, min(vec_id) AS f FROM embeddings GROUP BY label), r AS (SELECT label, row_number() OVER (ORDER BY n DESC, f) - 1 AS cluster FROM c) SELECT vec_id, CAST(cluster AS INT) AS cluster FROM embeddings JOIN r USING (label)")
def cluster_relabelled(spark, folder):
    return clustering.relabelled(_t(spark, folder, "embeddings"), "label", "vec_id").select("vec_id", F.col("cluster").cast("int").alias("cluster"))


_AGREE = """WITH x AS (SELECT toxic AS a, (doc_id % 3) AS b FROM doc_label WHERE toxic IS NOT NULL), t AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM t GROUP BY b), z AS (SELECT sum(n) AS n FROM t),
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2) FROM ra) AS ii, (SELECT sum(n * (n - 1) / 2) FROM rb) AS jj, (SELECT n FROM z) AS n, (SELECT sum(t.n / z.n * ln(t.n * z.n / (ra.n * rb.n))) FROM t JOIN ra USING (a) JOIN rb USING (b), z) AS mi, (SELECT -sum(ra.n / z.n * ln(ra.n / z.n)) FROM ra, z) AS ha, (SELECT -sum(rb.n / z.n * ln(rb.n / z.n)) FROM rb, z) AS hb)
SELECT round((ij - ii * jj / (n * (n - 1) / 2)) / ((ii + jj) / 2 - ii * jj / (n * (n - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure FROM v"""


@query(_AGREE)
def cluster_agreement(spark, folder):
    return clustering.agreement(_t(spark, folder, "doc_label").withColumn("c", F.col("doc_id") % 3), "toxic", "c")


@query("SELECT category, count(*) AS size, count_if(toxic = 0) AS label_0, count_if(toxic = 1) AS label_1, round(100.0 * count_if(toxic = 1) / count(*), 4) AS percent_1, CAST(count_if(toxic = 1) > count_if(toxic = 0) AS INT) AS dominant, round(greatest(count_if(toxic = 0), count_if(toxic = 1)) / count(*), 6) AS purity FROM doc_label WHERE toxic IN (0, 1) GROUP BY category")
def cluster_label_summary(spark, folder):
    return clustering.label_summary(_t(spark, folder, "doc_label"), "category", "toxic")


def _distances(spark, folder) -> DataFrame:
    return vec_centroid_distances(spark, folder).select("vec_id", "label", "distance")


@query(SQL["vec_centroid_distances"].replace("WITH c AS", "WITH x AS (WITH c AS", 1) + "), r AS (SELECT vec_id, label, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS place FROM x) SELECT vec_id, label, distance, CAST(place AS INT) AS place FROM r WHERE place <= 6")
def cluster_representatives(spark, folder):
    return clustering.representatives(_distances(spark, folder), "label", "vec_id", "distance", 6)


@query(SQL["vec_centroid_distances"].replace("WITH c AS", "WITH x AS (WITH c AS", 1) + ") SELECT label, count(*) AS size, round(min(distance), 6) AS min_distance, round(avg(distance), 6) AS mean_distance, round(max(distance), 6) AS max_distance, min(vec_id % 97) AS best_rank, round(avg(vec_id % 97), 6) AS mean_rank, max(vec_id % 97) AS worst_rank, min(vec_id) AS first_key FROM x GROUP BY label")
def cluster_report(spark, folder):
    return clustering.report(_distances(spark, folder).withColumn("rank", F.col("vec_id") % 97), "label", "vec_id", "distance", "rank")


# ---- style, features, tests, classifiers

_PROFILE = f"""WITH t AS (SELECT row_id, {_STYLE.format('text')} AS tok FROM corpus_record), w AS (SELECT row_id, unnest(tok) AS term FROM t), m AS (SELECT term FROM w GROUP BY term ORDER BY count(*) DESC, term LIMIT 100),
f AS (SELECT t.row_id, m.term, CASE WHEN len(tok) = 0 THEN 0 ELSE coalesce(c.n, 0) / len(tok) END AS f FROM t CROSS JOIN m LEFT JOIN (SELECT row_id, term, count(*) AS n FROM w GROUP BY 1, 2) c ON c.row_id = t.row_id AND c.term = m.term),
z AS (SELECT row_id, term, (f - avg(f) OVER (PARTITION BY term)) / nullif(stddev_samp(f) OVER (PARTITION BY term), 0) AS z FROM f)
"""


def _profile(spark, folder) -> DataFrame:
    return stylometry.profiles(_t(spark, folder, "corpus_record"), "row_id", "text")


@query(_PROFILE + "SELECT row_id, term, round(z, 6) AS z FROM z WHERE z IS NOT NULL")
def style_profiles(spark, folder):
    return _profile(spark, folder).withColumn("z", F.round("z", 6))


@query(_PROFILE + ", d AS (SELECT a.row_id AS src, b.row_id AS dst, round(avg(abs(a.z - b.z)), 9) AS distance FROM z a JOIN z b USING (term) WHERE a.row_id % 20 = 0 AND a.row_id <> b.row_id AND a.z IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS place FROM d) SELECT src, CAST(place AS INT) AS place, round(distance, 6) AS distance FROM r WHERE place <= 5")
def style_delta(spark, folder):
    asked = _t(spark, folder, "corpus_record").where(F.col("row_id") % 20 == 0).select("row_id")
    vectors, words = stylometry.packed_profiles(_t(spark, folder, "corpus_record"), "row_id", "text", Workspace(spark, "delta"))
    return stylometry.delta_nearest(vectors, asked, 5, words).select("src", F.col("place").cast("int").alias("place"), F.round("distance", 6).alias("distance"))


@query()
def style_measures(spark, folder):
    return stylometry.measures(_t(spark, folder, "documents"), "doc_id", "text")


def _annotated(spark, folder) -> DataFrame:
    return features.annotate(_t(spark, folder, "query_record").select("row_id", "query"), "query")


_PAIR_OF = "CASE WHEN len(sym) >= 2 THEN list_transform(range(1, len(sym)), lambda i: sym[i] || ' ' || sym[i + 1]) ELSE [] END"
_FEATURES = """WITH t AS (SELECT row_id, regexp_extract_all(coalesce(query, ''), '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]') AS tok FROM query_record),
a AS (SELECT row_id, list_transform(tok, lambda w, i: {'w': lower(w), 'punct': NOT regexp_matches(w, '[\\p{L}\\p{N}]'), 'pos': CASE WHEN NOT regexp_matches(w, '[\\p{L}\\p{N}]') THEN 'PUNCT' WHEN regexp_matches(w, '^[0-9]+([.,''’\\-][0-9]+)*$') THEN 'NUM' WHEN i > 1 AND regexp_matches(w, '^\\p{Lu}\\p{Ll}') THEN 'PROPN' ELSE 'X' END, 'dep': CASE WHEN i = 1 THEN 'root' ELSE 'dep' END}) AS tok FROM t),
s AS (SELECT row_id, '_10' AS mode, list_transform(list_filter(tok, lambda x: NOT x.punct), lambda x: x.w) AS sym FROM a UNION ALL SELECT row_id, '_30', list_transform(tok, lambda x: x.pos) FROM a UNION ALL SELECT row_id, '_40', list_transform(list_filter(tok, lambda x: NOT x.punct), lambda x: x.dep) FROM a),
g AS (SELECT row_id, mode, unnest(list_concat(sym, """ + _PAIR_OF + """)) AS gram FROM s)
"""


@query(_FEATURES + "SELECT gram || mode AS feature, count(DISTINCT row_id) AS rows, count(*) AS n FROM g GROUP BY 1")
def feat_counts(spark, folder):
    """Features of words, parts of speech and dependencies, one or two symbols long, rare ones too."""
    return features.corpus_counts(_annotated(spark, folder), "tokens", [10, 30, 40], 1, 2)


@query(_FEATURES.replace("list_concat(sym, " + _PAIR_OF + ")", "sym") + ", c AS (SELECT gram || mode AS feature, count(DISTINCT row_id) AS rows, count(*) AS n FROM g WHERE mode = '_10' GROUP BY 1) SELECT feature, rows, n, regexp_replace(replace(feature, '=', ':'), '_[0-9]+$', '') AS label FROM c WHERE rows >= 2 ORDER BY n DESC, feature LIMIT 500")
def feat_vocabulary(spark, folder):
    rows = _annotated(spark, folder)
    long = features.counts(rows, "row_id", "tokens", [10], 1, 1)
    return features.vocabulary(long, rows, least_rows=2, most_features=500).withColumn("label", T.feature_label(F.col("feature")))


@query(_FEATURES.replace("list_concat(sym, " + _PAIR_OF + ")", "sym") + ", c AS (SELECT row_id, gram || mode AS feature FROM g WHERE mode = '_10' GROUP BY ALL), r AS (SELECT count(*) AS rows FROM query_record), h AS (SELECT count(DISTINCT row_id) AS filled, count(DISTINCT feature) AS features, count(*) AS counts FROM c) SELECT rows, filled, features, counts, round(counts / (rows * features), 9) AS density FROM r, h")
def feat_summary(spark, folder):
    rows = _annotated(spark, folder)
    return features.frame_summary(features.counts(rows, "row_id", "tokens", [10], 1, 1), rows, "row_id")


_WORD10 = "w AS (SELECT row_id, lower(unnest(regexp_extract_all(coalesce(query, ''), '[\\p{L}\\p{N}]+(?:[''’\\-][\\p{L}\\p{N}]+)*'))) AS word FROM query_record)"


@query(f"WITH {_WORD10} SELECT row_id, word || '_10' AS feature, count(*) AS n FROM w WHERE word IN (SELECT word FROM w GROUP BY word ORDER BY count(*) DESC, word || '_10' LIMIT 50) GROUP BY 1, 2")
def feat_recount(spark, folder):
    rows = _annotated(spark, folder)
    long = features.counts(rows, "row_id", "tokens", [10], 1, 1)
    return features.recount(long, features.vocabulary(long, rows, most_features=50))


def _flagged(spark, folder) -> DataFrame:
    rows = _labelled(spark, folder).select("row_id", "label", "query", F.coalesce("cosine_similarity", F.lit(0.0)).alias("similarity"))
    tok = T.ascii_tokens(F.col("query"))
    return rows.select("row_id", "label", "similarity", T.word_count(F.col("query")).alias("words"), *[T.has_any(tok, ws).cast("int").alias(n) for n, ws in LEXICONS.items()], T.says_length(F.col("query")).alias("says_length"))


@query(f"WITH {_LAB}, f AS (SELECT label AS y, unnest([{{'f': 'formal', 'l': CAST(CAST(list_has_any(tok, {_quoted(LEXICONS['formal'])}) AS INT) AS VARCHAR)}}, {{'f': 'tone', 'l': CAST(CAST(list_has_any(tok, {_quoted(LEXICONS['tone'])}) AS INT) AS VARCHAR)}}, {{'f': 'style', 'l': CAST(CAST(list_has_any(tok, {_quoted(LEXICONS['style'])}) AS INT) AS VARCHAR)}}]) AS e FROM (SELECT label, {_ASCII.format('query')} AS tok FROM lab)), c AS (SELECT e.f AS feature, e.l AS level, y, count(*) AS o FROM f GROUP BY ALL), g AS (SELECT r.feature, r.r, s.c, t.n, coalesce(c.o, 0) AS o, r.level, s.y FROM (SELECT feature, level, sum(o) AS r FROM c GROUP BY 1, 2) r JOIN (SELECT feature, y, sum(o) AS c FROM c GROUP BY 1, 2) s USING (feature) JOIN (SELECT feature, sum(o) AS n FROM c GROUP BY 1) t USING (feature) LEFT JOIN c ON c.feature = r.feature AND c.level = r.level AND c.y = s.y), m AS (SELECT feature, CAST(max(n) AS BIGINT) AS n, count(DISTINCT level) AS levels, count(DISTINCT y) AS sides, sum((o - r * c / n) * (o - r * c / n) / (r * c / n)) AS x2, min(r * c / n) AS least FROM g GROUP BY feature) SELECT feature, n, levels, round(x2, 6) AS statistic, (levels - 1) * (sides - 1) AS dof, round(sqrt(x2 / (n * greatest(1, least(levels, sides) - 1))), 6) AS cramers_v, CASE WHEN sqrt(x2 / (n * greatest(1, least(levels, sides) - 1))) < 0.1 THEN 'negligible' WHEN sqrt(x2 / (n * greatest(1, least(levels, sides) - 1))) < 0.3 THEN 'small' WHEN sqrt(x2 / (n * greatest(1, least(levels, sides) - 1))) < 0.5 THEN 'medium' ELSE 'large' END AS effect, round(least, 6) AS least_expected FROM m")
def stat_association(spark, folder):
    return association.association(_flagged(spark, folder), ["formal", "tone", "style"], "label")


@query(f"WITH {_LAB} SELECT level, count_if(label = 0) AS n0, count_if(label = 1) AS n1, round(count_if(label = 1) / count(*), 6) AS rate FROM (SELECT label, CAST(list_has_any({_ASCII.format('query')}, {_quoted(LEXICONS['formal'])}) AS INT) AS level FROM lab) GROUP BY level")
def stat_contingency(spark, folder):
    return association.contingency(_flagged(spark, folder), "formal", "label")


@query()
def stat_tested(spark, folder):
    return association.tested(_flagged(spark, folder), ["formal", "tone", "style", "says_length"], "label")


@query("WITH p AS (SELECT source AS name, 1.0 / count(*) AS p FROM ranking_result WHERE source IS NOT NULL GROUP BY source), r AS (SELECT name, p, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS s FROM p) SELECT name, round(CAST(p AS DOUBLE), 9) AS p, round(CAST(least(1.0, max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS DOUBLE), 9) AS adjusted FROM r")
def stat_holm(spark, folder):
    tests = _t(spark, folder, "ranking_result").where("source is not null").groupBy(F.col("source").alias("name")).agg((F.lit(1.0) / F.count("*")).alias("p"))
    return association.holm(tests, "p", "name").select("name", F.round("p", 9).alias("p"), F.round("adjusted", 9).alias("adjusted"))


_INPUTS = ["similarity", "words", "formal", "tone", "style", "says_length"]


@query()
def ml_logistic(spark, folder):
    return spark.createDataFrame(classify.logistic(_flagged(spark, folder), _INPUTS, "label").table())


@query(f"WITH {_LAB} SELECT row_id, round(s, 6) AS score, CAST(s > 0 AS INT) AS predicted FROM (SELECT row_id, 2.0 - 3.0 * coalesce(cosine_similarity, 0) + 0.01 * {_WORDS.format('query')} AS s FROM lab)")
def ml_scored(spark, folder):
    model = classify.Logistic(["similarity", "words"], np.array([-3.0, 0.01, 2.0]), np.eye(3))
    return model.score(_flagged(spark, folder)).select("row_id", F.round("score", 6).alias("score"), "predicted")


@query()
def ml_cross_validated(spark, folder):
    return classify.cross_validated(sampling.folds(_flagged(spark, folder), "row_id", "label", 10), _INPUTS, "label", 10)


@query()
def ml_out_of_fold(spark, folder):
    rows = sampling.folds(_flagged(spark, folder), "row_id", "label", 5)
    return classify.out_of_fold(rows, _INPUTS, "label", 5).select("row_id", "label", "fold", F.round("score", 6).alias("score"), "predicted")


@query()
def ml_holdout_boosted(spark, folder):
    rows = sampling.holdout(_flagged(spark, folder), "row_id", "label")
    model, assembler = classify.tree(rows.where("not test"), _INPUTS, "label", boosted=True)
    held = model.transform(assembler.transform(rows.where("test"))).withColumn("predicted", F.col("predicted").cast("int"))
    return stats.confusion(held, "label", "predicted")


@query()
def ml_explained(spark, folder):
    rows = _flagged(spark, folder)
    model, _ = classify.tree(rows, _INPUTS, "label", depth=4)
    nodes = spark.sparkContext.broadcast(classify.tree_nodes(model))

    def explain(frames):
        for f in frames:
            x = f[_INPUTS].to_numpy(float)
            s = classify.shap_values(nodes.value, x)
            yield pd.DataFrame({"feature": np.tile(_INPUTS, len(f)), "x": x.ravel(), "shap": s.ravel()})

    long = rows.select(*_INPUTS).mapInPandas(explain, "feature string, x double, shap double")
    return classify.signed_importance(long)


# ---- sources, sinks and reports


@query("SELECT row_id, query FROM query_record WHERE query IS NOT NULL AND query <> ''")
def src_nonempty(spark, folder):
    return _t(spark, folder, "query_record").where("query is not null and query <> ''").select("row_id", "query")


@query("SELECT source, count(*) AS kept, count(DISTINCT id) AS ids FROM query_record WHERE contains(id, '_hard') AND id IN (SELECT id FROM embedded_query) AND source IS NOT NULL GROUP BY source")
def src_hard_with_embedding(spark, folder):
    rows = _t(spark, folder, "query_record").where(F.col("id").contains("_hard") & F.col("source").isNotNull())
    kept = rows.join(_t(spark, folder, "embedded_query").select("id"), "id", "left_semi")
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.countDistinct("id").alias("ids"))


@query("WITH q AS (SELECT min(row_id) AS row_id, id FROM query_record WHERE id IS NOT NULL AND trim(id) <> '' AND trim(paragraph_id) <> '' AND trim(query) <> '' GROUP BY id) SELECT source, count(*) AS skipped FROM q JOIN query_record USING (row_id) WHERE contains(q.id, '_hard') AND q.id NOT IN (SELECT id FROM embedded_query WHERE id IS NOT NULL) GROUP BY source")
def src_skipped_hard(spark, folder):
    """Hard queries of two files, odd and even rows, that an index lacks; blank and repeated ones are taken out before."""
    rows = _t(spark, folder, "query_record").where("id is not null and trim(id) <> '' and trim(paragraph_id) <> '' and trim(query) <> ''")
    first = rows.groupBy("id").agg(F.min_by(F.struct("row_id", "paragraph_id", "query", "source"), "row_id").alias("r")).select("id", "r.*")
    named = first.select("id", "paragraph_id", "query", F.col("source").alias("batch"), "row_id")
    files = {"odd": named.where("row_id % 2 = 1"), "even": named.where("row_id % 2 = 0")}
    hard = indexes.query_records(files, hard_only=True)
    _, skipped = indexes.kept_and_skipped(hard.drop("source").join(named.select("id", F.col("batch").alias("source")), "id"), _t(spark, folder, "embedded_query"))
    return skipped


@query(f"SELECT embedding_model, count(*) AS vectors, count(DISTINCT id) AS ids, round(sum(sqrt(list_dot_product({_D}, {_D}))), 3) AS lengths FROM corpus_embedding WHERE {_OK} GROUP BY embedding_model")
def src_embedding_index(spark, folder):
    rows = _t(spark, folder, "corpus_embedding").where(A.usable(F.col("embedding"), 64))
    return rows.groupBy("embedding_model").agg(F.count("*").alias("vectors"), F.countDistinct("id").alias("ids"), F.round(F.sum(A.norm(F.col("embedding"))), 3).alias("lengths"))


@query("SELECT toxic, count(*) AS n FROM doc_label WHERE toxic IN (0, 1) GROUP BY toxic")
def src_labels(spark, folder):
    return _t(spark, folder, "doc_label").select("toxic").where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT embedding_model, list_avg(list(x)) IS NOT NULL AS any_value, count(*) AS finite FROM (SELECT embedding_model, unnest(embedding) AS x FROM corpus_embedding) WHERE NOT isnan(x) AND NOT isinf(x) GROUP BY embedding_model")
def src_finite_components(spark, folder):
    rows = _t(spark, folder, "corpus_embedding").select("embedding_model", F.explode("embedding").alias("x")).select("embedding_model", T.finite(F.col("x")).alias("x"))
    return rows.where("x is not null").groupBy("embedding_model").agg((F.avg("x").isNotNull()).alias("any_value"), F.count("*").alias("finite"))


@query("SELECT paragraph_id, count(*) AS n FROM query_record WHERE paragraph_id IS NOT NULL GROUP BY paragraph_id HAVING count(*) <> 3")
def val_wrong_sizes(spark, folder):
    return validation.wrong_sizes(_t(spark, folder, "query_record").where("paragraph_id is not null"), "paragraph_id", 3)


@query("WITH r AS (SELECT row_id, rank, coalesce(cosine_similarity, 0) AS p FROM ranking_result), t AS (SELECT * FROM r ORDER BY p DESC, row_id LIMIT (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM r)) SELECT row_id FROM t WHERE rank <= 10")
def inc_representatives(spark, folder):
    rows = _t(spark, folder, "ranking_result").select("row_id", "rank", F.coalesce("cosine_similarity", F.lit(0.0)).alias("p"))
    return incremental.chosen_representatives(rows, "row_id", "p", "rank", 0.2, 10).select("row_id")


@query("WITH r AS (SELECT row_id, CASE WHEN rank > 60 THEN -1 ELSE rank % 7 END AS a, CASE WHEN row_id % 2 = 0 THEN -1 ELSE 3 END AS b, CASE WHEN row_id % 3 = 0 THEN -1 ELSE 5 END AS c FROM ranking_result) SELECT row_id, CAST(CASE WHEN a >= 0 THEN a WHEN b >= 0 THEN b WHEN c >= 0 THEN c ELSE -1 END AS BIGINT) AS final, CASE WHEN a >= 0 THEN 'original_cluster' WHEN b >= 0 THEN 'hdbscan_probability' WHEN c >= 0 THEN 'embedding_similarity' END AS method FROM r")
def inc_reduced_outliers(spark, folder):
    r, i = F.col("rank"), F.col("row_id")
    rows = _t(spark, folder, "ranking_result").select("row_id", F.when(r > 60, -1).otherwise(r % 7).alias("a"), F.when(i % 2 == 0, -1).otherwise(3).alias("b"), F.when(i % 3 == 0, -1).otherwise(5).alias("c"))
    return incremental.reduced_outliers(rows, "a", "b", "c").select("row_id", F.col("final").cast("bigint").alias("final"), "method")


@query("WITH e AS (SELECT vec_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT topic, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(v), lambda e: e[i]))) AS m FROM e WHERE topic >= 0 GROUP BY topic), d AS (SELECT vec_id, c.topic, list_distance(v, m) AS d FROM e, c WHERE e.topic < 0), n AS (SELECT vec_id, arg_min(topic, d) AS topic FROM d GROUP BY vec_id) SELECT e.vec_id, CAST(coalesce(n.topic, e.topic) AS BIGINT) AS topic, e.topic < 0 AS forced FROM e LEFT JOIN n USING (vec_id)")
def cluster_forced(spark, folder):
    rows = _t(spark, folder, "embeddings").select("vec_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("bigint").alias("topic"), F.col("embedding").cast("array<double>").alias("v"))
    return clustering.forced(rows, "vec_id", "topic", "v", 64)


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), d AS (SELECT list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id < b.vec_id) SELECT CAST(floor(round(d / 0.1, 9)) AS BIGINT) AS bin, count(*) AS pairs, round((SELECT avg(d) FROM d), 6) AS mean, round((SELECT stddev_pop(d) FROM d), 6) AS stdev FROM d GROUP BY 1")
def cluster_distance_summary(spark, folder):
    return clustering.distance_summary(_t(spark, folder, "embeddings"), "vec_id", "embedding", 64)


@query("WITH r AS (SELECT row_id, rank % 10 AS cluster, query, coalesce(cosine_similarity, 0) AS p FROM ranking_result WHERE rank IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p DESC, row_id) AS place, count(*) OVER (PARTITION BY cluster) AS size FROM r) SELECT cluster, size, CAST(place AS INT) AS place, query FROM o WHERE place <= 6")
def cluster_by_id(spark, folder):
    rows = _t(spark, folder, "ranking_result").where("rank is not null").select("row_id", (F.col("rank") % 10).alias("cluster"), "query", F.col("cosine_similarity").alias("p"))
    made = clustering.by_cluster(rows, "cluster", "row_id", "query", "p")
    return made.select("cluster", "size", F.posexplode("examples").alias("place", "query")).withColumn("place", F.col("place") + 1)


@query()
def cluster_words(spark, folder):
    rows = _t(spark, folder, "query_record").select(T.clause_terms(F.col("query")).alias("t"))
    counts = Workspace(spark, "words").cut(stats.record_frequency(rows, "t"))
    return clustering.word_clusters(counts, counts.select("term", T.semantic_root(F.col("term")).alias("cluster")))


@query("SELECT lexicon, CASE WHEN odds_ratio IS NULL THEN 'undefined' WHEN isinf(odds_ratio) THEN 'inf' ELSE printf('%.2f', odds_ratio) END AS shown FROM (" + SQL["agg_lexicon_odds"] + ")")
def agg_shown_odds(spark, folder):
    return agg_lexicon_odds(spark, folder).select("lexicon", T.shown_odds(F.col("odds_ratio")).alias("shown"))


@query(_FEATURES.split(",\ns AS")[0] + " SELECT row_id, CAST(len(tok) AS INT) AS tokens, array_to_string(list_transform(tok, lambda x: x.w || '/' || x.pos), ' ') AS shown FROM a")
def feat_json(spark, folder):
    """What the documents say of their tokens, read back from the JSON."""
    documents = features.as_json(_annotated(spark, folder), "row_id", "query", "tokens")
    held = documents.select("row_id", F.from_json("document", f"tokens {features.TOKEN}")["tokens"].alias("t"))
    return held.select("row_id", F.size("t").alias("tokens"), F.array_join(F.transform("t", lambda x: F.concat(x["lower"], F.lit("/"), x["pos"])), " ").alias("shown"))
