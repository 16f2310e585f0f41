"""Tokenizers, n-grams and text measures as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.lexicons import FORM_WORDS, QUERY_STOPWORDS, TOPIC_STOPWORDS

#: The patterns of the three tokenizers.
ASCII_TOKEN = "[a-z0-9]+(?:['’-][a-z0-9]+)*"
UNICODE_TOKEN = "[\\p{L}\\p{N}]+(?:['’\\-][\\p{L}\\p{N}]+)*"
STYLE_TOKEN = "[\\p{L}]+(?:['’][\\p{L}]+)*|,"
TOPIC_TOKEN = "[a-z0-9']+"
#: Suffixes the crude stemmer takes off, the first that fits.
STEM_SUFFIXES = ("ing", "ed", "es", "s")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it, within its lambdas too."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def ascii_tokens(text: Column) -> Column:
    """Lower-case ASCII words with inner apostrophes and hyphens; none for null."""
    return _all(F.lower(text), ASCII_TOKEN)


def unicode_tokens(text: Column) -> Column:
    """Words of any script with inner apostrophes and hyphens, case-folded."""
    return F.transform(_all(text, UNICODE_TOKEN), folded)


#: Letters whose case folding isn't their lower case: to one letter, and to several.
_FOLDS = {c: c.casefold() for c in map(chr, range(0x80, 0x1F000)) if c.lower() == c != c.casefold()}
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1}


def folded(text: Column) -> Column:
    """The text in folded case: lower case, and the letters that have several lower forms or stand for several as one form."""
    low = F.lower(text)
    one = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    every = one
    for c, f in _SEVERAL.items():
        every = F.replace(every, F.lit(c), F.lit(f))
    return F.when(low.rlike("^[\\x00-\\x7f]*$"), low).when(low.rlike("[" + "".join(_SEVERAL) + "]"), every).otherwise(one)


def style_tokens(text: Column) -> Column:
    """Words of letters with inner apostrophes, and commas, lower-cased."""
    return F.transform(_all(text, STYLE_TOKEN), F.lower)


def plain_words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.size(plain_words(text))


def crude_stem(word: Column) -> Column:
    """The word without the first of a few suffixes that it ends with, if three letters more are left."""
    out = word
    for suffix in reversed(STEM_SUFFIXES):
        long_enough = F.length(word) > len(suffix) + 3
        out = F.when(word.endswith(suffix) & long_enough, F.substring(word, 1, F.length(word) - len(suffix))).otherwise(out)
    return out


def topic_words(text: Column, stopwords: Iterable[str] = (*TOPIC_STOPWORDS, *FORM_WORDS)) -> Column:
    """Distinct stemmed words of more than two letters that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(F.array_except(_all(F.lower(text), TOPIC_TOKEN), stop), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(kept, crude_stem))


def content_words(tokens: Column, stopwords: Iterable[str] = QUERY_STOPWORDS) -> Column:
    """Tokens that aren't stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens, lambda w: ~F.array_contains(stop, w))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks, repeats included; none where there are fewer."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, each).otherwise(F.array().cast("array<string>"))

    return bound(tokens, runs)


def ngrams_between(tokens: Column, low: int, high: int) -> Column:
    """Runs of ``low`` to ``high`` tokens, empty tokens being dropped first."""
    return bound(F.filter(tokens, lambda x: x != ""), lambda kept: F.flatten(F.array(*[ngrams(kept, n) for n in range(low, high + 1)])))


def opening(tokens: Column, k: int) -> Column:
    """The first ``k`` tokens as one string; null where there are fewer."""
    return bound(tokens, lambda t: F.when(F.size(t) >= k, F.array_join(F.slice(t, 1, k), " ")))


def first_token(tokens: Column) -> Column:
    return F.try_element_at(tokens, F.lit(1))


def id_prefix(key: Column) -> Column:
    """What stands before the first dash; ``other`` where there is none or nothing before it."""
    return F.when(F.instr(key, "-") > 1, F.substring_index(key, "-", 1)).otherwise("other")


def with_suffix(key: Column, suffix: str) -> Column:
    """The key ending in ``suffix``, which is appended unless it is there."""
    return F.when(key.endswith(suffix), key).otherwise(F.concat(key, F.lit(suffix)))


def has_word(text: Column, word: str) -> Column:
    """Whether the text has the word as a whole, in any letter case; false for null."""
    return F.coalesce(text, F.lit("")).rlike(f"(?i)(^|[^\\p{{L}}\\p{{N}}_]){word}([^\\p{{L}}\\p{{N}}_]|$)")


def says_length(text: Column) -> Column:
    """1 for a text that asks for a number of words, or that is shorter than five words and names a short or long text."""
    t = F.coalesce(text, F.lit(""))
    edge, end = "(^|[^\\p{L}\\p{N}_])", "([^\\p{L}\\p{N}_]|$)"
    number = t.rlike(f"(?i){edge}[0-9]+\\s+words{end}")
    named = (word_count(t) < 5) & t.rlike(f"(?i){edge}(short|long)\\s+text{end}")
    return (number | named).cast("int")


def has_any(tokens: Column, lexicon: Iterable[str]) -> Column:
    """Whether one of the tokens is in a lexicon."""
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in sorted(set(lexicon))]))


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{{NAME}}`` replaced by columns, one name after the other; null values as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def finite(x: Column) -> Column:
    """The number, or null for NaN and infinity."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def feature_label(name: Column) -> Column:
    """A feature's name for display: ``=`` as ``:``, without its trailing family number."""
    return F.regexp_replace(F.replace(name, F.lit("="), F.lit(":")), r"_[0-9]+$", "")


def effect_size(v: Column) -> Column:
    """The customary words for Cramér's V."""
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


#: Words that end like a verb form but aren't one.
NOT_ACTIONS = ("something", "nothing", "anything", "everything", "thing", "king", "string")
_PHRASE = r"(?:is|are|was|were)\s+[a-z]+ing\b|(?:a|an)\s+[a-z0-9'-]+(?:\s+(?!(?:of|then|and|or|in|on|with|to|for|from|by|is|are|that|which|a|an|the)\b)[a-z0-9'-]+)?|[a-z0-9]+(?:['-][a-z0-9]+)*"


def clause_terms(text: Column, stopwords: Iterable[str] = (*QUERY_STOPWORDS, "text")) -> Column:
    """Distinct terms: ``a long appeal`` and ``is starting`` as units, other words alone, stopwords left out."""
    found = _all(F.lower(text), _PHRASE)
    stop = F.array(*[F.lit(w) for w in stopwords])
    actions = F.array(*[F.lit(w) for w in NOT_ACTIONS])
    last = (lambda t: F.element_at(F.split(t, r"\s+"), -1))
    # a form of "be" before a word that isn't an action leaves the word alone
    split = F.transform(found, lambda t: F.when(t.rlike(r"^(is|are|was|were)\s") & F.array_contains(actions, last(t)), last(t)).otherwise(F.regexp_replace(t, r"\s+", " ")))
    return F.array_distinct(F.filter(split, lambda t: ~F.array_contains(stop, t)))


def semantic_root(term: Column) -> Column:
    """``starts``, ``starting``, ``is starting`` as ``start``; doubled consonants before ``ing`` are taken back to one."""
    bare = F.regexp_replace(F.lower(term), r"^(is|are|was|were)\s+", "")
    ing = F.regexp_replace(F.regexp_replace(bare, r"ing$", ""), r"([bdgmnprt])\1$", "$1")
    return F.when((F.length(bare) > 5) & bare.endswith("ing"), ing).when((F.length(bare) > 3) & bare.endswith("s") & ~bare.endswith("ss"), F.regexp_replace(bare, "s$", "")).otherwise(bare)


def shown_p(p: Column) -> Column:
    """A p-value for people: three digits, or below the smallest shown."""
    return F.when(p < 0.001, "< 0.001").otherwise(F.format_string("%.3f", p.cast("double")))


def shown_odds(o: Column) -> Column:
    """An odds ratio for people: two digits, ``inf``, or ``undefined`` for null."""
    return F.when(o.isNull(), "undefined").when(o == float("inf"), "inf").otherwise(F.format_string("%.2f", o.cast("double")))


def parsed_items(answer: Column, wanted: int) -> Column:
    """The strings of a JSON array that has exactly ``wanted`` different ones that aren't blank; null for any other text."""
    items = F.transform(F.from_json(answer, "array<string>"), lambda x: F.trim(x))
    good = (F.size(items) == wanted) & (F.size(F.array_distinct(items)) == wanted) & ~F.exists(items, lambda x: x.isNull() | (x == ""))
    return F.when(F.coalesce(good, F.lit(False)), items)
