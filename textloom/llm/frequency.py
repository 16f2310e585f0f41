"""Occurrences and record counts of every term, from suffix arrays with common-prefix intervals."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.suffixes import common_prefixes, suffix_array
from textloom.llm.words import shards, words

#: Words that suffixes have in common where they are brought together; shorter n-grams are counted by ``term_counts``.
HEAD = 3
#: Characters of text, about, whose suffixes are one group.
GROUP = 1_200_000


def intervals(texts: list[str | None], max_n: int) -> tuple[list[str], list[int], list[int], list[int]]:
    """``term, n, occurrences, records`` of all n-grams of up to ``max_n`` words in a few records.

    All suffixes that share their first n words are one interval of the suffix
    array. Its length is the number of occurrences; with the interval's suffixes
    in record order, each neighbour from the same record is subtracted for the
    number of records. No n-gram crosses the end of its record.
    """
    ids: dict[str, int] = {}
    tokens: list[int] = []
    ends: list[int] = []
    for text in texts:
        found = words(text)
        if found:
            tokens.extend([ids.setdefault(w, len(ids)) for w in found])
            tokens.append(-1)
            ends.append(len(tokens) - 1)
    if not tokens:
        return [], [], [], []
    seq = np.array(tokens, np.int64)
    end = np.array(ends, np.int64)
    seq[end] = len(ids) + np.arange(len(end))
    record = np.searchsorted(end, np.arange(len(seq)))
    left = end[record] - np.arange(len(seq))
    order, ranks = suffix_array(seq, max_n)
    lcp = common_prefixes(order, ranks)
    vocabulary = list(ids)
    terms, sizes, occurrences, records = [], [], [], []
    for n in range(1, max_n + 1):
        group = np.cumsum(lcp < n) - 1
        long_enough = left[order] >= n
        group, where = group[long_enough], order[long_enough]
        if not len(where):
            break
        by_record = np.lexsort((record[where], group))
        group, docs = group[by_record], record[where][by_record]
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        again = np.concatenate(([0], (group[1:] == group[:-1]) & (docs[1:] == docs[:-1]))).astype(np.int64)
        cf = np.diff(np.append(start, len(group)))
        df = cf - np.add.reduceat(again, start)
        first = where[by_record][start]
        if n == 1:
            terms += [vocabulary[i] for i in seq[first].tolist()]
        else:
            terms += [" ".join([vocabulary[i] for i in row]) for row in seq[first[:, None] + np.arange(n)].tolist()]
        sizes += [n] * len(start)
        occurrences += cf.tolist()
        records += df.tolist()
    return terms, sizes, occurrences, records


def term_counts(df: DataFrame, text: str, max_n: int = 1) -> DataFrame:
    """``term, n, occurrences, records`` over all rows of ``df``.

    Null, empty and letterless texts have no terms; an empty table gives no
    rows. A batch is cut into shards of a bounded number of characters, each with its own suffix array, so counts
    are combined before the shuffle and a hot term crosses it once per shard.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in shards(batch.column(0).to_pylist()):
                terms, sizes, occurrences, records = intervals(texts, max_n)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(sizes, pa.int32()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], names=["term", "n", "occurrences", "records"])

    parts = df.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(counted, "term string, n int, occurrences bigint, records bigint")
    return parts.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, text: str, max_n: int = 1, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``term_counts`` with ``mark``: ``rare`` in at most ``rare`` rows, ``common`` in more than that share of all rows, else null.

    All rows of ``df`` count in the share, those with a null text too.
    """
    total = df.count()
    counts = term_counts(df, text, max_n)
    return counts.withColumn("mark", F.when(F.col("records") > common * total, "common").when(F.col("records") <= rare, "rare"))


def suffix_classes(suffixes: list[str], records: list[int], head: int = HEAD) -> Iterator[tuple[str, int, int, int, int]]:
    """``term, shortest, longest, occurrences, records`` from sorted suffixes: n-grams of ``head`` words or more.

    An interval of suffixes sharing ``longest`` words stands for its prefixes down
    to one word more than the interval around it shares; a suffix by itself for
    what it shares with none. A suffix whose record was seen before is subtracted
    at the innermost open interval that holds both, and so at those around it.
    """
    stack, starts = [[0, 0, 0]], [0]  # words shared, first place, neighbours of one record
    seen: dict[int, int] = {}
    before: list[str] = []
    last = 0
    for i in range(len(suffixes) + 1):
        own = suffixes[i].split(" ") if i < len(suffixes) else []
        shared = 0
        for a, b in zip(before, own, strict=False):
            if a != b:
                break
            shared += 1
        least = max(last, shared, head - 1)
        if len(before) > least:
            yield " ".join(before), least + 1, len(before), 1, 1
        start, again = max(i - 1, 0), 0
        while stack[-1][0] > shared:
            longest, start, inner = stack.pop()
            starts.pop()
            again += inner
            least = max(stack[-1][0], shared, head - 1)
            if longest > least:
                yield " ".join(before[:longest]), least + 1, longest, i - start, i - start - again
        if stack[-1][0] < shared:
            stack.append([shared, start, again])
            starts.append(start)
        else:
            stack[-1][2] += again
        if i < len(suffixes):
            j = seen.get(records[i])
            if j is not None:
                stack[bisect_right(starts, j) - 1][2] += 1
            seen[records[i]] = i
        before, last = own, shared


def ngram_classes(df: DataFrame, text: str, head: int = HEAD, group: int = GROUP) -> DataFrame:
    """``term, shortest, longest, occurrences, records``: all n-grams of any length, those with the same places as one row.

    A row stands for the first ``shortest`` to ``longest`` words of ``term``: every
    n-gram of the table is in exactly one row. Below ``head`` words each has its
    own. Longer ones come from suffixes brought together by their first ``head``
    words, so what is shuffled grows with the square of a record's words, and a
    group has to hold all suffixes of its most frequent head.
    """
    rows = df.select(F.monotonically_increasing_id().alias("record"), F.col(text).cast("string").alias("text")).where("text is not null")
    groups = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // group))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, record, suffix = [], [], []
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(t)
                whole, at = " ".join(found), 0
                for i in range(len(found) - head + 1):
                    part.append(crc32(" ".join(found[i : i + head]).encode()) % groups)
                    record.append(r)
                    suffix.append(whole[at:])
                    at += len(found[i]) + 1
                    if len(suffix) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(record, pa.int64()), pa.array(suffix, pa.string())], names=["part", "record", "suffix"])
                        part, record, suffix = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(record, pa.int64()), pa.array(suffix, pa.string())], names=["part", "record", "suffix"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pc.sort_indices(table, sort_keys=[("suffix", "ascending"), ("record", "ascending")]))
        out: list[tuple[str, int, int, int, int]] = []
        names, kinds = ["term", "shortest", "longest", "occurrences", "records"], [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for row in suffix_classes(table.column("suffix").to_pylist(), table.column("record").to_pylist(), head):
            out.append(row)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "term string, shortest int, longest int, occurrences bigint, records bigint"
    long = rows.mapInArrow(cut, "part int, record bigint, suffix string").groupBy("part").applyInArrow(counted, schema)
    short = term_counts(df, text, head - 1).select("term", F.col("n").alias("shortest"), F.col("n").alias("longest"), "occurrences", "records")
    return short.unionByName(long)


def marked_classes(df: DataFrame, text: str, rare: int = 2, common: float = 0.1) -> DataFrame:
    """``ngram_classes`` with the ``mark`` of ``marked_terms``, which holds for every n-gram of a row."""
    total = df.count()
    return ngram_classes(df, text).withColumn("mark", F.when(F.col("records") > common * total, "common").when(F.col("records") <= rare, "rare"))
