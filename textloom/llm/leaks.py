"""Evaluation texts in a corpus: every test suffix is looked up in suffix arrays over the corpus's shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.suffixes import search, suffix_array
from textloom.llm.words import shards, words


class Items:
    """The suffixes of a block of test items as one table of patterns."""

    def __init__(self, items: list[tuple[int, str | None]], run: int) -> None:
        self.run = run
        self.vocabulary: dict[str, int] = {}
        self.texts: list[tuple[int, np.ndarray]] = []
        seen: dict[bytes, int] = {}
        patterns, lengths = [], []
        self.owners: list[list[tuple[int, int]]] = []
        for key, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if not len(ids):
                continue
            at = len(self.texts)
            self.texts.append((key, ids))
            m = min(run, len(ids))
            for i in range(len(ids) - m + 1):
                part = ids[i : i + m]
                name = part.tobytes()
                if name not in seen:
                    seen[name] = len(patterns)
                    patterns.append(np.pad(part, (0, run - m), constant_values=-2))
                    lengths.append(m)
                    self.owners.append([])
                self.owners[seen[name]].append((at, i))
        self.patterns = np.array(patterns, np.int64).reshape(-1, run)
        self.lengths = np.array(lengths, np.int64)
        self.least = int(self.lengths.min()) if len(lengths) else 0

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """``(row, item, start word, words)`` of the longest match of every item in every text of a shard."""
        if not len(self.patterns):
            return []
        get = self.vocabulary.get
        tokens: list[int] = []
        ends: list[int] = []
        for text in texts:
            tokens.extend([get(w, -1) for w in words(text)])
            tokens.append(-1)
            ends.append(len(tokens) - 1)
        seq = np.array(tokens, np.int64)
        # words that no item has are unlike any other; only runs of known words can hold a match
        unknown = np.flatnonzero(seq < 0)
        left = unknown[np.searchsorted(unknown, np.arange(len(seq)))] - np.arange(len(seq))
        kept = left >= self.least
        if not kept.any():
            return []
        inside = np.zeros(len(seq) + 1, np.int64)
        np.add.at(inside, np.flatnonzero(kept), 1)
        np.add.at(inside, np.flatnonzero(kept) + left[kept], -1)
        covered = np.cumsum(inside[:-1]) > 0
        covered[np.flatnonzero(kept) + left[kept]] = True  # each run keeps the word that ends it
        place = np.flatnonzero(covered)
        short = seq[place]
        short[short < 0] = len(self.vocabulary) + np.arange((short < 0).sum())
        order, _ = suffix_array(short, self.run)
        low, high = search(short, order, self.patterns, self.lengths)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        end = np.array(ends, np.int64)
        for k in np.flatnonzero(high > low):
            where = order[low[k] : high[k]]
            docs = np.searchsorted(end, place[where])
            for at, i in self.owners[k]:
                ids = self.texts[at][1]
                for p, d in zip(where.tolist(), docs.tolist(), strict=True):
                    n = int(self.lengths[k])
                    # only the leftmost window of a longer match is extended
                    if i and p and short[p - 1] == ids[i - 1] and (d, at) in best:
                        continue
                    while i + n < len(ids) and p + n < len(short) and short[p + n] == ids[i + n]:
                        n += 1
                    if n > best.get((d, at), (0, 0))[0]:
                        start = int(place[p] - (end[d - 1] + 1 if d else 0))
                        best[d, at] = (n, start)
        return [(d, self.texts[at][0], start, n) for (d, at), (n, start) in best.items()]


def leaked(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, block_bytes: int = 32 << 20) -> DataFrame:
    """``key, item_key, start_word, words``: each document and item with ``run`` consecutive words in common, once.

    An item of fewer than ``run`` words has to stand in the document whole;
    items and documents without words match nothing; equal items are each
    reported. ``words`` is the longest verbatim match and ``start_word`` its
    place in the document. Items go to the tasks in blocks of at most
    ``block_bytes`` of text, one pass over the corpus per block; the corpus
    itself isn't shuffled. Whole texts are searched, of whatever length.
    """
    chosen = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    held = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-held // block_bytes))
    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    out = None
    for block in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        shared = documents.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in part])

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = Items(shared.value, run)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                hits = [(first + d, i, s, n) for first, texts in shards(batch.column(1).to_pylist()) for d, i, s, n in table.find(texts)]
                columns = [[keys[d] for d, _, _, _ in hits], [i for _, i, _, _ in hits], [s for _, _, s, _ in hits], [n for _, _, _, n in hits]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "item", "start_word", "words"])

        one = rows.mapInArrow(found, "key bigint, item bigint, start_word bigint, words bigint")
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "start_word", "words")
