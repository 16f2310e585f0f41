"""Byte-pair encoding of a whole corpus with a public vocabulary.

The merges of a piece wait in buckets, one per merge rank, that hold places in a
linked list of its tokens. A hierarchy of bitmaps says which buckets hold
something; the lowest rank is found by three find-first-set steps whatever the
length of the piece, and places whose pair has changed since are skipped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on this kind of machine; a parameter of every function that reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that cuts a text into pieces for this vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of places by rank under a three-level bitmap of 64 bits a word."""

    __slots__ = ("buckets", "leaf", "middle", "top")

    def __init__(self, ranks: int) -> None:
        words = (ranks >> 6) + 1
        self.leaf = [0] * words
        self.middle = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        word = rank >> 6
        self.leaf[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its places from left to right; None when nothing waits."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        part = self.middle[high]
        word = (high << 6) | ((part & -part).bit_length() - 1)
        bits = self.leaf[word]
        rank = (word << 6) | ((bits & -bits).bit_length() - 1)
        bits &= bits - 1
        self.leaf[word] = bits
        if not bits:
            self.middle[high] &= ~(1 << (word & 63))
            if not self.middle[high]:
                self.top &= ~(1 << high)
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


class Encoder:
    """Ids of texts; pieces seen before are kept, up to ``keep`` of them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES, keep: int = 200_000) -> None:
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.keep = keep
        self.known: dict[str, list[int]] = {}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.queue = RankQueue(max(ranks.values()) + 1)

    def _rank(self, a: int, b: int) -> int:
        """The rank of the token that two neighbours make; -1 for none."""
        key = a << 20 | b
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 4 * self.keep:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece; about linear in its length."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue, rank_of = self.queue, self._rank
        for i in range(n - 1):
            rank = rank_of(ids[i], ids[i + 1])
            if rank >= 0:
                queue.push(rank, i)
        while (lowest := queue.pop()) is not None:
            rank, places = lowest
            for at, i in enumerate(places):
                j = after[i]
                if ids[i] < 0 or j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                after[i] = k = after[j]
                lower = False
                if k < n:
                    before[k] = i
                    new = rank_of(rank, ids[k])
                    if new >= 0:
                        queue.push(new, i)
                        lower = new < rank
                h = before[i]
                if h >= 0:
                    new = rank_of(ids[h], rank)
                    if new >= 0:
                        queue.push(new, h)
                        lower |= new < rank
                if lower:  # in some vocabularies a merge makes a pair that goes first
                    for later in places[at + 1 :]:
                        queue.push(rank, later)
                    break
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty or null text."""
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode_corpus(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of every row's whole text; an empty list for an empty or null one.

    The vocabulary has a fixed size and goes to the executors as a broadcast.
    Rows stay where they are read; there is no shuffle. Repeated rows are encoded
    like any other, an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            step = 512  # ids of so many texts are held as Python numbers at once
            for at in range(0, batch.num_rows, step):
                lists = [encoder.encode(t) for t in texts.slice(at, step).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(encoded, f"`{key}` {kind}, ids array<int>")
