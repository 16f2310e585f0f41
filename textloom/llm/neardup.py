"""Near-duplicate texts by segment popcounts.

A text's fingerprint is the bitmap of its distinct words, cut into segments; the
embedding is the number of bits set in each segment. Adding or removing a word
moves one coordinate by one, so the Manhattan distance of two embeddings is a
lower bound of the number of words that only one of the texts has, and a
similarity threshold is a radius under that distance. Two embeddings within the
radius share so much mass that they share a cell of a grid over their rarest
occupied segments. The join runs over those cells, drops pairs whose distance
over coarser segments exceeds the radius, and compares the words of the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.splits import tied_labels
from textloom.llm.words import words
from textloom.plans.materialize import Workspace

#: Segments of the fine embedding; their occupancy table of so many counts is what is broadcast.
SEGMENTS = 1 << 18
#: Segments of the coarse embedding that each record carries.
COARSE = 16
#: Records that a task holds before it packs them by part.
HELD = 1_000_000
#: A cell is an occupied segment pair; cells of more texts are refined by a third and a fourth segment.
HOT_CELL = 512
_DEEPEST = 4


def _hashes(found: set[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    out.sort()
    return out


def fingerprints(df: DataFrame, table: str, key: str, text: str, least: int = 8) -> DataFrame:
    """``tbl, id, seq, bag, n, marks``: a hash of the letters and digits, one of the word set, its size, the word hashes.

    Texts of fewer than ``least`` distinct words and null ones are left out.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, seqs, bags, marks = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(t)
                distinct = set(found)
                if len(distinct) < least or i is None:
                    continue
                h = _hashes(distinct, known)
                ids.append(i)
                seqs.append(xxhash.xxh3_128_digest("".join(found)))
                bags.append(xxhash.xxh3_128_digest(h.tobytes()))
                marks.append(h)
            sizes = np.array([len(h) for h in marks], np.int32)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            flat = np.concatenate(marks).view(np.int64) if marks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([table] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(seqs, pa.binary()), pa.array(bags, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["tbl", "id", "seq", "bag", "n", "marks"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(printed, "tbl string, id bigint, seq binary, bag binary, n int, marks array<bigint>")


def overlap_needed(a: np.ndarray | int, b: np.ndarray | int, threshold: float) -> np.ndarray:
    """The fewest common words of sets of ``a`` and ``b`` words with that similarity."""
    return np.ceil(np.round(threshold / (1 + threshold) * (np.asarray(a) + b), 9)).astype(np.int64)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _occupancy(texts: DataFrame) -> np.ndarray:
    """How many texts occupy each segment: a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENTS, np.int64)
        for batch in batches:
            total += np.bincount((_flat(batch.column(0)) % np.uint64(SEGMENTS)).astype(np.int64), minlength=SEGMENTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["segment", "n"])

    out = np.zeros(SEGMENTS, np.int64)
    counts = texts.select("marks").mapInArrow(counted, "segment int, n bigint").groupBy("segment").agg(F.sum("n").alias("n")).toPandas()
    out[counts["segment"].to_numpy()] = counts["n"].to_numpy()
    return out


#: The columns of a block of records.
_COLUMNS = {"id": np.int64, "s1": np.uint32, "n": np.uint32, "at": np.uint32, "tbl": np.uint8, "salt": np.uint16, "salts": np.uint16, "length": np.uint32, "coarse": np.uint8, "rest": np.uint16}


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    parts = [np.ascontiguousarray(columns[k], dtype=t).tobytes() for k, t in _COLUMNS.items()]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {k: [] for k in _COLUMNS}
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        at = 8 * len(_COLUMNS)
        for size, (k, t) in zip(np.frombuffer(raw[:at], np.int64).tolist(), _COLUMNS.items(), strict=True):
            out[k].append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
            at += size
    return {k: np.concatenate(v) for k, v in out.items()}


def _records(texts: DataFrame, tables: list[str], occupancy: np.ndarray, threshold: float, part_rows: int) -> DataFrame:
    """``part, block``: packed records, one per text and segment that may be a cell's first.

    The occupied segments of a text are put in order of rarity; a segment that k
    words share is k units of mass there. With an overlap of o, two texts share
    one of their first n - o + 1 units, two of their first n - o + 2, and so on.
    A record has the place ``at`` of its first unit in that order, and ``rest``,
    the units after it that can complete a cell. The records of a frequent
    segment are spread over parts by the hash of the second unit.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(occupancy, 2**31 - 1).astype(np.int32))
    parts = max(1, math.ceil(occupancy.sum() * (1.3 - threshold) / part_rows))

    def recorded(batch: pa.RecordBatch, count: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        n = batch.column(2).to_numpy().astype(np.int64)
        rows = len(n)
        flat = _flat(batch.column(3))
        row = np.repeat(np.arange(rows), n)
        segment = (flat % np.uint64(SEGMENTS)).astype(np.int64)
        coarse = np.bincount(row * COARSE + ((flat >> np.uint64(40)) % np.uint64(COARSE)).astype(np.int64), minlength=rows * COARSE)
        coarse = np.minimum(coarse, 255).reshape(rows, COARSE)
        segment = segment[np.lexsort((segment, count[segment], row))]
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        fresh = np.concatenate(([True], (segment[1:] != segment[:-1]) | (row[1:] != row[:-1])))
        same = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0))
        unit = segment * 8 + np.minimum(same, 7)
        budget = n - np.ceil(np.round(threshold * n, 9)).astype(np.int64)
        starts = np.flatnonzero(place <= budget[row])
        owner = row[starts]
        width = np.maximum(np.minimum(budget[owner] + _DEEPEST, n[owner]) - place[starts] - 1, 0)
        salts = np.clip(count[segment[starts]] // max(1, part_rows // 4), 1, 65535)
        # a frequent first segment has one record per salt
        again = np.repeat(np.arange(len(starts)), salts)
        salt = np.arange(len(again)) - (np.cumsum(salts) - salts)[again]
        starts, owner, width, salts = starts[again], owner[again], width[again], salts[again]
        part = (((unit[starts] * 2654435761) >> 20) + salt * 40503) % parts
        tbl = np.array([tables.index(t) for t in batch.column(0).to_pylist()], np.int64)
        ids = batch.column(1).to_numpy()
        offset = np.repeat(starts + 1, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        rest = unit[offset] * 40503 % 65521
        columns = {"id": ids[owner], "s1": unit[starts], "n": n[owner], "at": place[starts], "tbl": tbl[owner], "salt": salt, "salts": salts, "length": width, "coarse": coarse[owner], "rest": rest}
        return part, {k: np.ascontiguousarray(columns[k], dtype=t) for k, t in _COLUMNS.items()}

    def packed(held: list[tuple[np.ndarray, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        """The records held, a block for each part that has any."""
        part = np.concatenate([p for p, _ in held])
        every = {k: np.concatenate([c[k] for _, c in held]) for k in _COLUMNS}
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        length = every["length"].astype(np.int64)
        begin = np.cumsum(length) - length
        blobs = []
        for k in np.split(order, first[1:]):
            w = length[k]
            offset = np.repeat(begin[k], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            blobs.append(_pack({c: every[c][offset] if c == "rest" else every[c][k] for c in _COLUMNS}))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        count = 0
        for batch in batches:
            if batch.num_rows:
                held.append(recorded(batch, shared.value))
                count += len(held[-1][0])
                if count >= HELD:
                    yield packed(held)
                    held, count = [], 0
        if held:
            yield packed(held)

    made = texts.select("tbl", "id", "n", "marks").mapInArrow(built, "part int, block binary")
    return made.repartition(2 * parts, "part").sortWithinPartitions("part")


def _pairs_in_runs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within runs, a bounded number at a time."""
    todo = size * (size - 1) // 2
    at = 0
    while at < len(start):
        upto = at + max(1, int(np.searchsorted(np.cumsum(todo[at:]), 2_000_000, side="right")))
        if upto == at + 1 and todo[at] > 2_000_000:
            s, m = int(start[at]), int(size[at])
            for i in range(0, m, 1024):  # one large run, in blocks of its rows
                for j in range(i, m, 1024):
                    a, b = np.arange(i, min(m, i + 1024)), np.arange(j, min(m, j + 1024))
                    left, right = np.repeat(a, len(b)), np.tile(b, len(a))
                    keep = left < right
                    yield s + left[keep], s + right[keep]
        else:
            s, m = start[at:upto], size[at:upto]
            # every place with all places after it in its run
            place = np.repeat(s, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            last = np.repeat(s + m, m)
            more = last - place - 1
            left = np.repeat(place, more)
            right = left + 1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            yield left, right
        at = upto


def _candidates(records: DataFrame, tables: list[str], threshold: float) -> DataFrame:
    """``tbl, a, b``: pairs of texts that share a cell and lie within the radius; pairs found in two parts come twice."""

    def cells(r: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, at, tbl, rest = r["n"].astype(np.int64), r["at"].astype(np.int64), r["tbl"], r["rest"].astype(np.int64)
        ids, lengths = r["id"], r["length"].astype(np.int64)
        coarse = r["coarse"].reshape(-1, COARSE)
        begin = np.cumsum(lengths) - lengths
        budget = n - np.ceil(np.round(threshold * n, 9)).astype(np.int64)
        own = np.repeat(np.arange(len(ids)), lengths)
        last = np.arange(len(rest)) - begin[own]
        # cells of two units: the second among the first n - o + 2
        ok = (at[own] + last <= budget[own]) & (rest % r["salts"][own] == r["salt"][own])
        own, last = own[ok], last[ok]
        parent = (tbl[own].astype(np.int64) << 32) | r["s1"][own]
        level = 2
        while len(own):
            key = parent * np.int64(6364136223846793005) + (rest[begin[own] + last] + 1) * np.int64(1442695040888963407)
            order = np.argsort(key, kind="stable")
            key, own, last = key[order], own[order], last[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(start, len(key)))
            hot = (size > HOT_CELL) & (level < _DEEPEST)
            few = (size > 1) & ~hot
            for left, right in _pairs_in_runs(start[few], size[few]):
                a, b = own[left], own[right]
                need = overlap_needed(n[a], n[b], threshold)
                # the overlap has to fit, and to leave room for the place of the cell's last unit in both texts
                keep = (need <= np.minimum(n[a], n[b])) & (at[a] + last[left] + 2 <= n[a] - need + level) & (at[b] + last[right] + 2 <= n[b] - need + level)
                keep &= (tbl[a] == tbl[b]) & (ids[a] != ids[b])
                a, b, radius = a[keep], b[keep], (n[a] + n[b] - 2 * need)[keep]
                near = np.abs(coarse[a].astype(np.int16) - coarse[b]).sum(1) <= radius
                yield a[near], b[near]
            # a hot cell goes on as finer cells with the units after its last
            inside = np.repeat(hot, size)
            parent, own, last = key[inside], own[inside], last[inside]
            more = np.maximum(np.minimum(lengths[own], budget[own] + level - at[own]) - last - 1, 0)
            last = np.repeat(last + 1, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            own, parent = np.repeat(own, more), np.repeat(parent, more)
            level += 1

    kind = np.dtype([("t", "u1"), ("a", "<i8"), ("b", "<i8")])

    def one_part(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        r = _unpack(blobs)
        held: list[np.ndarray] = []
        count = 0
        with np.errstate(over="ignore"):
            for a, b in cells(r):
                if len(a):
                    pair = np.empty(len(a), kind)
                    pair["t"], pair["a"], pair["b"] = r["tbl"][a], np.minimum(r["id"][a], r["id"][b]), np.maximum(r["id"][a], r["id"][b])
                    held.append(pair)
                    count += len(pair)
                if count > 4_000_000:
                    held = [np.unique(np.concatenate(held))]
                    count = len(held[0]) // 2
        pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, kind)
        for i in range(0, len(pairs), 100_000):
            p = pairs[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([tables[t] for t in p["t"].tolist()], pa.string()), pa.array(np.ascontiguousarray(p["a"])), pa.array(np.ascontiguousarray(p["b"]))], names=["tbl", "a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = -1, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True):
                if p != part and blobs:
                    yield from one_part(blobs)
                    blobs = []
                part = p
                blobs.append(blob)
        if blobs:
            yield from one_part(blobs)

    return records.mapInArrow(joined, "tbl string, a bigint, b bigint")


def near_sets(texts: DataFrame, threshold: float, workspace: Workspace, part_rows: int = 400_000) -> DataFrame:
    """``tbl, a, b``: pairs of distinct word sets, by their representatives, of at least that similarity.

    ``texts`` has one row ``tbl, id, n, marks`` per distinct word set.
    """
    occupancy = _occupancy(texts)
    tables = sorted(r["tbl"] for r in texts.select("tbl").distinct().collect())
    pairs = workspace.cut(_candidates(_records(texts, tables, occupancy, threshold, part_rows), tables, threshold).distinct())
    ends = pairs.select("tbl", F.col("a").alias("id")).union(pairs.select("tbl", F.col("b").alias("id"))).distinct()
    held = texts.select("tbl", "id", "n", "marks").join(ends, ["tbl", "id"], "left_semi")
    both = pairs.join(held.select("tbl", F.col("id").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma")), ["tbl", "a"])
    both = both.join(held.select("tbl", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb")), ["tbl", "b"])
    common = F.size(F.array_intersect("ma", "mb"))
    return both.where(common >= F.lit(threshold) * (F.col("na") + F.col("nb") - common) - 1e-9).select("tbl", "a", "b")


def near_duplicates(prints: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``tbl, a_id, b_id``: all pairs of rows of one table of at least that similarity that aren't copies.

    ``prints`` comes from ``fingerprints``. Similarity is common over all distinct
    words of both texts; copies have the same letters and digits in order. The
    join is over distinct word sets; rows with the same set, and the rows of
    joined sets, come back by joins on the set's hash, so a set of many copies
    is one vertex of it. Nothing is capped: cells of any size are searched, the
    frequent ones by finer cells. An empty table gives no rows.
    """
    workspace = Workspace(prints.sparkSession, "neardup")
    held = workspace.cut(prints)
    sets = held.groupBy("tbl", "bag").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks"))
    sets = workspace.cut(sets)
    near = workspace.cut(near_sets(sets, threshold, workspace))
    # classes of rows with equal letters and digits within a set
    member = held.select("tbl", "bag", "seq", "id")
    ends = near.select("tbl", F.col("a").alias("id")).union(near.select("tbl", F.col("b").alias("id"))).distinct()
    bags = sets.select("tbl", "id", "bag").join(ends, ["tbl", "id"], "left_semi")
    linked = member.join(bags.select("tbl", "bag", F.col("id").alias("set")), ["tbl", "bag"]).select("tbl", "set", "seq", "id")
    across = near.join(linked.select("tbl", F.col("set").alias("a"), F.col("seq").alias("seq_x"), F.col("id").alias("x")), ["tbl", "a"])
    across = across.join(linked.select("tbl", F.col("set").alias("b"), F.col("seq").alias("seq_y"), F.col("id").alias("y")), ["tbl", "b"])
    across = across.where("seq_x <> seq_y").select("tbl", "x", "y")
    classes = member.groupBy("tbl", "bag", "seq").agg(F.count("*").alias("rows"))
    mixed = classes.groupBy("tbl", "bag").agg(F.count("*").alias("forms")).where("forms > 1").select("tbl", "bag")
    reordered = workspace.cut(member.join(mixed, ["tbl", "bag"], "left_semi"))
    other = reordered.select("tbl", "bag", F.col("seq").alias("seq_y"), F.col("id").alias("y"))
    within = reordered.join(other, ["tbl", "bag"]).where("id < y and seq <> seq_y").select("tbl", F.col("id").alias("x"), "y")
    return across.union(within).select("tbl", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))


def near_groups(prints: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``tbl, id, group_id, links``: every fingerprinted row with its group, and the number of other word sets its own is linked to.

    Rows are in one group if their word sets are equal or a chain of sets of at
    least that similarity lies between them; ``group_id`` is the smallest id of the
    group, a row without any has its own. Only pairs of sets are formed: rows come
    in by the hash of their set, so copies, however many, add a row each. An
    empty table gives no rows.
    """
    workspace = Workspace(prints.sparkSession, "groups")
    held = workspace.cut(prints.select("tbl", "id", "bag", "n", "marks"))
    sets = workspace.cut(held.groupBy("tbl", "bag").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("marks").alias("marks")))
    near = workspace.cut(near_sets(sets, threshold, workspace))
    vertex = lambda c: F.concat_ws(":", "tbl", F.col(c).cast("string"))
    ends = near.select("tbl", vertex("a").alias("a"), vertex("b").alias("b"))
    labels = tied_labels(ends.select("a", "b"), workspace)
    degree = ends.select("a").union(ends.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    marked = sets.select("tbl", "bag", "id", vertex("id").alias("v"))
    marked = marked.join(labels.select(F.col("node").alias("v"), "label"), "v", "left").join(degree.select(F.col("a").alias("v"), "links"), "v", "left")
    marked = workspace.cut(marked.select("tbl", "bag", "id", F.coalesce("label", "v").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    least = marked.groupBy("label").agg(F.min("id").alias("group_id"))
    classes = marked.join(least, "label").select("tbl", "bag", "group_id", "links")
    return held.select("tbl", "id", "bag").join(classes, ["tbl", "bag"]).select("tbl", "id", "group_id", "links")
