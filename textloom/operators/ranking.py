"""Exact cosine ranks of expected documents, and nearest vectors, over blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.materialize import Workspace

#: Queries that are sent to the tasks at once: of 64 double components, 2 MB.
BLOCK = 4_096
#: Decimals to which scores are compared, so that the order of a sum can't break a tie.
DECIMALS = 9


def unit_rows(df: DataFrame, key: str, vector: str, dim: int, *keep: str) -> DataFrame:
    """``key, keep..., unit``: vectors of ``dim`` finite components that aren't all zero, in length one, as packed doubles."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            lengths = pc.fill_null(pc.list_value_length(batch.column(last)), -1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(lengths == dim))
            x = batch.column(last).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1) if len(x) else np.zeros(0, bool)
            x = x[ok]
            x = x / np.sqrt((x * x).sum(1))[:, None]
            data = x.tobytes()
            columns = [c.filter(pa.array(ok)) for c in batch.columns[:last]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([data[i : i + 8 * dim] for i in range(0, len(data), 8 * dim)], pa.binary())], names=[*batch.schema.names[:last], "unit"])

    rows = df.select(key, *keep, F.col(vector).cast("array<double>").alias("_v")).where("_v is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(scaled, f"{fields}, unit binary")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def _blocks(queries: DataFrame, key: str) -> Iterator[list]:
    """The rows of ``queries`` in blocks of about ``BLOCK``; each comes to the driver on its own, when the one before is done with."""
    n = max(1, -(-queries.count() // BLOCK))
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).collect()
        if rows:
            yield rows


def rank_expected(queries: DataFrame, corpus: DataFrame, dim: int) -> DataFrame:
    """``query_id, target, rank, cosine_similarity`` of each query's expected document among all documents.

    ``queries`` has ``query_id, target, unit`` and ``corpus`` ``doc_id, pos, unit``
    with unique ``doc_id``; a query whose target isn't in the corpus is left out.
    The rank is one more than the number of documents with a higher score or the
    same score at an earlier ``pos``. It is counted, not sorted: every task
    counts in its documents for a block of queries, and the counts are summed.
    """
    workspace = Workspace(queries.sparkSession, "rank")
    corpus = workspace.cut(corpus.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "unit"))
    targets = corpus.select(F.col("doc_id").alias("target"), F.col("pos").alias("target_pos"), F.col("unit").alias("target_unit"))
    asked = workspace.cut(queries.select("query_id", "target", "unit").join(targets, "target"))
    counted = None
    for rows in _blocks(asked, "query_id"):
        q, t = _matrix([bytes(r["unit"]) for r in rows], dim), _matrix([bytes(r["target_unit"]) for r in rows], dim)
        own = np.round((q * t).sum(1), DECIMALS)
        shared = queries.sparkSession.sparkContext.broadcast((q, own, np.array([r["target_pos"] for r in rows], np.int64), [r["query_id"] for r in rows]))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, own, pos, _ = shared.value
            ahead = np.zeros(len(q), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x, at = _matrix(batch.column(1).to_pylist(), dim), batch.column(0).to_numpy()
                    for i in range(0, len(x), 1024):
                        s = np.round(q @ x[i : i + 1024].T, DECIMALS)
                        ahead += ((s > own[:, None]) | ((s == own[:, None]) & (at[None, i : i + 1024] < pos[:, None]))).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), pa.array(ahead)], names=["i", "ahead"])

        made = corpus.select("pos", "unit").mapInArrow(count, "i int, ahead bigint").groupBy("i").agg(F.sum("ahead").alias("ahead"))
        names = queries.sparkSession.createDataFrame([(i, r["query_id"], r["target"], float(s)) for i, (r, s) in enumerate(zip(rows, own.tolist(), strict=True))], asked.select(F.lit(0).alias("i"), "query_id", "target", F.lit(0.0).alias("cosine_similarity")).schema)
        part = workspace.cut(names.join(made, "i").select("query_id", "target", (F.col("ahead") + 1).alias("rank"), "cosine_similarity"))
        shared.destroy()
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return asked.select("query_id", "target", F.lit(1).cast("bigint").alias("rank"), F.lit(0.0).alias("cosine_similarity"))
    return counted


def nearest_to(queries: DataFrame, rows: DataFrame, dim: int, k: int, metric: str = "euclidean") -> DataFrame:
    """``src, dst, distance, place``: the ``k`` closest rows of each query row, itself left out, ties by ``dst``.

    Both have ``id`` and ``vec``, packed doubles of ``dim`` components; ``metric``
    is ``euclidean``, ``cosine`` or ``manhattan`` (the mean absolute difference).
    Queries go to the rows in blocks and every task keeps its ``k`` closest, so
    that ``k`` rows per query and task are all that is shuffled. For ``manhattan``
    a product of roots tells which rows can't be among the closest; the others
    are measured.
    """
    if metric == "manhattan":
        span = _span(rows, dim)
    parts = None
    workspace = Workspace(rows.sparkSession, "nearest")
    order = Window.partitionBy("src").orderBy("distance", "dst")
    for held in _blocks(queries.select("id", "vec"), "id"):
        shared = rows.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in held], np.int64), _matrix([bytes(r["vec"]) for r in held], dim)))

        def closest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                there, x = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), dim)
                for i in range(0, len(ids) if len(x) else 0, 256):
                    a = q[i : i + 256]
                    if metric == "cosine":
                        scale = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((x * x).sum(1))
                        d = np.clip(1 - np.divide(a @ x.T, scale, out=np.zeros((len(a), len(x))), where=scale > 0), 0, 2)
                    else:
                        d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (x * x).sum(1) - 2 * a @ x.T, 0))
                    d = np.round(d, DECIMALS)
                    d[ids[i : i + 256, None] == there] = np.inf
                    order = np.lexsort((np.broadcast_to(there, d.shape), d), axis=1)[:, :k] if d.shape[1] <= 4 * k else _first(d, there, k)
                    value = np.take_along_axis(d, order, 1)
                    keep = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + 256], keep.sum(1))), pa.array(there[order[keep]]), pa.array(value[keep])], names=["src", "dst", "distance"])

        def closest_roots(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from _closest_manhattan(batches, *shared.value, *span, k)

        part = rows.select(F.col("id").cast("bigint").alias("id"), "vec").mapInArrow(closest_roots if metric == "manhattan" else closest, "src bigint, dst bigint, distance double")
        part = workspace.cut(part.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return rows.sparkSession.createDataFrame([], "src bigint, dst bigint, distance double, place int")
    return parts


def _span(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest of each component over the finite vectors; zeros where there are none."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), dim)
            x = x[np.isfinite(x).all(1)]
            low, high = np.minimum(low, x.min(0, initial=np.inf)), np.maximum(high, x.max(0, initial=-np.inf))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array([low.tobytes()], pa.binary()), pa.array([high.tobytes()], pa.binary())], names=["low", "high"])

    held = rows.select("vec").mapInArrow(ends, "low binary, high binary").collect()  # a row a task
    if not held:
        return np.zeros(dim), np.zeros(dim)
    return _matrix([bytes(r["low"]) for r in held], dim).min(0), _matrix([bytes(r["high"]) for r in held], dim).max(0)


def _closest_manhattan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``src, dst, distance``: the ``k`` closest of a task's rows for each query, by mean absolute difference.

    Components counted from their smallest are zero or more, and for such numbers
    ``|a - b| >= (sqrt(a) - sqrt(b)) ** 2``. The sum of the right side takes one
    product of matrices. Only pairs for which it is within the distance of the
    ``k``-th row so far, with the error of the product added, are measured.
    Nor can a distance be less than the difference of the sums of components, so
    rows in the order of their sums are looked at in a range only.
    """
    fine = np.isfinite(q).all(1)
    ids, q = ids[fine], q[fine]
    dim = q.shape[1]
    low, high = np.minimum(low, q.min(0, initial=np.inf)), np.maximum(high, q.max(0, initial=-np.inf))
    unit = max(float((high - low).max(initial=0)), 1e-300)
    error, slack = (dim + 10) * 1.2e-7, dim / unit * 10.0**-DECIMALS + 1e-12

    def rooted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x - low) / unit
        return np.sqrt(y), y.sum(1)

    roots, sums = rooted(q)
    order = np.argsort(sums, kind="stable")
    ids, q, sums = ids[order], q[order], sums[order]
    roots = np.column_stack([roots[order], np.ones(len(q))]).astype(np.float32)
    bound = np.full(len(q), np.inf)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(q), 256)]

    def measured(part: int, r: np.ndarray, c: np.ndarray, there: np.ndarray, x: np.ndarray) -> None:
        r = r + 256 * part
        d = [np.abs(x[c[i : i + 2048]] - q[r[i : i + 2048]]).mean(1) for i in range(0, len(r), 2048)]
        d = np.round(np.concatenate([np.zeros(0), *d]), DECIMALS)
        keep = np.isfinite(d) & (ids[r] != there[c])
        src, dst, d = (np.concatenate(x) for x in zip(held[part], (r[keep], there[c[keep]], d[keep]), strict=True))
        order = np.lexsort((dst, d, src))
        src, dst, d = src[order], dst[order], d[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        held[part] = tuple(v[place < k] for v in (src, dst, d))
        bound[src[place == k - 1]] = d[place == k - 1]

    for batch in batches:
        there, x = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pylist(), dim)
        fine = np.isfinite(x).all(1)
        there, x = there[fine], x[fine]
        own, total = rooted(x)
        order = np.argsort(total, kind="stable")
        there, x, total = there[order], x[order], total[order]
        own = np.column_stack([own[order], (error - 0.5) * total]).astype(np.float32)
        for part, i in enumerate(range(0, len(q) if len(x) else 0, 256)):
            a = sums[i : i + 256]
            reach = bound[i : i + 256] * (dim / unit)
            beyond = reach.max() + 2 * slack + 1e-9 * dim
            first, last = np.searchsorted(total, [a[0] - beyond, a[-1] + beyond])
            product = roots[i : i + 256] @ own[first:last].T
            if not np.isfinite(reach).all() and last - first > k + 1:
                # the likeliest first, for a bound
                near = np.argpartition(product, -k - 1, axis=1)[:, -k - 1 :]
                unbound = np.flatnonzero(~np.isfinite(reach))
                rows = np.repeat(unbound, k + 1), near[unbound].ravel() + first
                measured(part, *rows, there, x)
                product[rows[0], rows[1] - first] = -np.inf
                reach = bound[i : i + 256] * (dim / unit)
            limit = np.maximum((a - reach) / 2 - error * a - slack, -1e38).astype(np.float32)
            r, c = np.nonzero(product > limit[:, None])
            if len(r):
                measured(part, r, c + first, there, x)
    for src, dst, d in held:
        yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(dst), pa.array(d)], names=["src", "dst", "distance"])


def _first(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` smallest of each row, ties by id."""
    bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d), k), np.int64)
    for i in range(len(d)):
        near = np.flatnonzero(d[i] <= bound[i])
        out[i] = near[np.lexsort((ids[near], d[i, near]))][:k]
    return out
