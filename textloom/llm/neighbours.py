"""Most similar vectors for every vector, by learned partitions.

A nearest-neighbour graph of a bounded sample is cut into balanced parts with
few edges between them; a linear classifier learns to tell from a vector which
parts its neighbours are in. Parts that are still large get a graph, parts and a
classifier of their own, learned from a sample of them. Every vector is indexed
in its most probable part and looks for its neighbours in several, where all
candidates are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.vectors import DIM, matrix
from textloom.plans.materialize import Workspace

#: Vectors that a partitioning is learned from, at most about so many for each model and each large part.
SAMPLE = 20_000
#: Vectors that a part should hold, and parts of one classifier at most.
PART, FAN = 2_000, 1_024
#: A part of more than so many times ``PART`` is cut again.
SPLIT = 4
#: A vector is looked for in as many parts as hold its neighbours with this probability.
MASS = 0.95
#: The same where only neighbours of at least ``CLOSE`` are wanted, which rarely are in another part.
CLOSE, CLOSE_MASS = 0.8, 0.85
#: Rows of the index, and of queries, that one task holds at once.
BLOCK, CHUNK = 4_096, 16_384


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k rows most similar to it."""
    out = np.empty((len(x), k), np.int32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, slack: float = 1.1) -> np.ndarray:
    """A part for each vertex: few graph edges between parts, none larger than ``slack`` of its share.

    Starts from halves along the main direction, again and again, and then moves
    vertices to the part that most of their neighbours are in while it has room.
    """
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        own, first, n = todo.pop()
        label[own] = first
        if n == 1:
            continue
        centred = x[own] - x[own].mean(0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        a = n // 2
        order = np.argsort(centred @ direction, kind="stable")
        split = len(own) * a // n
        todo += [(own[order[:split]], first, a), (own[order[split:]], first + a, n - a)]
    room = int(np.ceil(len(x) / parts * slack))
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def learn_router(x: np.ndarray, parts: int, seed: int = 0, graph_k: int = 20, epochs: int = 12) -> np.ndarray:
    """Weights (components and a constant by part) of a softmax classifier of parts."""
    dim = x.shape[1]
    if parts == 1:
        return np.zeros((dim + 1, 1), np.float32)
    graph = neighbour_graph(x, min(graph_k, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 0.5 / graph.shape[1])
    target[np.arange(len(x)), label] += 0.5
    z = np.hstack([x, np.full((len(x), 1), 0.1, np.float32)]).astype(np.float32)
    w, m, v = (np.zeros((dim + 1, parts), np.float32) for _ in range(3))
    for c in range(parts):
        own = x[label == c]
        if len(own):
            w[:dim, c] = own.mean(0) * 8
    random, step = np.random.RandomState(seed), 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for i in range(0, len(x), 1024):
            part = order[i : i + 1024]
            logits = z[part] @ w
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            g = z[part].T @ (p - target[part]) / len(part)
            step += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _fitted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``model, part, parts, w``: a classifier for every row ``model, part, n`` of ``sizes``, each learned in a task of its own.

    ``rows`` has ``model, part, unit``; what a task sees is a sample of at most
    about ``SAMPLE`` rows, whatever the part holds.
    """
    parts = F.least(F.ceil(F.col("n") / PART), F.lit(FAN)).cast("int")
    rates = sizes.select("model", "part", parts.alias("parts"), (F.least(F.lit(SAMPLE), F.greatest(F.lit(4_000), 48 * parts)) / F.col("n")).alias("rate"))
    chosen = rows.join(F.broadcast(rates), ["model", "part"]).where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < F.col("rate") * F.lit(1 << 20))

    def learned(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.drop_duplicates("unit").sort_values("unit")
        x = np.frombuffer(b"".join(sample["unit"]), np.float32).reshape(len(sample), -1)
        n = max(1, min(int(sample["parts"].iloc[0]), len(sample) // 16))
        return pd.DataFrame({"model": [sample["model"].iloc[0]], "part": [sample["part"].iloc[0]], "parts": [n], "w": [learn_router(x, n).tobytes()]})

    return chosen.select("model", "part", "parts", "unit").groupBy("model", "part").applyInPandas(learned, "model string, part bigint, parts int, w binary")


def _probed(x: np.ndarray, w: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """``parts, count``: the likeliest parts of each row in order, and how many of them it takes for ``mass``."""
    p = x @ w[:-1] + 0.1 * w[-1]
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    most = min(64, p.shape[1])
    order = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < p.shape[1] else np.tile(np.arange(most), (len(p), 1))
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(p, order, 1), axis=1, kind="stable"), 1)
    held = np.cumsum(np.take_along_axis(p, order, 1), 1)
    return order, np.minimum((held < mass).sum(1) + 1, most)


def _routed(classes: DataFrame, routers: dict[str, np.ndarray], mass: float) -> DataFrame:
    """``classes`` with ``probe``: the parts in order of probability, the first being its own."""
    shared = classes.sparkSession.sparkContext.broadcast(routers)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(1).to_pylist(), object)
            x = matrix(batch.column(2))
            probe: list[list[int]] = [[0]] * len(models)
            for model in set(models.tolist()):
                w = shared.value.get(model)
                if w is None or w.shape[1] == 1:
                    continue
                own = np.flatnonzero(models == model)
                order, count = _probed(x[own], w, mass)
                for i, row, n in zip(own.tolist(), order.tolist(), count.tolist(), strict=True):
                    probe[i] = row[:n]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probe, pa.list_(pa.int64()))], names=["id", "model", "unit", "probe"])

    return classes.select("id", "model", "unit").mapInArrow(routed, "id bigint, model string, unit binary, probe array<bigint>")


def _refined(looks: DataFrame, large: DataFrame, workspace: Workspace, mass: float) -> DataFrame:
    """``looks`` of the ``large`` parts (``model, part, n``) moved to parts of these, each under a classifier learned for it.

    Rows and classifier meet by a join on the part, the rows in groups of
    about ``CHUNK``; neither the classifiers nor the rows are broadcast.
    """
    routers = workspace.cut(_fitted(looks.where("not asks"), large))
    load = looks.groupBy("model", "part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("groups")).join(large.select("model", "part"), ["model", "part"])
    load = workspace.cut(load)
    salted = looks.join(F.broadcast(load), ["model", "part"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), "groups").cast("int"))
    copies = routers.join(load, ["model", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

    def moved(rows: pa.Table, router: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.select(["id", "model", "unit", "asks", "part"])
        own = rows.column("part")[0].as_py()
        asks = rows.column("asks").to_numpy()
        if router.num_rows:
            w = np.frombuffer(router.column("w")[0].as_py(), np.float32).reshape(-1, router.column("parts")[0].as_py())
            order, count = _probed(matrix(rows.column("unit")), w, mass)
            count = np.where(asks, count, 1)
        else:
            order, count = np.zeros((len(asks), 1), np.int64), np.ones(len(asks), np.int64)
        again = np.repeat(np.arange(len(asks)), count)
        place = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
        out = rows.select(["id", "model", "unit", "asks"]).take(pa.array(again))
        return out.append_column("part", pa.array((own + 1) * FAN + order[again, place]))

    pair = salted.select("id", "model", "unit", "asks", "part", "salt").groupBy("model", "part", "salt").cogroup(copies.select("model", "part", "salt", "parts", "w").groupBy("model", "part", "salt"))
    fine = pair.applyInArrow(moved, "id bigint, model string, unit binary, asks boolean, part bigint")
    rest = looks.join(F.broadcast(load.select("model", "part")), ["model", "part"], "left_anti")
    return workspace.cut(rest.select("id", "model", "unit", "asks", "part").unionByName(fine))


def nearest(classes: DataFrame, k: int, workspace: Workspace, min_cosine: float = -2.0, asked: DataFrame | None = None, mass: float | None = None, mutual: bool = False) -> DataFrame:
    """``id, nbr, cosine, place``: up to ``k`` most similar other vectors of each vector's model, at least ``min_cosine``.

    ``classes`` has distinct vectors ``id, model, unit``; ``asked``, if given, the
    ids to look for. Up to ``FAN`` parts of ``PART`` vectors a model there is one
    classifier; of a larger model each large part is cut again, so that parts
    keep their size and the work for a vector stays the same. Parts that yet are
    larger are cut into index blocks and query chunks of a fixed size. Where all
    vectors look, a pair found from one side counts for both; with ``mutual`` so
    does one between two that were asked for.
    """
    if mass is None:
        mass = CLOSE_MASS if min_cosine >= CLOSE else MASS
    # one row and one classifier of at most FAN parts for each model
    sizes = workspace.cut(classes.groupBy("model").agg(F.count("*").alias("n")).select("model", F.lit(0).cast("bigint").alias("part"), "n"))
    several = sizes.where(F.col("n") > PART)
    made = [] if several.isEmpty() else _fitted(classes.select("model", F.lit(0).cast("bigint").alias("part"), "unit"), several).collect()
    routers = {r["model"]: np.frombuffer(r["w"], np.float32).reshape(-1, r["parts"]) for r in made}
    if asked is None:
        routed = workspace.cut(_routed(classes, routers, mass))
        index, queries = routed, routed
    else:
        index = workspace.cut(_routed(classes, routers, 0.0))
        queries = workspace.cut(_routed(classes.join(asked, "id", "left_semi"), routers, mass))
    index = index.select("id", "model", "unit", F.lit(False).alias("asks"), F.element_at("probe", 1).alias("part"))
    queries = queries.select("id", "model", "unit", F.lit(True).alias("asks"), F.explode("probe").alias("part"))
    large = workspace.cut(index.groupBy("model", "part").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * PART)) if made else None
    if large is not None and not large.isEmpty():
        looks = _refined(index.unionByName(queries), large, workspace, mass)
        index, queries = looks.where("not asks"), looks.where("asks")
    # one row per model and part, a two-thousandth of the rows: joined by AQE's choice
    cells = index.groupBy("model", "part").agg(F.count("*").alias("rows")).join(queries.groupBy("model", "part").agg(F.count("*").alias("looks")), ["model", "part"])
    cells = workspace.cut(cells.select("model", "part", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("looks") / CHUNK).cast("int").alias("chunks")))
    index = index.join(cells, ["model", "part"]).select("id", "model", "part", "unit", "asks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    queries = queries.join(cells, ["model", "part"]).select("id", "model", "part", "unit", "asks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int").alias("chunk"))

    def scored(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), matrix(table.column("unit"))
        inside, there = ids[~asks], x[~asks]
        outside, here = ids[asks], x[asks]
        a, b, c = [], [], []
        n = min(k + 1, len(inside))
        for i in range(0, len(outside) if n else 0, 1024):
            s = here[i : i + 1024] @ there.T
            s[outside[i : i + 1024, None] == inside[None, :]] = -3
            if min_cosine >= CLOSE:  # few are near: no need to order the rest
                r, j = np.nonzero(s >= min_cosine)
                v = s[r, j]
                by = np.lexsort((inside[j], -v, r))
                r, j, v = r[by], j[by], v[by]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                a.append(outside[i + r[place < k]])
                b.append(inside[j[place < k]])
                c.append(v[place < k].astype(np.float64))
                continue
            top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(inside) else np.tile(np.arange(n), (len(s), 1))
            value = np.take_along_axis(s, top, 1)
            keep = value >= max(min_cosine, -2.0)
            a.append(np.repeat(outside[i : i + 1024], keep.sum(1)))
            b.append(inside[top[keep]])
            c.append(value[keep].astype(np.float64))
        cat = (lambda v, t: np.concatenate(v) if v else np.zeros(0, t))
        return pa.table({"id": pa.array(cat(a, np.int64)), "nbr": pa.array(cat(b, np.int64)), "cosine": pa.array(cat(c, np.float64))})

    found = index.unionByName(queries).groupBy("model", "part", "block", "chunk").applyInArrow(scored, "id bigint, nbr bigint, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "nbr")
    if asked is None or mutual:
        # a pair comes at most twice, so the first 2 k hold the first k different ones
        found = found.withColumn("both", F.explode(F.array(F.struct(F.col("id"), F.col("nbr")), F.struct(F.col("nbr").alias("id"), F.col("id").alias("nbr"))))).select("both.id", "both.nbr", "cosine")
        if asked is not None:
            found = found.join(asked, "id", "left_semi")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * k).groupBy("id", "nbr").agg(F.max("cosine").alias("cosine"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("id", "nbr", "cosine", "place")


def vector_classes(units: DataFrame, first: int) -> DataFrame:
    """``id, model, unit, ids, copies``: equal vectors of a model as one row with its ``first`` smallest ids.

    Each batch keeps its smallest ids only, so a vector of a third of all rows
    comes together as a few ids per batch.
    """

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, bytes], list[int]] = {}
            for i, m, u in zip(*(batch.column(c).to_pylist() for c in ("id", "model", "unit")), strict=True):
                held.setdefault((m, u), []).append(i)
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in keys], pa.string()), pa.array([u for _, u in keys], pa.binary()), pa.array([sorted(held[x])[:first] for x in keys], pa.list_(pa.int64())), pa.array([len(held[x]) for x in keys], pa.int64())], names=["model", "unit", "ids", "copies"])

    partial = units.select("id", "model", "unit").mapInArrow(combined, "model string, unit binary, ids array<bigint>, copies bigint")
    merged = partial.groupBy("model", "unit").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, first).alias("ids"), F.sum("copies").alias("copies"))
    return merged.select(F.element_at("ids", 1).alias("id"), "model", "unit", "ids", "copies")


def most_similar(units: DataFrame, k: int = 5, min_cosine: float = -2.0, asked: Column | None = None) -> DataFrame:
    """``id, nbr, rank, cosine_similarity``: for each row its ``k`` most similar rows of its model.

    ``units`` comes from ``unit_vectors``. Equal similarities rank by id; a row's
    copies, under other ids, come first. ``asked`` is a condition on ``id`` that
    says which rows to look for; all rows are indexed. Vectors that aren't usable
    neither look nor are found.
    """
    workspace = Workspace(units.sparkSession, "neighbours")
    classes = workspace.cut(vector_classes(units, k + 1))
    rows = units if asked is None else units.where(asked)
    digest = F.unhex(F.md5("unit")).alias("digest")
    own = classes.select("model", digest, F.col("id").alias("rep"), "ids", "copies")
    rows = rows.select("id", "model", digest).join(own, ["model", "digest"]).select("id", "rep", "ids", "copies")
    if asked is not None:
        rows = workspace.cut(rows)
    near = nearest(classes, k, workspace, min_cosine, None if asked is None else rows.select(F.col("rep").alias("id")).distinct())
    members = classes.select(F.col("id").alias("nbr"), "ids")
    spread = near.join(members, "nbr").select(F.col("id").alias("rep"), "cosine", F.explode("ids").alias("nbr"))
    order = Window.partitionBy("rep").orderBy(F.desc("cosine"), "nbr")
    spread = spread.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    own = rows.select("id", F.posexplode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("place", "nbr"))
    own = own.select("id", "nbr", (F.col("place") + 1).alias("rank"), F.lit(1.0).alias("cosine_similarity"))
    other = rows.where(F.col("copies") <= k).select("id", "rep", (F.col("copies") - 1).alias("before")).join(spread, "rep")
    other = other.where(F.col("before") + F.col("place") <= k).select("id", "nbr", (F.col("before") + F.col("place")).alias("rank"), F.col("cosine").alias("cosine_similarity"))
    return own.select("id", "nbr", F.col("rank").cast("int").alias("rank"), "cosine_similarity").unionByName(other.select("id", "nbr", F.col("rank").cast("int").alias("rank"), "cosine_similarity"))


def exact_similar(units: DataFrame, k: int, asked: Column, block: int = 8_192, bounds: DataFrame | None = None) -> DataFrame:
    """``id, nbr, rank, cosine_similarity`` by brute force for a stated set of rows, in blocks of a fixed size.

    ``bounds`` may say ``id, least`` for rows of which ``k`` others are known to
    be at least so similar; every pair is still computed, but only those that
    reach the bound are put in order.
    """
    spark = units.sparkSession
    workspace = Workspace(spark, "exact")
    units = workspace.cut(units)
    chosen = units.where(asked)
    if bounds is None:
        chosen = chosen.withColumn("least", F.lit(-2.0))
    else:
        chosen = chosen.join(bounds.select("id", "least"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    chosen = workspace.cut(chosen)
    blocks = max(1, -(-chosen.count() // block))
    every = spark.createDataFrame([], "id bigint, nbr bigint, cosine_similarity double")
    for i in range(blocks):
        held = chosen.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)) == i).collect()
        if not held:
            continue
        code = {m: c for c, m in enumerate(sorted({r["model"] for r in held}))}
        shared = spark.sparkContext.broadcast((code, np.array([r["id"] for r in held]), np.array([code[r["model"]] for r in held]), np.array([r["least"] for r in held], np.float32), np.frombuffer(b"".join(bytes(r["unit"]) for r in held), np.float32).reshape(-1, DIM)))

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            code, ids, models, least, x = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                there, names, y = batch.column(0).to_numpy(), batch.column(1).to_pylist(), matrix(batch.column(2))
                out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                names = np.array([code.get(m, -1) for m in names])
                for model in np.unique(names[names >= 0]).tolist():
                    inside = np.flatnonzero(names == model)
                    for known in (True, False):
                        asks = np.flatnonzero((models == model) & ((least > -2) == known))
                        for j in range(0, len(asks), 1024):
                            own = asks[j : j + 1024]
                            s = x[own] @ y[inside].T
                            if known:
                                r, c = np.nonzero(s >= least[own, None] - 1e-5)
                                other = ids[own[r]] != there[inside[c]]
                                r, c = r[other], c[other]
                                out.append((ids[own[r]], there[inside[c]], s[r, c].astype(np.float64)))
                                continue
                            s[ids[own, None] == there[inside]] = -3
                            n = min(k, len(inside))
                            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                            value = np.take_along_axis(s, top, 1)
                            keep = value > -2
                            out.append((np.repeat(ids[own], keep.sum(1)), there[inside[top[keep]]], value[keep].astype(np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "nbr", "cosine_similarity"])

        every = every.unionByName(workspace.cut(units.mapInArrow(scored, "id bigint, nbr bigint, cosine_similarity double")))
        shared.unpersist()
    order = Window.partitionBy("id").orderBy(F.desc("cosine_similarity"), "nbr")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "nbr", "rank", "cosine_similarity")
