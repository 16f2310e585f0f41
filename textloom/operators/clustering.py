"""Hierarchical and density-based clusters of small sets, cluster reports and quality measures of any set.

The algorithms that need a whole distance matrix check the number of rows first
and refuse more than ``graph.MOST``; reports and measures are relational.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.graph import MOST
from textloom.plans.materialize import Workspace


def distance_matrix(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Pairwise distances: ``euclidean``, ``cosine`` (a zero vector at 1) or ``manhattan`` (mean absolute difference)."""
    if len(x) > MOST:
        raise ValueError(f"{len(x)} rows; at most {MOST} fit an algorithm on a whole matrix")
    if metric == "manhattan":
        return np.stack([np.abs(x - v).mean(1) for v in x]) if len(x) else np.zeros((0, 0))
    if metric == "cosine":
        n = np.sqrt((x * x).sum(1))
        scale = n[:, None] * n
        d = np.clip(1 - np.divide(x @ x.T, scale, out=np.zeros_like(scale), where=scale > 0), 0, 2)
    else:
        s = (x * x).sum(1)
        d = np.sqrt(np.maximum(s[:, None] + s - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def linkage(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges ``(a, b, height, size)`` in order of height, by nearest-neighbour chains.

    ``method`` is single, complete, average or ward (on Euclidean distances).
    """
    n = len(distances)
    d = distances.astype(np.float64).copy()
    if method == "ward":
        d = d * d
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    merges: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        row = np.where(alive, d[top], np.inf)
        best = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[best]:
            best = chain[-2]
        if len(chain) > 1 and best == chain[-2]:
            a, b, h = top, best, float(d[top, best])
            chain = chain[:-2]
            da, db, na, nb = d[a], d[b], size[a], size[b]
            if method == "single":
                new = np.minimum(da, db)
            elif method == "complete":
                new = np.maximum(da, db)
            elif method == "average":
                new = (na * da + nb * db) / (na + nb)
            else:
                new = ((na + size) * da + (nb + size) * db - size * h) / (na + nb + size)
            alive[b] = False
            new[~alive] = np.inf
            new[a] = np.inf
            d[a], d[:, a] = new, new
            size[a] += nb
            merges.append((a, b, np.sqrt(h) if method == "ward" else h))
        else:
            chain.append(best)
    merges.sort(key=lambda m: m[2])
    parent = list(range(n))
    name, count = list(range(n)), [1] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = np.zeros((n - 1 if n else 0, 4))
    for k, (a, b, h) in enumerate(merges):
        x, y = find(a), find(b)
        out[k] = (*sorted((name[x], name[y])), h, count[x] + count[y])
        parent[y] = x
        count[x] += count[y]
        name[x] = n + k
    return out


def cut(merges: np.ndarray, n: int, clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels after all merges but the last ``clusters - 1``, or after those up to ``height``; canonical."""
    if (clusters is None) == (height is None):
        raise ValueError("either a number of clusters or a height")
    upto = max(0, n - clusters) if clusters is not None else int((merges[:, 2] <= height).sum())
    group = {i: [i] for i in range(n)}
    for k in range(min(upto, len(merges))):
        a, b = int(merges[k, 0]), int(merges[k, 1])
        group[n + k] = group.pop(a) + group.pop(b)
    labels = np.zeros(n, np.int64)
    for c, own in enumerate(group.values()):
        labels[own] = c
    return canonical(labels)


def canonical(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered by falling size, then by first place; -1 stays."""
    kept = labels[labels >= 0]
    names, first, count = np.unique(kept, return_index=True, return_counts=True)
    where = np.flatnonzero(labels >= 0)
    order = np.lexsort((where[first], -count)) if len(names) else []
    new = {int(names[o]): i for i, o in enumerate(order)}
    return np.array([new.get(int(x), -1) for x in labels], np.int64)


def relabelled(df: DataFrame, label: str, position: str) -> DataFrame:
    """``df`` with ``cluster``: labels renumbered from 0 by falling size, ties by the first position."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"), F.min(position).alias("_first"))
    numbered = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("_n"), "_first")) - 1)
    return df.join(numbered.select(label, "cluster"), label)


def mean_silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette width by a distance matrix; NaN for fewer than two clusters or as many as rows."""
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(labels):
        return float("nan")
    hot = labels[:, None] == names
    sums, count = d @ hot, hot.sum(0)
    own = hot.argmax(1)
    at = np.arange(len(d))
    a = np.where(count[own] > 1, sums[at, own] / np.maximum(count[own] - 1, 1), 0)
    other = sums / count
    other[at, own] = np.inf
    b = other.min(1)
    return float(np.where(count[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def choose_clusters(d: np.ndarray, merges: np.ndarray, low: int, high: int) -> tuple[int, pd.DataFrame]:
    """The number of clusters with the widest silhouette, the smaller among equals, and the width of each."""
    widths = [(k, mean_silhouette(d, cut(merges, len(d), k))) for k in range(low, min(high, len(d) - 1) + 1)]
    best = max(widths, key=lambda w: (-np.inf if np.isnan(w[1]) else w[1], -w[0]))[0]
    return best, pd.DataFrame(widths, columns=["clusters", "silhouette"])


def silhouettes(df: DataFrame, key: str, vector: str, label: str, dim: int, block: int = 2_048) -> DataFrame:
    """``key, label, a, b, width`` of every row of a labelled set of any size.

    Distances to all rows are summed by cluster, for a block of rows at a time;
    only those sums leave the tasks. Clusters of one row have width 0.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    sums = None
    workspace = Workspace(df.sparkSession, "silhouettes")
    for i in range(n):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect()
        if not held:
            continue
        shared = df.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64)))

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                c = batch.column(1).to_numpy()
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0))
                d[ids[:, None] == batch.column(0).to_numpy()] = 0
                for name in np.unique(c).tolist():
                    total[name] = total.get(name, 0) + d[:, c == name].sum(1)
            for name, s in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), name, np.int32)), pa.array(s)], names=["id", "other", "s"])

        part = workspace.cut(rows.mapInArrow(add, "id bigint, other int, s double").groupBy("id", "other").agg(F.sum("s").alias("s")))
        shared.destroy()
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return rows.select(F.col("id").alias(key), F.col("c").alias(label), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("width"))
    counts = F.broadcast(rows.groupBy(F.col("c").alias("other")).agg(F.count("*").alias("n")))
    table = sums.groupBy("id", "other").agg(F.sum("s").alias("s")).join(counts, "other").join(rows.select("id", "c"), "id")
    own = F.col("c") == F.col("other")
    per = table.groupBy("id", "c").agg(F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    width = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select(F.col("id").alias(key), F.col("c").alias(label), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("a"), F.round("b", 6).alias("b"), F.round(width, 6).alias("width"))


def agreement(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic mean), homogeneity, completeness, V.

    From the contingency table alone; rows with a null label are left out.
    """
    table = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("a"), F.col(right).alias("b")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    table = table.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))}).withColumn("all", F.sum("n").over(whole))
    pairs = (lambda x: x * (x - 1) / 2)
    n, na, nb, total = F.col("n"), F.col("na"), F.col("nb"), F.col("all")
    # each marginal is spread over the cells of its line in proportion, so that one sum over cells gives it once
    sums = table.agg(F.max("all").alias("all"), F.sum(pairs(n)).alias("ij"), F.sum(pairs(na) * n / na).alias("ii"), F.sum(pairs(nb) * n / nb).alias("jj"), F.sum(n / total * F.log(n * total / (na * nb))).alias("mi"), F.sum(-(n / total) * F.log(na / total)).alias("ha"), F.sum(-(n / total) * F.log(nb / total)).alias("hb"))
    ij, ii, jj, mi, ha, hb = (F.col(c) for c in ("ij", "ii", "jj", "mi", "ha", "hb"))
    expected = ii * jj / pairs(F.col("all"))
    ari = F.when((ii + jj) / 2 == expected, 1.0).otherwise((ij - expected) / ((ii + jj) / 2 - expected))
    hom = F.when(ha > 0, mi / ha).otherwise(1.0)
    com = F.when(hb > 0, mi / hb).otherwise(1.0)
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(0.0)
    nmi = F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0)
    return sums.select(*[F.round(c, 6).alias(x) for c, x in ((ari, "ari"), (nmi, "nmi"), (hom, "homogeneity"), (com, "completeness"), (v, "v_measure"))])


def label_summary(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster: size, counts of labels 0 and 1, the percentage of 1, the dominant label (0 among equals) and purity."""
    c = df.where(F.col(label).isin(0, 1)).groupBy(cluster).agg(F.count("*").alias("size"), F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"))
    return c.withColumns({"percent_1": F.round(100.0 * F.col("label_1") / F.col("size"), 4), "dominant": (F.col("label_1") > F.col("label_0")).cast("int"), "purity": F.round(F.greatest("label_0", "label_1") / F.col("size"), 6)})


def centroids(df: DataFrame, cluster: str, vector: str, dim: int) -> DataFrame:
    """``cluster, centroid``: component-wise means, combined before the shuffle."""
    parts = [F.avg(F.element_at(F.col(vector), i + 1).cast("double")) for i in range(dim)]
    return df.where(F.size(vector) == dim).groupBy(cluster).agg(F.array(*parts).alias("centroid"))


def representatives(df: DataFrame, cluster: str, key: str, distance: str, k: int = 6) -> DataFrame:
    """The ``k`` rows of each cluster closest to its centre, ties by key, with their ``place``; a salt at a time."""
    order = [F.asc(distance), F.asc(key)]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(16)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy(cluster, "_salt").orderBy(*order))).where(F.col("place") <= k)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col("place") <= k).drop("_salt")


def report(df: DataFrame, cluster: str, key: str, distance: str, rank: str) -> DataFrame:
    """Per cluster: size, distance and rank summaries (null without a valid rank)."""
    d, r = F.col(distance), F.col(rank)
    return df.groupBy(cluster).agg(F.count("*").alias("size"), F.round(F.min(d), 6).alias("min_distance"), F.round(F.avg(d), 6).alias("mean_distance"), F.round(F.max(d), 6).alias("max_distance"), F.min(r).alias("best_rank"), F.round(F.avg(r), 6).alias("mean_rank"), F.max(r).alias("worst_rank"), F.min(key).alias("first_key"))


def core_distances(d: np.ndarray, samples: int) -> np.ndarray:
    """The distance to the ``samples``-th closest row, the row itself counting."""
    return np.partition(d, min(samples, len(d)) - 1, axis=1)[:, min(samples, len(d)) - 1]


def density_clusters(d: np.ndarray, least: int = 10, samples: int | None = None, most: int | None = None, leaf: bool = False) -> pd.DataFrame:
    """Density clusters of a distance matrix: ``label`` (-1 for noise), ``probability``, ``outlier_score``.

    Single linkage of mutual reachability, condensed to clusters of at least
    ``least`` rows; the most stable (or the leaves) are chosen, none above ``most``.
    """
    n = len(d)
    if n < 2:
        return pd.DataFrame({"label": np.full(n, -1), "probability": np.zeros(n), "outlier_score": np.zeros(n)})
    core = core_distances(d, samples or least)
    merges = linkage(np.maximum(np.maximum(d, core), core[:, None]), "single")
    children = {n + k: (int(a), int(b)) for k, (a, b, _, _) in enumerate(merges)}
    level = {n + k: (1 / h if h > 0 else np.inf) for k, (_, _, h, _) in enumerate(merges)}
    size = {**dict.fromkeys(range(n), 1), **{n + k: int(s) for k, (_, _, _, s) in enumerate(merges)}}

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += children[x]
        return out

    born, up, below = {0: 0.0}, {0: -1}, {0: []}
    fell: dict[int, tuple[int, float]] = {}
    stability = {0: 0.0}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, cluster = stack.pop()
        while node >= n:
            a, b = children[node]
            lam = level[node]
            big = [x for x in (a, b) if size[x] >= least]
            if len(big) == 2:
                for x in (a, b):
                    c = len(born)
                    born[c], up[c], below[c], stability[c] = lam, cluster, [], 0.0
                    below[cluster].append(c)
                    stability[cluster] += (lam - born[cluster]) * size[x] if np.isfinite(lam) else 0.0
                    stack.append((x, c))
                break
            for x in (a, b):
                if x not in big:
                    for p in leaves(x):
                        fell[p] = (cluster, lam)
                        stability[cluster] += (lam - born[cluster]) if np.isfinite(lam) else 0.0
            if not big:
                break
            node = big[0]
        else:
            fell.setdefault(node, (cluster, np.inf))
    held = {c: 0 for c in born}
    for c, _ in fell.values():
        x = c
        while x >= 0:
            held[x] += 1
            x = up[x]
    chosen, best = {}, dict(stability)
    for c in sorted(born, reverse=True):
        inner = sum(best[x] for x in below[c])
        fits = c != 0 and (most is None or held[c] <= most)
        if leaf:
            chosen[c] = fits and not below[c]
        else:
            chosen[c] = fits and stability[c] >= inner
            if not chosen[c]:
                best[c] = inner
    final: dict[int, int] = {}
    for c in sorted(born):
        above = final.get(up[c], -1) if c else -1
        final[c] = above if above >= 0 else (c if chosen[c] else -1)
    label = np.array([final[fell[p][0]] for p in range(n)])
    lam = np.array([fell[p][1] for p in range(n)])
    probability, outlier = np.zeros(n), np.zeros(n)
    deepest: dict[int, float] = {}
    for p in range(n):
        x = fell[p][0]
        while x >= 0:
            if np.isfinite(lam[p]):
                deepest[x] = max(deepest.get(x, 0.0), lam[p])
            x = up[x]
    for p in range(n):
        top = deepest.get(label[p], 0.0) if label[p] >= 0 else 0.0
        probability[p] = 0.0 if label[p] < 0 else 1.0 if not np.isfinite(lam[p]) or top == 0 else min(lam[p], top) / top
        whole = deepest.get(fell[p][0], 0.0)
        outlier[p] = 0.0 if not np.isfinite(lam[p]) or whole == 0 else (whole - lam[p]) / whole
    return pd.DataFrame({"label": canonical(label), "probability": probability, "outlier_score": outlier})


def cluster_column(df: DataFrame, names: tuple[str, ...] = ("cluster_id", "cluster", "label")) -> str:
    """The first of some columns that the table has and that is never null."""
    for name in (n for n in names if n in df.columns):
        if df.where(F.col(name).isNull()).isEmpty():
            return name
    raise ValueError(f"none of {', '.join(names)} is complete")


def by_cluster(df: DataFrame, cluster: str, key: str, text: str, probability: str, examples: int = 6, noise: bool = True) -> DataFrame:
    """``cluster, size, examples``: the likeliest texts of each cluster, ties by key; cluster -1 only with ``noise``."""
    rows = df if noise else df.where(F.col(cluster) >= 0)
    chosen = representatives(rows.withColumn("_far", -F.coalesce(F.col(probability), F.lit(0.0))), cluster, key, "_far", examples)
    shown = chosen.groupBy(cluster).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", text))), lambda x: x[text]).alias("examples"))
    return rows.groupBy(cluster).agg(F.count("*").alias("size")).join(shown, cluster)


def word_clusters(counts: DataFrame, members: DataFrame) -> DataFrame:
    """``name, words, grouped``: word clusters named from 1 by falling size of their counts, words by falling count.

    ``counts`` has ``term, n``, ``members`` ``term, cluster``.
    """
    rows = members.join(counts, "term")
    made = rows.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("grouped"), F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))), lambda x: x["term"]).alias("words"))
    place = F.row_number().over(Window.orderBy(F.desc("total"), "cluster"))
    return made.select(F.concat(F.lit("cluster"), place.cast("string")).alias("name"), "words", "grouped")


def forced(df: DataFrame, key: str, topic: str, vector: str, dim: int) -> DataFrame:
    """``key, topic, forced``: rows of topic -1 put to the topic with the nearest centre, ties by topic.

    The centres are the rows of a class table and are broadcast as one.
    """
    core = df.where(F.col(topic) >= 0)
    centres = centroids(core, topic, vector, dim).agg(F.sort_array(F.collect_list(F.struct(F.col(topic).alias("t"), "centroid"))).alias("_c"))
    d = (lambda c: F.aggregate(F.zip_with(F.col(vector), c["centroid"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    nearest = F.array_min(F.transform("_c", lambda c: F.struct(d(c).alias("d"), c["t"].alias("t"))))["t"]
    rows = df.crossJoin(F.broadcast(centres))  # by one row
    lost = F.col(topic) < 0
    return rows.select(key, F.when(lost, nearest).otherwise(F.col(topic)).alias(topic), lost.alias("forced"))


def distance_summary(df: DataFrame, key: str, vector: str, dim: int, width: float = 0.1, block: int = 2_048) -> DataFrame:
    """``bin, pairs, mean, stdev``: how many pairs of rows lie in each ``width`` of distance, and mean and population deviation over all pairs.

    Counted in blocks; no pair leaves a task.
    """
    rows = df.where(F.coalesce(F.size(vector) == dim, F.lit(False))).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = max(1, -(-rows.count() // block))
    parts = None
    workspace = Workspace(df.sparkSession, "distances")
    for i in range(n):
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).collect()
        if not held:
            continue
        shared = df.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in held], np.int64), np.array([r["v"] for r in held], np.float64)))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T, 0))[ids[:, None] < batch.column(0).to_numpy()]
                bins, at = np.unique(np.floor(np.round(d / width, 9)).astype(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.bincount(at, minlength=len(bins))), pa.array(np.bincount(at, weights=d, minlength=len(bins))), pa.array(np.bincount(at, weights=d * d, minlength=len(bins)))], names=["bin", "pairs", "s", "q"])

        part = workspace.cut(rows.mapInArrow(count, "bin bigint, pairs bigint, s double, q double"))
        shared.destroy()
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return rows.select(F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("pairs"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("stdev")).limit(0)
    bins = parts.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "s", "q")])
    whole = Window.partitionBy()
    total, s, q = (F.sum(c).over(whole) for c in ("pairs", "s", "q"))
    return bins.select("bin", "pairs", F.round(s / total, 6).alias("mean"), F.round(F.sqrt(q / total - (s / total) * (s / total)), 6).alias("stdev"))


def noise_report(df: DataFrame, label: str, probability: str) -> DataFrame:
    """One row: rows, clusters, rows in none, their share in percent, and the mean probability of the others."""
    noise = F.col(label) < 0
    made = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("rows"), F.count_distinct(F.when(~noise, F.col(label))).alias("clusters"), F.count_if(noise).alias("noise"), F.round(F.avg(F.when(~noise, F.col(probability))), 6).alias("mean_probability"))
    return made.withColumn("noise_percent", F.when(F.col("rows") > 0, F.round(100.0 * F.col("noise") / F.col("rows"), 4)).otherwise(0.0))


def enriched(df: DataFrame, label: str, probability: str, outlier_score: str) -> DataFrame:
    """``df`` with ``membership``: cluster, whether that is noise, probability and outlier score as one struct."""
    own = F.struct(F.col(label).alias("cluster_id"), (F.col(label) < 0).alias("is_noise"), F.col(probability).alias("probability"), F.col(outlier_score).alias("outlier_score"))
    return df.withColumn("membership", own)
