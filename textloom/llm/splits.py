"""Splits that keep related records together.

Records and the entities they name (author, source, paragraph, ...) form a
bipartite graph. Labels travel along it from record to entity and back until no
label changes; the smallest label of a component is its group. Groups are then
dealt to the splits so that each keeps the given share of every stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.materialize import Workspace


def normal_entity(value: Column) -> Column:
    """Lower-cased without surrounding white space; null where nothing is left."""
    bare = F.lower(F.regexp_replace(value.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.when(bare != "", bare)


def tied_labels(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """``node, label`` with the smallest node of each component, from distinct undirected ``a, b``.

    Every round joins each node to the smallest label around it (large star),
    then the smaller neighbours to the smallest among them (small star). Both
    combine before the shuffle, keep components and end in stars.
    """
    before = None
    current = workspace.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = workspace.cut(small.where("a <> b").distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        workspace.drop(before)
        before, current = current, new
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return current.select(F.col("a").alias("node"), F.col("b").alias("label"))


def tied_groups(df: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """``key, group_id``: one row per row of ``df``; rows that share an entity value are in one group.

    ``entities`` are one or more columns. Values are compared without letter case and
    surrounding white space; null and blank values tie nothing, so a row with
    two of them is its own group. ``group_id`` is the smallest key of the group.

    Rows with the same pair of values are one vertex from the start, and the
    first entity is eliminated by joining each of its values to the smallest
    second entity it occurs with; labels then travel over what is left, which
    has a vertex per distinct second value. A hot value is one vertex. Of more
    columns the groups of the first two are an entity like any other.
    """
    workspace = Workspace(df.sparkSession, "splits")
    if len(entities) == 1:
        df, entities = df.select(key, entities[0], F.lit(None).cast("string").alias("_none")), [*entities, "_none"]
    if len(entities) > 2:
        # the groups of the columns before are an entity of their own
        before = workspace.cut(tied_groups(df, key, entities[:-1]))
        both = df.select(F.col(key).cast("bigint").alias(key), F.col(entities[-1]).alias("_last")).join(before, key)
        return tied_groups(both.select(key, "group_id", "_last"), key, ["group_id", "_last"])
    first, second = entities
    rows = df.select(F.col(key).cast("bigint").alias("id"), normal_entity(F.col(first)).alias("p"), normal_entity(F.col(second)).alias("s"))
    pairs = workspace.cut(rows.where("p is not null or s is not null").groupBy("p", "s").agg(F.min("id").alias("m")))
    # a vertex per second value, numbered by its smallest row
    s_node = pairs.where("s is not null").groupBy("s").agg(F.min("m").alias("node"))
    tied = workspace.cut(pairs.join(s_node, "s", "left").select("p", "s", "m", "node"))
    hub = tied.where("p is not null").groupBy("p").agg(F.min("node").alias("hub"), F.min("m").alias("m"))
    links = tied.where("p is not null and node is not null").select("p", "node").join(hub.where("hub is not null").select("p", "hub"), "p")
    labels = tied_labels(links.select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct(), workspace)
    of_node = tied.where("s is not null").groupBy("s", "node").agg(F.min("m").alias("m"))
    of_node = of_node.join(labels, "node", "left").select("s", F.coalesce("label", "node").alias("label"), "m")
    of_hub = hub.join(labels, F.col("hub") == F.col("node"), "left").select("p", F.coalesce("label", "hub", "m").alias("label"), "m", F.col("hub").isNotNull().alias("tied"))
    # the smallest row of a component may be one without a second value
    smallest = of_node.select("label", "m").union(of_hub.where("tied").select("label", "m")).groupBy("label").agg(F.min("m").alias("group_id"))
    of_node = workspace.cut(of_node.join(smallest, "label").select("s", "group_id"))
    of_hub = workspace.cut(of_hub.join(smallest, "label", "left").select("p", F.coalesce("group_id", "label").alias("group_id")))
    with_s = rows.where("s is not null").select("id", "s").join(of_node, "s").select("id", "group_id")
    with_p = rows.where("s is null and p is not null").select("id", "p").join(of_hub, "p").select("id", "group_id")
    alone = rows.where("s is null and p is null").select("id", F.col("id").alias("group_id"))
    return with_s.union(with_p).union(alone).withColumnRenamed("id", key)


def assign_splits(groups: DataFrame, key: str, stratum: Column, shares: dict[str, float], strata: int = 32, large: float = 0.001, seed: int = 0) -> DataFrame:
    """``key, group_id, split``: every group whole in one split, the strata spread as evenly as groups allow.

    ``groups`` has ``key``, ``group_id`` and the columns of ``stratum``. The
    ``strata`` most frequent labels are a class each, the others are hashed into
    as many classes and null is one, so their table is bounded. The groups
    with more than the share ``large`` of all rows (at most ``1 / large`` of
    them) are placed one by one, largest first, where they raise the summed
    squared deviation from the wanted counts the least. The many small groups
    of a main stratum stand in hash order, and are cut where their running
    number of rows reaches what each split still lacks of it, which misses the
    wanted number by less than one small group. An empty table gives no rows.
    """
    workspace = Workspace(groups.sparkSession, "assign")
    total = sum(shares.values())
    names = list(shares)
    labelled = groups.select("group_id", stratum.alias("label"))
    frequent = labelled.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(strata)
    frequent = workspace.cut(frequent.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).alias("place")))
    hashed = F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(strata)).cast("int") + F.lit(strata)
    c = F.when(F.col("label").isNull(), F.lit(2 * strata)).otherwise(F.coalesce("place", hashed)).alias("c")
    counted = workspace.cut(labelled.join(F.broadcast(frequent), "label", "left").select("group_id", c).groupBy("group_id", "c").agg(F.count("*").alias("n")))
    per_class = {r["c"]: r["n"] for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    rows = sum(per_class.values())
    sizes = counted.groupBy("group_id").agg(F.sum("n").alias("size"), F.max_by("c", F.struct("n", -F.col("c"))).alias("main"))
    big_ids = sizes.where(F.col("size") > F.lit(large * rows)).select("group_id")
    big: dict[int, dict[int, int]] = {}
    for r in counted.join(F.broadcast(big_ids), "group_id").collect():
        big.setdefault(r["group_id"], {})[r["c"]] = r["n"]
    missing = {(s, c): n * shares[s] / total for s in names for c, n in per_class.items()}
    placed = []
    for gid, own in sorted(big.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        best = min(names, key=lambda s: (sum((missing[s, c] - n) ** 2 - missing[s, c] ** 2 for c, n in own.items()), names.index(s)))
        placed.append((gid, best))
        for c, n in own.items():
            missing[best, c] -= n
    # the place of a small group in its stratum, from 0 to 1: summed within ranges of the hash, then over the ranges
    mixed = F.xxhash64("group_id", F.lit(seed))
    small = workspace.cut(sizes.where(F.col("size") <= F.lit(large * rows)).withColumn("_range", F.pmod(mixed, F.lit(1024))))
    ranges = small.groupBy("main", "_range").agg(F.sum("size").alias("_sum"))
    stratum = Window.partitionBy("main")
    ranges = ranges.select("main", "_range", (F.sum("_sum").over(stratum.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(stratum).alias("_all"))
    inside = F.sum("size").over(Window.partitionBy("main", "_range").orderBy(mixed, "group_id"))
    small = small.join(ranges, ["main", "_range"]).select("group_id", "main", ((F.col("_before") + inside - F.col("size") / 2) / F.col("_all")).alias("_at"))
    draw = F.col("_at")
    pick = F.lit(names[0])
    for c in per_class:
        want = [max(missing[s, c], 0.0) for s in names]
        want = want if sum(want) else [shares[s] for s in names]
        edge, chosen = 0.0, F.lit(names[-1])
        bounds = []
        for w in want:
            edge += w / sum(want)
            bounds.append(edge)
        for s, bound in reversed(list(zip(names[:-1], bounds[:-1], strict=True))):
            chosen = F.when(draw < bound, s).otherwise(chosen)
        pick = F.when(F.col("main") == c, chosen).otherwise(pick)
    spark = groups.sparkSession
    fixed = spark.createDataFrame(placed, "group_id bigint, split string")
    dealt = small.select("group_id", pick.alias("split")).unionByName(fixed)
    return groups.select(key, "group_id").join(dealt, "group_id").select(key, "group_id", "split")


def deviation(dealt: DataFrame, split: str, stratum: Column, shares: dict[str, float]) -> DataFrame:
    """``label, split, rows, share, wanted``: what each split got of every label, and of all rows (``label`` null, ``whole`` 1)."""
    total = sum(shares.values())
    rows = dealt.select(F.col(split).alias("split"), stratum.alias("label"))
    counts = rows.cube("label", "split").agg(F.grouping("label").cast("int").alias("whole"), F.grouping("split").alias("_sum"), F.count("*").alias("rows"))
    sums = counts.where("_sum = 1").select(F.col("label").alias("_label"), F.col("whole").alias("_whole"), F.col("rows").alias("_rows"))
    both = counts.where("_sum = 0").join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("whole") == F.col("_whole")))
    wanted = F.create_map(*[F.lit(x) for s, v in shares.items() for x in (s, v / total)])[F.col("split")]
    return both.select("label", "whole", "split", "rows", F.round(F.col("rows") / F.col("_rows"), 6).alias("share"), wanted.alias("wanted"))
