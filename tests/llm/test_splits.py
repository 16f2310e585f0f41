import random

from pyspark.sql import functions as F

from textloom.llm import splits

SCHEMA = "row_id bigint, p string, s string, group_id string, id string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r["row_id"]: r["group_id"] for r in splits.tied_groups(df, "row_id", ["p", "s"]).collect()}


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, p, s in rows:
        for k, v in (("p", p), ("s", s)):
            if v and v.strip():
                a, b = find(("r", i)), find((k, v.strip().lower()))
                parent[a] = b
    least = {}
    for i, _, _ in rows:
        root = find(("r", i))
        least[root] = min(least.get(root, i), i)
    return {i: least[find(("r", i))] for i, _, _ in rows}


def test_random_graphs(spark):
    for seed in (1, 2):
        random.seed(seed)
        rows = [(i, random.choice([None, "", " ", *(f"p{random.randint(0, 150)}" for _ in range(6))]), random.choice([None, " \t", *(f" S{random.randint(0, 120)}\n" for _ in range(3)), f"s{random.randint(0, 120)}"])) for i in range(1, 301)]
        assert groups(spark, rows) == brute(rows)


def test_long_chain_and_hot_value(spark):
    chain = [(i, f"p{(i + 1) // 2}", f"s{i // 2}") for i in range(1, 120)]
    hot = [(i, f"q{i}", "hot") for i in range(200, 260)]
    alone = [(300, None, None), (301, "", " "), (302, "only", None), (303, "ONLY ", None)]
    got = groups(spark, [*chain, *hot, *alone])
    assert {got[i] for i, _, _ in chain} == {1} and {got[i] for i, _, _ in hot} == {200}
    assert (got[300], got[301], got[302], got[303]) == (300, 301, 302, 302)


def test_empty(spark):
    assert groups(spark, []) == {}


def test_groups_stay_whole_and_shares_hold(spark):
    random.seed(3)
    rows = [(i, i if i > 500 else 1 + i % 7, random.choice("ab") if i % 9 else None) for i in range(1, 5001)]
    df = spark.createDataFrame(rows, "row_id bigint, group_id bigint, label string")
    out = splits.assign_splits(df, "row_id", F.col("label"), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(out) == 5000
    by_group = {}
    for r in out:
        by_group.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by_group.values())
    share = {s: sum(r["split"] == s for r in out) / 5000 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.03
    label = {i: v for i, _, v in rows}
    of_a = [r for r in out if label[r["row_id"]] == "a"]
    assert abs(sum(r["split"] == "train" for r in of_a) / len(of_a) - 0.8) < 0.05
    assert splits.assign_splits(df.limit(0), "row_id", F.col("label"), {"train": 1.0}).count() == 0


def test_labels_of_one_hash_class_are_balanced_by_themselves(spark):
    classes = {}
    for r in spark.range(80).select(F.concat(F.lit("l"), "id").alias("v")).withColumn("c", F.pmod(F.xxhash64("v", F.lit(0)), F.lit(32))).collect():
        classes.setdefault(r["c"], []).append(r["v"])
    a, b = next(v for v in classes.values() if len(v) > 1)[:2]
    rows = [(i, i // 50, a if i // 50 % 2 else b) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id bigint, group_id bigint, label string")
    out = splits.assign_splits(df, "row_id", F.col("label"), {"train": 0.5, "test": 0.5}).collect()
    label = {i: v for i, _, v in rows}
    for v in (a, b):
        assert sum(r["split"] == "train" for r in out if label[r["row_id"]] == v) == 250


def test_one_and_three_entities(spark):
    random.seed(8)
    rows = [(i, random.choice([None, f"p{random.randint(0, 90)}"]), random.choice([None, f"s{random.randint(0, 90)}"]), random.choice([None, None, f" A{random.randint(0, 60)}", f"a{random.randint(0, 60)} "])) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "row_id bigint, p string, s string, author string")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for names in (["p"], ["p", "s", "author"]):
        parent.clear()
        for r in df.collect():
            for n in names:
                if r[n] and r[n].strip():
                    parent[find(("r", r["row_id"]))] = find((n, r[n].strip().lower()))
        least = {}
        for i, *_ in rows:
            least[find(("r", i))] = min(least.get(find(("r", i)), i), i)
        got = {r["row_id"]: r["group_id"] for r in splits.tied_groups(df, "row_id", names).collect()}
        assert got == {i: least[find(("r", i))] for i, *_ in rows}


def test_shares_hold_within_a_small_group(spark):
    rows = [(i, i // 3, "ab"[i // 3 % 2]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "row_id bigint, group_id bigint, label string")
    out = splits.assign_splits(df, "row_id", F.col("label"), {"train": 0.8, "validation": 0.1, "test": 0.1}).join(df.select("row_id", "label"), "row_id")
    got = splits.deviation(out, "split", F.col("label"), {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert len(got) == 9 and all(abs(r["share"] - r["wanted"]) <= 3 / 15_000 for r in got)
