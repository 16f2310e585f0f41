import random
from itertools import combinations

import numpy as np
import pytest

from textloom.llm import neardup
from textloom.llm.words import words


def pairs(spark, rows, threshold=0.7, tables=("t",)):
    frames = [neardup.fingerprints(spark.createDataFrame([(i, t, "x") for i, t in rows], "row_id bigint, text string, tbl string"), name, "row_id", "text") for name in tables]
    prints = frames[0]
    for f in frames[1:]:
        prints = prints.unionByName(f)
    got = [tuple(r) for r in neardup.near_duplicates(prints, threshold).select("tbl", "a_id", "b_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(rows, threshold=0.7, name="t"):
    held = [(i, set(words(t)), "".join(words(t))) for i, t in rows if t and i is not None and len(set(words(t))) >= 8]
    return {(name, min(a[0], b[0]), max(a[0], b[0])) for a, b in combinations(held, 2) if a[2] != b[2] and len(a[1] & b[1]) >= threshold * len(a[1] | b[1]) - 1e-9}


def edited(text, seed, most=6):
    r = random.Random(seed)
    w = text.split()
    for _ in range(r.randint(0, most)):
        at = r.randrange(len(w))
        if r.random() < 0.4 and len(w) > 8:
            del w[at]
        elif r.random() < 0.5:
            w.insert(at, f"new{r.randint(0, 50)}")
        else:
            w[at] = f"sub{r.randint(0, 50)}"
    if r.random() < 0.3:
        r.shuffle(w)
    return " ".join(w)


def corpus(seed, n=120, vocabulary=400):
    r = random.Random(seed)
    base = [" ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(r.randint(9, 40))) for _ in range(n // 4)]
    return [(i, edited(base[r.randrange(len(base))], seed * 1000 + i)) for i in range(1, n + 1)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_equals_brute_force(spark, seed, threshold):
    rows = corpus(seed)
    want = brute(rows, threshold)
    assert want and pairs(spark, rows, threshold) == want


def test_hot_cells_are_refined_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_CELL", 3)
    rows = [(i, " ".join(f"c{j}" for j in range(14)) + f" u{i} v{i % 5} w{i % 3}") for i in range(1, 60)]
    want = brute(rows)
    assert want and pairs(spark, rows) == want


def test_few_segments_collide_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SEGMENTS", 64)
    rows = corpus(3, 80)
    assert pairs(spark, rows) == brute(rows)


def test_frequent_segments_are_spread(spark, monkeypatch):
    real = neardup.near_sets
    monkeypatch.setattr(neardup, "near_sets", lambda t, x, w: real(t, x, w, part_rows=40))
    rows = corpus(4, 80)
    assert pairs(spark, rows) == brute(rows)


def test_copies_reordered_and_odd_texts(spark):
    text = "one two three four five six seven eight nine"
    rows = [(1, text), (2, text.upper().replace(" ", ", ")), (3, "nine " + text[:-5]), (4, None), (5, ""), (6, "one two three"), (7, "!!!"), (None, text), (8, " ".join(f"x{i}" for i in range(20_000)))]
    assert pairs(spark, rows) == {("t", 1, 3), ("t", 2, 3)} == brute(rows)
    # other words but the same letters in order: copies
    assert pairs(spark, [(1, text), (2, text.replace("one two", "on etwo"))]) == set()


def test_tables_stay_apart_and_empty(spark):
    rows = corpus(5, 30)
    assert pairs(spark, rows, tables=("a", "b")) == brute(rows, name="a") | brute(rows, name="b")
    assert pairs(spark, []) == set()


def test_popcount_distance_is_a_lower_bound():
    r = random.Random(6)
    for _ in range(50):
        a, b = ({f"w{r.randint(0, 60)}" for _ in range(20)} for _ in range(2))
        count = lambda s: np.bincount((neardup._hashes(s, {}) >> np.uint64(40)).astype(np.int64) % neardup.COARSE, minlength=neardup.COARSE)
        assert np.abs(count(a) - count(b)).sum() <= len(a ^ b)


def test_groups_are_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 50)
    rows = corpus(7, 80)
    rows += [(1000 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(2000, None), (2001, "too short")]
    prints = neardup.fingerprints(spark.createDataFrame(rows, "row_id bigint, text string"), "t", "row_id", "text")
    got = {r["id"]: (r["group_id"], r["links"]) for r in neardup.near_groups(prints, 0.7).collect()}
    sets = {}
    for i, t in rows:
        if t and len(set(words(t))) >= 8:
            sets.setdefault(frozenset(words(t)), []).append(i)
    keys = list(sets)
    near = {k: [o for o in keys if o != k and len(k & o) >= 0.7 * len(k | o) - 1e-9] for k in keys}
    want, seen = {}, set()
    for k in keys:
        if k in seen:
            continue
        todo, group = [k], []
        seen.add(k)
        while todo:
            x = todo.pop()
            group.append(x)
            for o in near[x]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        least = min(i for x in group for i in sets[x])
        want |= {i: (least, len(near[x])) for x in group for i in sets[x]}
    assert got == want
    assert neardup.near_groups(prints.limit(0)).count() == 0
