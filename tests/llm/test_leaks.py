import random

from textloom.llm import leaks
from textloom.llm.words import words


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item string")
    h = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, key string")
    return {(r["doc_id"], r["item_id"]): (r["start_word"], r["words"]) for r in leaks.leaked(d, "doc_id", "text", h, "item_id", "text", **kw).collect()}


def brute(docs, items, run_length):
    out = {}
    for d, t in docs:
        a = words(t)
        for i, s in items:
            b = words(s)
            m = min(run_length, len(b))
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                        n += 1
                    best = max(best, n)
            if m and best >= m and d is not None and i is not None:
                out[d, i] = best
    return out


def test_equals_brute_force(spark):
    random.seed(1)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.randint(1, 25))) for i in range(12)] + [(12, None), (13, ""), (14, "..")]
    items.append((15, items[0][1].upper()))
    docs = [(i, text(random.randint(0, 60))) for i in range(40)] + [(40, None), (41, "")]
    for i in range(40, 60):
        source = words(items[i % 12][1])
        a = random.randint(0, max(0, len(source) - 5))
        docs.append((i + 10, f"{text(5)} {', '.join(source[a : a + 6])} {text(5)}"))
    got = run(spark, docs, items, run=5)
    assert {k: n for k, (_, n) in got.items()} == brute(docs, items, 5)
    for (d, _), (start, n) in got.items():
        assert start + n <= len(words(dict(docs)[d]))


def test_blocks_of_items_and_whole_long_texts(spark):
    item = " ".join(f"x{i}" for i in range(20))
    docs = [(1, "z " * 50_000 + item), (2, item + " q"), (2, item), (None, item), (3, "x0 x1 x2")]
    items = [(1, item), (2, "x0 x1"), (3, item), (None, item)]
    got = run(spark, docs, items, block_bytes=40)
    assert set(got) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 2), (None, 1), (None, 2), (None, 3)}
    assert got[1, 1] == (50_000, 20)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == {}
    assert run(spark, [(1, "a b")], []) == {}
