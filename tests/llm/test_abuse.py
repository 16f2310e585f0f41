import random

import pytest

from textloom.llm import abuse


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    random.seed(1)
    entries = {"".join(random.choice("abc") for _ in range(random.randint(2, 7))) for _ in range(60)}
    trie = abuse.Trie(entries)
    for _ in range(300):
        w = "".join(random.choice("abcd") for _ in range(random.randint(2, 7)))
        for k in (0, 1, 2):
            near = sorted((distance(w, e), e) for e in entries if distance(w, e) <= k)
            assert abuse.Automaton(w, k).search(trie) == (near[0][1] if near else None)


@pytest.mark.parametrize("text", ["you m0ron", "you m*ron", "you m o r o n", "you m.o.r.o.n", "you morrron", "you mоrоn", "you mor​on", "you MORON!!", "you mornon", "you mroon", "you mo ron"])
def test_spellings_reach_the_entry(text):
    reader = abuse.Reader(abuse.CLASSES, {"you"})
    assert any("moron" in reader.read(w) for w in abuse.windows(text))


def sample(n, seed=0):
    r = random.Random(seed)
    bad = ["I hope you choke on your {x}, you moron.", "{x} are vermin and should be driven out.", "free porn from {x}, hardcore."]
    good = ["The {x} museum opened in 1946.", "Stir {x} into the pan.", "The report notes that players were called moron and condemns it.", "We study the {x} of early ballads."]
    out = []
    for i in range(n):
        y = int(i % 5 == 0)
        parts = [r.choice(good).format(x=r.choice("oak elm ash fir".split())) for _ in range(4)]
        if y:
            parts.insert(2, r.choice(bad).format(x=r.choice("oak elm ash fir".split())))
        out.append((" ".join(parts), y if r.random() > 0.04 else 1 - y, y))
    return out


def test_learned_model_on_held_out_texts():
    model = abuse.learn([(t, y) for t, y, _ in sample(400)])
    reader = model.reader()
    held = sample(300, 9)
    right = sum((model.score(reader, t)[0] >= model.threshold) == bool(y) for t, _, y in held)
    assert right / len(held) > 0.97
    assert model.score(reader, "I hope you ch0ke on your oak, you m o r o n")[0] >= model.threshold
    assert model.score(reader, None)[0] == float("-inf") and model.score(reader, " .. ")[0] == float("-inf")


def test_without_labels_the_lexicon_decides():
    model = abuse.learn([])
    reader = model.reader()
    assert model.score(reader, "you stupid worthless idiot, kill yourself")[0] > model.score(reader, "the clinic offers education")[0]


def test_tables(spark):
    rows = [(i, t) for i, (t, _, _) in enumerate(sample(120))] + [(900, None), (901, ""), (902, "word " * 20_000 + "I hope you choke on your oak, you moron.")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string")
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(sample(120))] + [(5, None), (0, 0), (None, 1), (7777, 1)], "doc_id bigint, toxic int")
    model = abuse.learn(abuse.labelled_texts(docs, "doc_id", "text", labels, "toxic"))
    out = {r["doc_id"]: r for r in abuse.scored(docs, "doc_id", "text", model).collect()}
    assert len(out) == 123 and out[900]["score"] is None and not out[901]["toxic"] and out[902]["toxic"]
    truth = {i: y for i, (_, _, y) in enumerate(sample(120))}
    assert sum(out[i]["toxic"] == bool(y) for i, y in truth.items()) >= 116
    assert abuse.scored(docs.limit(0), "doc_id", "text", model).count() == 0
    assert abuse.labelled_texts(docs, "doc_id", "text", labels.limit(0), "toxic") == []


def test_misspelt_abuse_needs_the_automata(monkeypatch):
    model = abuse.learn([(t, y) for t, y, _ in sample(400)])
    plants = ["I hope you chokke on your oak, you morron.", "I hope you ch0ke on your elm, you mor*n.", "ash are vermen and should be drivven out.", "free p0rn from fir, hardcorre.", "oak are v3rmin and should be driven oout."]
    read = lambda: [model.score(model.reader(), t)[0] for t in plants]
    found = read()
    monkeypatch.setattr(abuse.Automaton, "search", lambda self, trie: None)
    lost = read()
    assert min(found) >= model.threshold and all(a - b > 3 for a, b in zip(found, lost, strict=True))


def test_runs_of_letters_are_cut_into_words():
    reader = abuse.Reader(abuse.CLASSES, {"you", "are", "such"})
    read = lambda t: [w for x in abuse.windows(t) for w in reader.read(x)]
    assert {"disgusting", "parasite"} <= set(read("a d i s g u s t i n g p a r a s i t e"))
    assert "moron" in read("g m o r o n f")
    assert {"you", "moron"} <= set(read("suchyouaremoron"))
    assert read("incomprehensibilities") == ["?"]


def test_words_told_apart_before_are_those_the_automata_refuse():
    random.seed(3)
    reader = abuse.Reader({"".join(random.choice("abcd") for _ in range(random.randint(3, 8))) for _ in range(80)})
    for _ in range(500):
        w = "".join(random.choice("abcde@1*") if random.random() < 0.2 else random.choice("abcde") for _ in range(random.randint(3, 9)))
        for k in (0, 1, 2):
            assert reader._within(w, k) == abuse.Automaton(w, k).search(reader.trie), (w, k)
