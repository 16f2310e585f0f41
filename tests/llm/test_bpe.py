import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")

ODD = ["", " ", "  a", "Don't they'll", "naïve café 東京 Ελλάδα привет", "👩‍🚀 🧪🧪", "a\x00b\x1c\x1d​ 　x", "<|endoftext|> <|startoftext|>", "x" * 5000, "ab" * 4000, " " * 3000, "\n\n\t \r\n", "aaaaaaa bbbbb 111111111", "=-=-=-=" * 500]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.load_ranks(), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks())


def test_equals_public_library(reference, encoder):
    for t in ODD:
        assert encoder.encode(t) == reference(t)
    assert encoder.encode(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_and_round_trip(reference, encoder, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert ids == reference(text)
    assert b"".join(encoder.tokens[i] for i in ids).decode() == text


def test_long_piece_is_not_quadratic(encoder):
    import time

    times = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        encoder.piece(b"qwertyuiopasdfghjklzxcvbnm" * (n // 26))
        times.append(time.perf_counter() - start)
    assert times[1] < 10 * times[0]


def test_queue_pops_lowest_rank_first():
    q = bpe.RankQueue(50_257)
    for rank, place in ((50_256, 1), (3, 9), (64, 2), (3, 4), (4096, 0)):
        q.push(rank, place)
    assert [q.pop() for _ in range(4)] == [(3, [4, 9]), (64, [2]), (4096, [0]), (50_256, [1])]
    assert q.pop() is None


def test_table(spark, reference):
    rows = [*enumerate(ODD), (99, None), (99, "again"), (99, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    assert got == sorted((i, reference(t) if t else []) for i, t in rows)
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_vocabulary_where_a_merge_makes_a_lower_rank():
    random.seed(5)
    for _ in range(300):
        ranks = {bytes([b]): 1000 + b for b in range(256)}
        tokens = {bytes(random.choice(b"abc") for _ in range(random.randint(2, 4))) for _ in range(12)}
        ranks |= {t: r for t, r in zip(tokens, random.sample(range(500), len(tokens)), strict=True)}
        encoder = bpe.Encoder(ranks)
        for _ in range(10):
            data = bytes(random.choice(b"abc") for _ in range(random.randint(1, 14)))
            parts = [data[i : i + 1] for i in range(len(data))]
            while True:
                pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not pairs:
                    break
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert encoder.piece(data) == [ranks[p] for p in parts]
