import os
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
RANKS = bpe.read_ranks() if os.path.exists(bpe.VOCABULARY) else {}


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


ODD = ["", " ", "\r\n\r\n  x", "<|endoftext|>", "áé", "🙂👩‍🔧", "नमस्ते", "ЯКОРЬ ǅ İ ß", "x" * 300, "ab" * 5000, " " * 1000 + "x", "\x00\x01", "it's we'll I'd", "12345 678", "​zero​width"]


def test_equals_a_public_encoder(theirs):
    mine = bpe.Encoder(RANKS)
    assert [mine.encode(t) for t in ODD] == [theirs.encode_ordinary(t) for t in ODD]
    assert mine.encode(None) == []


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.Encoder(RANKS).encode(text)
    back = {i: b for b, i in RANKS.items()}
    assert b"".join(back[i] for i in ids) == text.encode()


def slow_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        if not pairs or min(pairs)[0] == 1 << 60:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_equals_the_plain_loop():
    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeabinthe  ") for _ in range(rng.randrange(40)))
        assert bpe.merge(piece, RANKS) == slow_merge(piece, RANKS)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    e = bpe.Encoder(RANKS)
    for i in range(100):
        e.encode(f"word{i}q")
    assert len(e) <= 10 and e.encode("word5q") == bpe.Encoder(RANKS).encode("word5q")


def test_dataframe(spark, theirs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids")
    got = bpe.encode(df)
    assert [f.simpleString() for f in got.schema] == ["doc_id:bigint", "ids:array<int>"]
    out = {r.doc_id: r.ids for r in got.collect()}
    assert out[100] == [] and out[0] == [] and out[4] == theirs.encode_ordinary(ODD[4]) and got.count() == len(rows)
    assert bpe.encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bpe.MAX_VOCABULARY_BYTES, keep = 10, bpe.MAX_VOCABULARY_BYTES
        try:
            bpe.read_ranks()
        finally:
            bpe.MAX_VOCABULARY_BYTES = keep
