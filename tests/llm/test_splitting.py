import hashlib
import itertools
import random

import pytest

from marginalia.llm import splitting


def greedy(n, boundaries, most, overlap):
    out, start, own = [], 0, set(boundaries)
    if not n:
        return out
    while n - start > most:
        end = next((e for e in range(start + most, start + overlap, -1) if e in own), start + most)
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def least_cost(n, boundaries, most, overlap):
    """By trying every cut after every token."""
    best = {}

    def value(start):
        if n - start <= most:
            return ((most - (n - start)) / most) ** 2
        if start not in best:
            best[start] = min(((start + most - e) / most) ** 2 + (0 if e in boundaries else splitting.CUT_PENALTY) + value(e - overlap) for e in range(start + overlap + 1, start + most + 1))
        return best[start]

    return value(0)


def cost_of(pieces, boundaries, most, n):
    return sum(((s + most - e) / most) ** 2 + (0 if e == n or e in boundaries else splitting.CUT_PENALTY) for s, e in pieces)


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        n, most = rng.randrange(60), rng.randrange(1, 12)
        overlap = rng.randrange(most)
        boundaries = sorted(rng.sample(range(1, n), rng.randrange(n // 2 + 1))) if n > 2 else []
        assert splitting.pieces(n, boundaries, most, overlap, splitting.FIRST) == greedy(n, boundaries, most, overlap)
        got = splitting.pieces(n, boundaries, most, overlap)
        assert all(e - s <= most for s, e in got) and all(a[1] - overlap == b[0] for a, b in itertools.pairwise(got))
        if got:
            assert got[0][0] == 0 and got[-1][1] == n
            least = least_cost(n, set(boundaries), most, overlap)
            assert cost_of(got, set(boundaries), most, n) == pytest.approx(least)
            for order in (splitting.FIRST, splitting.TOTAL):
                _, value = splitting.table(n, boundaries, most, overlap, order)
                assert value[0] == pytest.approx(cost_of(splitting.pieces(n, boundaries, most, overlap, order), set(boundaries), most, n))
    for bad in ((4, 4), (0, 0), (4, -1)):
        with pytest.raises(ValueError):
            splitting.pieces(10, [], *bad)
    with pytest.raises(ValueError):
        splitting.pieces(10, [], 5, 1, "other")


def test_the_last_piece_is_weighed():
    assert splitting.pieces(21, [10, 19], 20, 0) == [(0, 10), (10, 21)]
    assert splitting.pieces(21, [10, 19], 20, 0, splitting.FIRST) == [(0, 19), (19, 21)]


def test_tables_larger_than_a_window_of_rows(monkeypatch):
    want = splitting.pieces(3000, list(range(7, 3000, 31)), 40, 6, splitting.FIRST)
    monkeypatch.setattr(splitting, "_ROWS", 100)
    assert splitting.pieces(3000, list(range(7, 3000, 31)), 40, 6, splitting.FIRST) == want == greedy(3000, range(7, 3000, 31), 40, 6)


def test_boundaries():
    text = 'One two. Three "four!" five\n\nsix 3.5 seven?) \r\n \r\n eight　九。 ten\x1celeven'
    tokens, boundaries = splitting.tokens_and_boundaries(text)
    assert tokens == ["One", "two.", "Three", '"four!"', "five", "six", "3.5", "seven?)", "eight", "九。", "ten\x1celeven"]
    assert boundaries == [2, 4, 5, 8, 10]
    assert splitting.tokens_and_boundaries("a." + "”" * 40 + " b")[1] == [1]
    assert splitting.tokens_and_boundaries("") == ([], [])


def test_dataframe(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "a b c. d e f", 4, 1), (1, "a b c. d e f", 4, 1), (2, None, 4, 1), (3, "", 4, 1), (4, " \n", 4, 1), (5, "a b", 4, 1), (6, long, 400, 40), (7, "a b c", None, 1), (8, "a b c", 1, None), (9, "a b c", 0, 0), (10, "a b c", 2, 2), (None, "a b c", 2, 0)]
    df = spark.createDataFrame(rows, "document_id bigint, content string, max_tokens int, overlap_tokens int").selectExpr("*", "1 AS chunk_index", "'x' AS content_hash")
    got = splitting.split(df, order=splitting.FIRST).collect()
    one = sorted((r.chunk_index, r.content_hash) for r in got if r.document_id == 1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert one == [(0, sha("a b c.")), (1, sha("c. d e f"))]
    assert {r.document_id for r in got} == {1, 6, None}
    assert sum(r.document_id == 6 for r in got) == -(-(200_000 - 400) // 360) + 1
    whole = splitting.split(df, oversized_only=False)
    assert {r.document_id for r in whole.collect()} == {1, 5, 6, None}
    assert splitting.split(df.limit(0)).count() == 0
