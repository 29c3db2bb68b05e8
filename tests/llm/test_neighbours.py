import numpy as np
import pytest

from marginalia.llm import neighbours as nb


def clustered(n, seed=0, spread=0.25, topics=20):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((topics, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, topics, n)] + spread * rng.standard_normal((n, 64)) / 2
    x[: n // 10] = x[n // 10 : 2 * (n // 10)] + 0.02 * rng.standard_normal((n // 10, 64))
    return (x * rng.choice([0.06, 1, 16], (n, 1))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id bigint, embedding array<float>").selectExpr("*", "'x' AS near", "1 AS cell")


def exact(x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_codes_approximate_and_slack_holds():
    x = nb.normalised(clustered(3000))
    q = nb.fit(x, 3000)
    codes, prefixes = q.encode(x)
    error = ((x - q.decode(codes)) ** 2).sum(1)
    assert error.mean() < 0.2 and codes.shape == (3000, nb.BOOKS)
    home, listed = q.cells(prefixes)
    assert (listed == home[:, None]).any(axis=1).all()
    near, s = exact(x, 10)
    approximate = x.astype(np.float16).astype(np.float32) @ q.decode(codes).T / np.einsum("ij,ij->i", x, q.decode(codes))
    close = s >= 0.95
    assert close.sum() > 300 and (approximate[close] < 0.95 - q.slack(0.95)).mean() < 0.005


def test_recall(spark):
    x = clustered(6000, seed=1)
    df = frame(spark, list(enumerate(x)))
    near, s = exact(x, 10)
    pairs = {(i, int(j)) for i in range(len(x)) for j in near[i] if s[i, j] >= 0.95}
    got = nb.nearest(df, 10, min_similarity=0.95).collect()
    found = {(r.id, r.near) for r in got}
    assert found <= pairs and len({(min(p), max(p)) for p in found} & {(min(p), max(p)) for p in pairs}) >= 0.98 * len({(min(p), max(p)) for p in pairs})
    assert all(abs(r.similarity - s[r.id, r.near]) < 1e-5 for r in got)
    asked = nb.nearest(df, 10, queries=df.where("id % 50 = 0"), beam=96, shortlist=200).collect()
    hits = sum(r.near in near[r.id] for r in asked)
    assert len(asked) == 1200 and hits >= 0.9 * 1200
    assert {r.place for r in asked} == set(range(1, 11))


def tangents(q, x):
    near = q.decode(q.encode(x)[0])
    cosine = np.einsum("ij,ij->i", x, near) / np.linalg.norm(near, axis=1)
    return 1 / np.clip(cosine, 0.1, 1) ** 2 - 1


def test_codebooks_see_all_directions_when_the_sample_is_cut(monkeypatch):
    monkeypatch.setattr(nb, "SAMPLE", 1000)
    x = np.unique(nb.normalised(clustered(6000, seed=3)), axis=0)  # sorted by the first coordinate
    q = nb.fit(x, len(x))
    off = tangents(q, x)
    low, high = off[: len(x) // 2].mean(), off[len(x) // 2 :].mean()
    assert high < 1.5 * low and low < 1.5 * high
    assert abs(q.spread / np.sqrt(off.mean()) - 1) < 0.15


def test_copies_ties_and_unusable_vectors(spark):
    x = clustered(300, seed=2)
    same = x[7]
    rows = list(enumerate(x)) + [(1000 + i, same) for i in range(500)] + [(7, same), (1003, same)]
    bad = x[0].copy()
    bad[3] = np.nan
    infinite = x[0].copy()
    infinite[3] = np.inf
    rows += [(5000, None), (5001, x[0][:63]), (5002, [0.0] * 64), (5003, bad), (5004, [None, *x[0][1:]]), (5005, []), (5006, infinite), (None, x[0])]
    got = nb.nearest(frame(spark, rows), 3, min_similarity=0.9999).collect()
    copies = {}
    for r in got:
        copies.setdefault(r.id, []).append((r.place, r.near))
    assert sorted(copies[7]) == [(1, 1000), (2, 1001), (3, 1002)] and sorted(copies[1000]) == [(1, 7), (2, 1001), (3, 1002)]
    assert sorted(copies[1499]) == [(1, 7), (2, 1000), (3, 1001)] and len(copies) == 501 and len(got) == 1503
    assert not {i for r in got for i in (r.id, r.near)} & set(range(5000, 5010))


def test_hot_vectors_are_joined_by_broadcast(spark, monkeypatch):
    x = clustered(400, seed=4)
    rows = list(enumerate(x)) + [(1000 + i, x[3]) for i in range(200)]
    df = frame(spark, rows)
    key = lambda got: sorted((r.id, r.place, r.near, round(r.similarity, 9)) for r in got.collect())
    hot = key(nb.nearest(df, 5))
    monkeypatch.setattr(nb, "HOT_COPIES", 10**9)  # none is hot: the same by shuffle
    assert key(nb.nearest(df, 5)) == hot and sum(i >= 1000 for i, *_ in hot) == 1000


def test_large_cells_are_salted_at_every_depth():
    rng = np.random.default_rng(1)
    x = nb.normalised(clustered(2000, seed=6))
    q = nb.fit(x, 2000 * 5000)  # each row stands for 5000: cells of too few rows to be divided are large still
    codes, prefixes = q.encode(x)
    home, _ = q.cells(prefixes)
    values, count = np.unique(home, return_counts=True)
    large = [int(v) for v, n in zip(values, count, strict=True) if n * 5000 > 4 * nb.CELL]
    assert large and sum(v in q.salts for v in large) >= 0.9 * len(large)


def test_brute_force_equals_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERY_BLOCK", 7)
    x = clustered(500, seed=5)
    df = frame(spark, list(enumerate(x)) + [(3, x[3]), (9000, None), (9001, [0.0] * 64)]).repartition(5)
    near, s = exact(x, 4)
    got = nb.brute_force(df, df.where("id % 20 = 0"), 4).collect()
    assert {(r.id, r.near) for r in got} == {(i, int(j)) for i in range(0, 500, 20) for j in near[i]} and len(got) == 100


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    df = frame(spark, list(enumerate(clustered(20)))).where(f"id < {n}")
    assert nb.nearest(df, 10).count() == (2 if n == 2 else 0)
