import random
from datetime import datetime

import pytest

from marginalia.operators import diffing, hotkeys, incremental, references
from marginalia.operators import intervals as iv
from marginalia.runtime import hash_sample
from marginalia.sources.store import CommitConflict, SnapshotStore

# -- intervals -------------------------------------------------------------


def numbers(df, keys=("k",)):
    return {(*[r[k] for k in keys], n) for r in df.collect() for n in range(r.lo, r.hi + 1)}


def test_interval_algebra_equals_sets(spark):
    rng = random.Random(3)
    near = [b * iv.BLOCK + d for b in (-1, 0, 1, 2) for d in range(-4, 5)]
    a = [(rng.choice("xy"), rng.choice(near)) for _ in range(90)] + [("x", None), (None, 5)]
    b = [(rng.choice("xy"), rng.choice(near)) for _ in range(40)] + [("z", 1)]
    da, db = (iv.islands(spark.createDataFrame(rows, "k string, n bigint"), ["k"], "n") for rows in (a, b))
    sa, sb = {x for x in a if x[1] is not None}, set(b)
    assert numbers(da) == sa
    assert numbers(iv.subtract(da.where("k IS NOT NULL"), db, ["k"])) == {x for x in sa if x[0]} - sb
    merged = iv.merge(da.where("k IS NOT NULL"), ["k"], db)
    assert numbers(merged) == {x for x in sa if x[0]} | sb
    rows = sorted((r.k, r.lo, r.hi) for r in merged.collect())
    assert all(x[0] != y[0] or y[1] - x[2] > 1 for x, y in zip(rows, rows[1:]))  # as few as can be
    assert {tuple(r) for r in iv.expand(merged, ["k"], "n").collect()} == numbers(merged)
    empty = da.limit(0)
    assert iv.merge(empty, ["k"]).count() == 0 and numbers(iv.subtract(da, empty, ["k"])) >= {x for x in sa if x[0]}


def test_intervals_of_any_length_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(iv, "BLOCK_BITS", 2)  # many blocks, nodes of several levels and regions
    monkeypatch.setattr(iv, "BLOCK", 4)
    rng = random.Random(8)
    some = lambda n, most: [(rng.choice("xy"), lo := rng.randrange(-90, 300), lo + rng.randrange(most)) for _ in range(n)]
    a, b = some(25, 60) + [("x", 5, 4), ("x", None, 3), (None, 1, 2)], some(12, 150) + [("y", 7, 7)]
    da, db = (spark.createDataFrame(x, "k string, lo bigint, hi bigint") for x in (a, b))
    sets = lambda rows: {(k, n) for k, lo, hi in rows if k and lo is not None for n in range(lo, hi + 1)}
    assert numbers(iv.subtract(da, db, ["k"])) == sets(a) - sets(b)
    for merged, want in ((iv.merge(da, ["k"], db), sets(a) | sets(b)), (iv.merge(db, ["k"]), sets(b))):
        rows = sorted((r.k, r.lo, r.hi) for r in merged.collect())
        assert numbers(merged) == want and all(x[0] != y[0] or y[1] - x[2] > 1 for x, y in zip(rows, rows[1:]))


def test_merged_intervals_are_not_unrolled(spark):
    wide = spark.createDataFrame([("x", 0, 10**15), ("x", 10**15 + 1, 10**15 + 5)], "k string, lo bigint, hi bigint")
    few = spark.createDataFrame([("x", 10**9, 10**9 + 9), ("x", 10**15 - 2, 10**15 + 8)], "k string, lo bigint, hi bigint")
    assert [tuple(r) for r in iv.merge(wide, ["k"]).collect()] == [("x", 0, 10**15 + 5)]
    assert [tuple(r)[1:] for r in iv.subtract(few, wide, ["k"]).collect()] == [(10**15 + 6, 10**15 + 8)]


def test_long_intervals_span_blocks(spark):
    wide = spark.createDataFrame([("x", 5, 3 * iv.BLOCK + 7), ("x", 3 * iv.BLOCK + 8, 3 * iv.BLOCK + 9)], "k string, lo bigint, hi bigint")
    assert [tuple(r) for r in iv.merge(wide, ["k"]).collect()] == [("x", 5, 3 * iv.BLOCK + 9)]
    hole = spark.createDataFrame([("x", 10, 2 * iv.BLOCK)], "k string, lo bigint, hi bigint")
    assert [tuple(r)[1:] for r in iv.merge(iv.subtract(wide, hole, ["k"]), ["k"]).orderBy("lo").collect()] == [(5, 9), (2 * iv.BLOCK + 1, 3 * iv.BLOCK + 9)]


# -- incremental -----------------------------------------------------------

CURRENT = "table_name string, record_id bigint, version int, content_hash string, configuration_hash string, compare_configuration boolean"
LEDGER = "table_name string, record_id bigint, run_id int, content_hash string, configuration_hash string"


def test_pending_records(spark):
    current = [
        ("d", 1, 1, "a", "g", True), ("d", 1, 1, "a", "g", True), ("d", 2, 1, "old", "g", True), ("d", 2, 2, "b", "g", True), ("d", 3, 1, None, "g", True), ("d", 4, 1, "a", None, True),
        ("d", 5, 1, "a", "g", True), ("d", 6, 1, "a", "g", True), ("c", 1, 0, "a", None, False), ("c", 2, 0, "a", None, False), ("d", None, 1, "a", "g", True), (None, 9, 1, "a", "g", True),
    ]
    ledger = [
        ("d", 1, 1, "a", "g"), ("d", 1, 2, "A", "g"), ("d", 2, 1, "b", "g"), ("d", 2, 1, "b", "g"), ("d", 3, 1, None, "g"), ("d", 4, 1, "a", "g"), ("d", 6, 3, "a", "other"), ("d", 6, 1, "a", "g"),
        ("c", 1, 1, "a", "whatever"), ("c", 2, 9, "a", None), ("c", 77, 1, "gone", None), ("d", None, 1, "a", "g"),
    ]
    runs = spark.createDataFrame([(1, "succeeded"), (1, "succeeded"), (2, "failed"), (3, "succeeded"), (9, "abandoned"), (None, None)], "run_id int, run_state string")
    df = lambda rows, schema: spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS at", "'y' AS then")
    got = {tuple(r) for r in incremental.pending_records(df(current, CURRENT), df(ledger, LEDGER), runs).collect()}
    # 1 as recorded (the failed run doesn't count), 2 its newest version recorded, 3 null equals null, 4 null is no hash,
    # 5 never recorded, 6 recorded last with another configuration; c 1 fine, c 2 only by an abandoned run.
    assert got == {("d", 4), ("d", 5), ("d", 6), ("c", 2)}
    nothing = incremental.pending_records(df([], CURRENT), df(ledger, LEDGER), runs)
    assert nothing.count() == 0
    assert incremental.pending_records(df(current, CURRENT), df([], LEDGER), runs.limit(0)).count() == 8


def test_processor_skips_and_repeats_nothing(spark, tmp_path):
    p = incremental.IncrementalProcessor(spark, SnapshotStore(spark, str(tmp_path)))
    source = lambda ns: spark.createDataFrame([("t", n, f"v{n}") for n in ns] + [("t", None, "no")], "table_name string, seq bigint, v string")
    take = lambda df: df.select("table_name", "seq", "v")
    assert p.run(source([1, 2, 3, 7]), "seq", take) == 2
    with pytest.raises(Exception):
        p.run(source([1, 2, 3, 7, 8]), "seq", lambda df: df.selectExpr("raise_error('dead') AS table_name", "seq", "v"))
    assert p.run(source([1, 2, 3, 7]), "seq", take) == 0
    assert p.run(source([1, 2, 3, 5, 7, 8]), "seq", take) == 2  # 5 commits late, 8 was lost with the failure
    out = sorted(r.seq for r in p.store.read(spark, "output").collect())
    assert out == [1, 2, 3, 5, 7, 8]
    assert sorted((r.lo, r.hi) for r in p.store.read(spark, "intervals").collect()) == [(1, 3), (5, 5), (7, 8)]


def test_two_runners_on_one_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    one, other = (incremental.IncrementalProcessor(spark, store) for _ in range(2))
    source = spark.createDataFrame([("t", n) for n in (1, 2, 3)] + [(None, 4)], "table_name string, seq bigint")
    more = source.unionByName(spark.createDataFrame([("t", 9)], source.schema))

    def overtaken(df):
        if not store.version:
            other.run(more, "seq", lambda d: d)
        return df

    assert one.run(source, "seq", overtaken) == 0  # all it had begun was done by the other meanwhile
    assert sorted(r.seq for r in store.read(spark, "output").collect()) == [1, 2, 3, 9]
    assert sorted((r.lo, r.hi) for r in store.read(spark, "intervals").collect()) == [(1, 3), (9, 9)]
    always = incremental.IncrementalProcessor(spark, store, attempts=2)

    def each_time(df):
        store.commit({"other": spark.range(1)})
        return df

    with pytest.raises(CommitConflict):
        always.run(more.unionByName(spark.createDataFrame([("t", 11)], source.schema)), "seq", each_time)
    assert store.read(spark, "output").count() == 4


def test_torn_pointers_are_passed_over(spark, tmp_path):
    p = incremental.IncrementalProcessor(spark, SnapshotStore(spark, str(tmp_path)))
    source = lambda ns: spark.createDataFrame([("t", n) for n in ns], "table_name string, seq bigint")
    p.run(source([1, 2]), "seq", lambda d: d)
    (tmp_path / "commit-000000002.json").write_text("")  # as a writer leaves it that dies between creating and filling
    assert p.store.version == 1 and p.run(source([1, 2]), "seq", lambda d: d) == 0
    assert p.run(source([1, 2, 3]), "seq", lambda d: d) == 1 and p.store.version == 3
    assert sorted(r.seq for r in p.store.read(spark, "output").collect()) == [1, 2, 3]
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".pointer")]


# -- hot keys --------------------------------------------------------------


def test_quantiles_equal_sorting(spark):
    rng = random.Random(5)
    rows = [(i, "hot", 1, rng.choice([rng.randrange(-(10**17), 10**17), 5, 6])) for i in range(3000)]
    rows += [(10_000 + i, rng.choice("abc"), rng.randrange(30), rng.randrange(50)) for i in range(1500)]
    rows += [(20_000, "only null", 1, None), (20_001, "one", 1, 9), (20_002, None, 1, 1), (20_003, "x", None, 1), (None, "y", 1, 1)]
    rows += rng.sample(rows, 700)  # redelivered
    # Key and value are called like internal columns.
    df = spark.createDataFrame(rows, "id bigint, rank string, bin int, lo bigint").selectExpr("*", "1 AS n", "'q' AS q0")
    qs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["rank"], r["bin"]): tuple(r)[2:] for r in hotkeys.per_key_quantiles(df, ["rank", "bin"], "id", "lo", qs).collect()}
    groups = {}
    for i, a, b, v in set(rows):
        if None not in (i, a, b):
            groups.setdefault((a, b), []).append(v)
    for key, values in groups.items():
        real = sorted(v for v in values if v is not None)
        at = lambda p: real[max(-(-int(p * 1000) * len(real) // 1000), 1) - 1] if real else None
        assert got[key] == (len(values), len(real), *[at(p) for p in qs]), key
    assert set(got) == set(groups)
    assert {(r["rank"], r["bin"]) for r in hotkeys.heavy_keys(df, ["rank", "bin"], "id", "lo", 0.02).select("rank", "bin").collect()} == {k for k, v in groups.items() if len(v) >= 0.02 * sum(map(len, groups.values()))}
    assert hotkeys.per_key_quantiles(df.limit(0), ["rank", "bin"], "id", "lo").count() == 0
    counts = {(r["rank"], r["bin"]): r["n"] for r in hotkeys.key_counts(df, ["rank", "bin"], "id").collect()}
    assert counts == {k: len(v) for k, v in groups.items()}


def test_share_is_inclusive(spark):
    df = spark.createDataFrame([(i, i % 50, 0) for i in range(100)], "id bigint, k bigint, v bigint")
    assert hotkeys.heavy_keys(df, ["k"], "id", "v", 0.02).count() == 50


@pytest.mark.parametrize("share", [0.001, 0.02, 0.3, 1.0])
def test_heavy_keys_equal_counting(spark, share):
    rng = random.Random(9)
    rows = [(i, rng.choice([1, 1, 1, 2, 2, 3] + [rng.randrange(400)] * 6)) for i in range(2000)] + [(9000, None), (None, 1)]
    df = spark.createDataFrame(rows + rows[:300], "id bigint, k bigint").selectExpr("*", "1 AS n", "'x' AS q")
    counts = {}
    for i, k in set(rows):
        if i is not None and k is not None:
            counts[k] = counts.get(k, 0) + 1
    got = {(r.k, r.n) for r in hotkeys.heavy_keys(df, ["k"], "id", share=share).collect()}
    assert got == {(k, n) for k, n in counts.items() if n >= share * 2000}
    assert hotkeys.heavy_keys(df.limit(0), ["k"], "id", share=share).count() == 0


def test_selection_over_the_whole_range(spark):
    ends = [-(2**63), -1, 0, 2**63 - 1]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(ends)], "id bigint, k string, v bigint")
    assert tuple(hotkeys.per_key_quantiles(df, ["k"], "id", "v", (0.25, 0.5, 0.75, 1.0)).first())[3:] == tuple(ends)


def test_hash_sample_is_bounded_and_stable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in hash_sample(d, "k", 700).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 700 and 8000 < sum(a) / 700 < 12_000
    assert hash_sample(df.limit(5), "k", 700).count() == 5 and hash_sample(df.limit(0), "k", 700).count() == 0


# -- references ------------------------------------------------------------


def test_orphans(spark):
    t = lambda day: datetime(2024, 1, day)
    refs = [
        (1, "a", 1, t(5)), (2, "a", 2, t(5)), (3, "a", 3, t(5)), (4, "a", 4, t(5)), (5, "a", 5, t(5)), (6, "a", 6, t(5)), (7, "a", 6, None), (8, "b", 1, t(5)), (9, None, 1, t(5)), (10, "a", None, t(5)), (11, "a", 7, t(5)),
    ]
    refs += [(100 + i, "a", 1, t(5)) for i in range(3000)] + [(5000 + i, "a", 99, None) for i in range(3000)]  # heavy keys, one of them dangling
    df = spark.createDataFrame(refs, "id bigint, kind string, key bigint, created_at timestamp").selectExpr("*", "'z' AS born", "1 AS n", "'t' AS ref_table", "'f' AS ref_field", "coalesce(date_format(created_at, 'yyyy-MM'), 'none') AS ref_month")
    targets = spark.createDataFrame(
        [("a", 1, t(1)), ("a", 1, t(1)), ("a", 2, t(1)), ("a", 3, t(3)), ("a", 4, t(2)), ("a", 6, t(6)), ("a", 7, None), ("a", None, t(1))], "kind string, key bigint, created_at timestamp"
    )
    deletions = spark.createDataFrame([("a", 2, t(1)), ("a", 3, t(2)), ("a", 4, t(9)), ("a", 4, t(1)), ("a", 5, t(1)), (None, None, t(1)), ("a", 1, None)], "kind string, key bigint, deleted_at timestamp")
    got = {r.id for r in references.orphans(df, targets, deletions).collect()}
    # 2 deleted the moment it was made, 3 made again after its deletion, 4 deleted later, 5 missing, 6 made after the reference, 8 other kind.
    assert {i for i in got if i < 5000} == {2, 4, 5, 6, 8} and len(got) == 5 + 3000
    counts = {tuple(r) for r in references.orphan_counts(df.drop("n"), targets, deletions).collect()}
    assert counts == {("t", "f", "2024-01", 5), ("t", "f", "none", 3000)}
    assert references.orphans(df.limit(0), targets, deletions).count() == 0
    assert references.orphans(df, targets.limit(0), deletions.limit(0)).count() == len([1 for r in refs if r[1] and r[2] is not None])


# -- differences -----------------------------------------------------------


def test_differences(spark):
    rng = random.Random(1)
    a = [(i, 1, f"h{i}", i % 7, None) for i in range(400)] + [(5, 2, "new", 5, "x"), (5, 3, "newest", None, "x"), (None, 1, "n", 1, None)]
    b = [(i, 1, f"h{i}" if i % 9 else f"H{i}", i % 7 if i % 11 else None, None) for i in range(20, 420)] + [(6, 4, "h6", 6, "x")]
    a, b = a + rng.sample(a, 100), b + rng.sample(b, 100)
    rng.shuffle(a)
    rng.shuffle(b)
    schema = "k bigint, s int, f0 string, f1 bigint, v string"  # called like internal columns
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = [tuple(r) for r in diffing.differences(da, db, "k", "s", ["f0", "f1", "v"]).collect()]

    def newest(rows):
        best = {}
        for r in rows:
            if r[0] is not None and (r[0] not in best or r[1] > best[r[0]][1]):
                best[r[0]] = r
        return best

    x, y = newest(a), newest(b)
    want = {(k, "missing_in_copy") for k in x.keys() - y.keys()} | {(k, "missing_in_main") for k in y.keys() - x.keys()}
    want |= {(k, f) for k in x.keys() & y.keys() for f, i in (("f0", 2), ("f1", 3), ("v", 4)) if x[k][i] != y[k][i]}
    assert len(got) == len(set(got)) and set(got) == want
    assert diffing.differences(da.limit(0), db.limit(0), "k", "s", ["f0"]).count() == 0
    assert {r.field_name for r in diffing.differences(da.limit(0), db, "k", "s", ["f0"]).collect()} == {"missing_in_main"}


def test_a_key_with_very_many_versions(spark):
    main = spark.range(50_000).selectExpr("7L AS id", "CAST(id AS int) AS version", "CAST(id AS string) AS x")
    copy = spark.createDataFrame([(7, 1, "49999")], "id bigint, version int, x string")
    assert diffing.differences(main, copy, "id", "version", ["x"]).count() == 0
    assert [tuple(r) for r in diffing.differences(main, copy.selectExpr("id", "version", "'no' AS x"), "id", "version", ["x"]).collect()] == [(7, "x")]
