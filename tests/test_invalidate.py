import random
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.config import EngineConfig
from marginalia.index import Index
from marginalia.plans import drift as drifts
from marginalia.plans import invalidate
from marginalia.spec import DocumentSpec, EntityCatalog, Relation
from marginalia.streaming import feed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_references_are_parsed():
    assert invalidate.parse_reference("App:Cat:5") == ("App", "Cat:5")
    for bad in ("", "x", ":5", "x:"):
        with pytest.raises(ValueError):
            invalidate.parse_reference(bad)


def test_batches(spark):
    work = spark.range(2500).select(F.lit("t").alias("entity_type"), F.col("id").alias("entity_id"))
    got = {r.entity_id: r.batch_no for r in invalidate.batches(work, ["entity_type", "entity_id"], 500).collect()}
    assert got == {i: i // 500 for i in range(2500)}
    assert invalidate.batches(work.limit(0), ["entity_id"]).count() == 0
    with pytest.raises(ValueError):
        invalidate.batches(work, ["entity_id"], 0)


def test_fan_out_takes_each_document_once(spark):
    deps = spark.createDataFrame([("a", 1, "c", 5), ("a", 1, "c", 6), ("a", 2, "d", 5), ("a", 3, None, None), ("b", 1, "c", 5)], "entity_type string, entity_id bigint, dependency_type string, dependency_id bigint")
    changes = spark.createDataFrame([("c", 5), ("c", 6), ("c", 5), ("c", 77), (None, None)], "dependency_type string, dependency_id bigint")
    assert {tuple(r) for r in invalidate.fan_out(changes, deps).collect()} == {("a", 1, 0), ("b", 1, 0)}
    assert {tuple(r) for r in invalidate.with_dependents(changes, deps).distinct().collect()} == {("c", 5), ("c", 6)}


def test_ends_of_blocks_equal_the_loop():
    rng = random.Random(1)
    for _ in range(300):
        start, ttl = rng.randrange(-50, 50) * 10, 10
        times = np.array(sorted(rng.sample(range(start, start + 400), rng.randrange(1, 60))), np.int64)
        hi, until = invalidate.leaving(times, start, ttl)
        assert (np.diff(hi) > 0).all() and (np.diff(until) > 0).all()
        for u in [None, *range(start - 5, start + ttl + 1)]:
            places, want = invalidate.passing(times, u, ttl)
            at = 0 if u is None else np.searchsorted(hi, u)
            assert (until[at] if at < len(hi) else u) == want


@pytest.mark.parametrize("seed", range(3))
def test_throttle_equals_the_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(invalidate, "BLOCK_TTLS", 8 if seed else 1024)
    rng = random.Random(seed)
    ttl = 1000
    events = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([rng.randrange(60_000), rng.randrange(3 * 4096 * ttl)])) for _ in range(800)]
    events += events[:50] + [(None, 5), (1, None)]
    want = set()
    for key in (1, 2, 3):
        until = None
        for t in sorted({t for k, t in events if k == key and t is not None}):
            if until is None or t >= until:
                want.add((key, t))
                until = t + ttl
    df = spark.createDataFrame(events, "k bigint, us bigint")
    got = [tuple(r) for r in invalidate.throttle(df, ["k"], "us", ttl).collect()]
    assert set(got) == want and len(got) == len(want)
    assert invalidate.throttle(df.limit(0), ["k"], "us", ttl).count() == 0


def test_throttle_runs_without_gaps(spark):
    df = spark.range(20_000).selectExpr("1L AS k", "id * 900 AS us")  # never a gap of a ttl: one piece over several blocks
    got = sorted(r.at for r in invalidate.throttle(df, ["k"], "us", 1000).collect())
    assert got == [i * 1800 for i in range(10_000)]


def test_drift_sets_ignore_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 1)], "entity_id bigint, dependency_type string, dependency_id bigint")
    b = spark.createDataFrame([(1, "y", 2), (1, "x", 1)], "entity_id bigint, dependency_type string, dependency_id bigint")
    doc = spark.createDataFrame([(1, "c", "g")], "entity_id bigint, content_hash string, configuration_hash string")
    assert drifts.drift(doc, doc, a, b).count() == 0
    assert [r.drift for r in drifts.drift(doc, doc, a, b.where("dependency_id = 1")).collect()] == [["dependencies"]]


def stream_catalog(spark, names, category):
    c = EntityCatalog()
    c.register("category", spark.createDataFrame([(1, category)], "id bigint, name string"))
    c.register("product", spark.createDataFrame([(i, n, 1) for i, n in names], "id bigint, name string, category_id bigint"), relations={"category": Relation("one", "category", local="category_id")}, spec=DocumentSpec(("name",), ("category.name",)))
    return c


def test_feed_syncs_forgets_and_fans_out(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "entity_type string, entity_id bigint, op string, at timestamp"

    def play(events, ix):
        folder = str(tmp_path / "events")
        spark.createDataFrame(events, schema).write.mode("append").parquet(folder)
        feed.follow(ix, spark.readStream.schema(schema).parquet(folder), str(tmp_path / "checkpoint")).awaitTermination()

    ix = Index(spark, str(tmp_path / "index"), stream_catalog(spark, [(1, "a"), (2, "b")], "old"), EngineConfig())
    play([("product", 1, "created", start), ("product", 2, "created", start), ("product", 2, "updated", start + timedelta(seconds=1)), ("product", 9, "created", start)], ix)
    before = {r.entity_id: r.content_hash for r in ix.table("documents").collect()}
    assert set(before) == {1, 2}
    ix = Index(spark, str(tmp_path / "index"), stream_catalog(spark, [(1, "a")], "new"), EngineConfig())
    play([("product", 2, "deleted", start), ("category", 1, "updated", start), ("category", 1, "updated", start + timedelta(seconds=1))], ix)
    after = {r.entity_id: r.content_hash for r in ix.table("documents").collect()}
    assert set(after) == {1} and after[1] != before[1]


def test_feed_throttles_over_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "entity_type string, entity_id bigint, op string, at timestamp"
    ix = Index(spark, str(tmp_path), stream_catalog(spark, [(1, "a"), (2, "b")], "c0"), EngineConfig(debounce_seconds=10))
    ix.sync("product")
    seen = []
    for n, seconds in enumerate([(0, 3), (9, 10), (12, 15), (19.5,), (21,)]):
        ix = Index(spark, str(tmp_path), stream_catalog(spark, [(1, "a"), (2, "b")], f"c{n + 1}"), EngineConfig(debounce_seconds=10))
        synced = []
        ix.listeners.append(lambda e, out=synced: out.append(e.detail.get("count")))
        feed.process(ix, spark.createDataFrame([("category", 1, "updated", start + timedelta(seconds=s)) for s in seconds] + [(None, 1, "updated", start), ("category", None, "updated", start)], schema))
        seen.append(synced)
    # 0 passes, 3 and 9 fall to it, 10 passes, 12 to 19.5 fall to that, 21 passes.
    assert seen == [[2], [2], [], [], [2]]
    assert [r.until for r in ix.store.read(spark, "throttle").collect()] == [int((start - datetime(1970, 1, 1)).total_seconds() + 31) * 1_000_000]


def test_throttle_goes_on_from_what_was_left(spark):
    df = spark.createDataFrame([("a", 5), ("a", 12), ("a", 15), ("b", 1), ("b", None), (None, 2)], "k string, us bigint")
    left = spark.createDataFrame([("a", 11), ("a", 3), ("z", 99)], "k string, until bigint")
    assert {tuple(r) for r in invalidate.throttle(df, ["k"], "us", 10, left).collect()} == {("a", 12), ("b", 1)}


def test_stream_throttle_over_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "k bigint, ts timestamp"
    folder = str(tmp_path / "in")
    out = []
    for n, seconds in enumerate([(0, 3, 11), (12, 20, 21.5), (40,)]):
        spark.createDataFrame([(1, start + timedelta(seconds=s)) for s in seconds], schema).coalesce(1).write.mode("append").parquet(folder)
        events = spark.readStream.schema(schema).parquet(folder)
        passed = feed.throttled(events, ["k"], "ts", 10_000_000)
        query = passed.writeStream.foreachBatch(lambda df, _: out.extend(r.ts for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((t - start).total_seconds() for t in out) == [0, 11, 21.5, 40]
