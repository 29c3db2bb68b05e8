import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.config import EngineConfig
from marginalia import commands
from marginalia.index import Index, UnsupportedBackend
from marginalia.plans import embed as embeds
from marginalia.plans import reconcile
from marginalia.plans import search as searches
from marginalia.sources.store import CommitConflict, SnapshotStore
from marginalia.spec import DocumentSpec, EntityCatalog, InvalidRelationPath, Relation
from marginalia.testing import RecordingIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class Keywords:
    provider = "keywords"

    def embed(self, texts, model, dimensions):
        return [[float("speaker" in t.lower()), float("laptop" in t.lower()), 0.1] for t in texts]


def catalog(spark, names=("Speaker", "Laptop"), category="Electronics"):
    c = EntityCatalog()
    c.register("category", spark.createDataFrame([(1, category)], "id bigint, name string"))
    rows = [(i + 1, n, 1) for i, n in enumerate(names)]
    c.register(
        "product", spark.createDataFrame(rows, "id bigint, name string, category_id bigint"),
        relations={"category": Relation("one", "category", local="category_id")}, spec=DocumentSpec(("name",), ("category.name",)),
    )
    return c


def index(spark, path, c=None, embedder=None, **config):
    return Index(spark, str(path), c or catalog(spark), EngineConfig(**{"dimensions": 3, **config}), embedder or Keywords())


def statuses(ix):
    return {r.entity_id: (r.status, r.version, r.last_error) for r in ix.table("documents").collect()}


def test_lifecycle(spark, tmp_path):
    ix = index(spark, tmp_path)
    events = []
    ix.listeners.append(lambda e: events.append(e.kind))
    assert ix.sync("product") == {"product": {"synced": 2, "skipped": 0, "failed": 0}}
    assert statuses(ix) == {1: ("pending", 1, None), 2: ("pending", 1, None)}
    assert {tuple(r) for r in ix.table("dependencies").select("entity_id", "dependency_type", "dependency_id").collect()} == {(1, "category", 1), (2, "category", 1)}
    assert ix.embed("product") == {"embedded": 2, "failed": 0}
    assert statuses(ix) == {1: ("synced", 1, None), 2: ("synced", 1, None)}
    assert ix.sync("product")["product"] == {"synced": 0, "skipped": 2, "failed": 0}  # nothing changed: nothing written
    assert events == ["synced", "embedded"]
    ix.sync("product", force=True)
    assert statuses(ix)[1] == ("pending", 2, None)
    assert ix.table("chunks").where("embedding IS NULL").count() == 0  # forced, unchanged: vectors stay
    ix.rebuild("product")
    assert statuses(ix)[2][1] == 3
    ix.embed("product")
    renamed = index(spark, tmp_path, catalog(spark, ("Speaker", "Tablet")))
    assert renamed.sync()["product"] == {"synced": 1, "skipped": 1, "failed": 0}
    assert [r.entity_id for r in renamed.table("chunks").where("embedding IS NULL").collect()] == [2]
    moved = index(spark, tmp_path, catalog(spark, ("Speaker", "Tablet")), model="other")
    moved.sync("product")
    assert moved.table("chunks").where("embedding IS NULL").count() == 2 and set(statuses(moved).values()) == {("pending", 3, None)}


def test_search(spark, tmp_path):
    ix = index(spark, tmp_path)
    assert ix.search("product", "a laptop").count() == 0  # nothing is embedded
    ix.sync("product", embed=True)
    names = lambda df: [r.name for r in df.collect()]
    assert names(ix.search("product", "a laptop")) == ["Laptop", "Speaker"]
    assert names(ix.search("product", "speaker")) == ["Speaker", "Laptop"]
    assert names(ix.search("product", "speaker", limit=1)) == ["Speaker"]
    assert names(ix.search("product", "speaker", min_similarity=0.9)) == ["Speaker"]
    assert names(ix.search("product", "speaker", scope=F.col("entity_id") != 1)) == ["Laptop"]
    rows = ix.search_with_scores("product", "a laptop", with_text=True).collect()
    assert rows[0].score == pytest.approx(1, abs=1e-6) and rows[1].distance == pytest.approx(0.990099, abs=1e-5)
    assert rows[0].chunk_text == "name: Laptop category.name: Electronics" and rows[0].chunk_index == 0
    stale = index(spark, tmp_path, catalog(spark, ("Speaker", "Renamed"))).search_with_scores("product", "a laptop", with_text=True).collect()
    assert stale[0].chunk_text is None
    gone = index(spark, tmp_path, catalog(spark, ("Speaker",))).search("product", "a laptop", limit=1)
    assert gone.count() == 0  # dropped after the limit
    for bad in (dict(limit=0), dict(limit=-1), dict(min_similarity=-0.01), dict(min_similarity=1.01)):
        with pytest.raises(ValueError):
            ix.search("product", "x", **bad)
    assert searches.validated_limit(5000, None, 1000) == 1000


@pytest.mark.parametrize("mode", ["exact", "vectorised"])
def test_rank_geometry(spark, mode):
    q = [1.0] + [0.0] * 7
    other = [0.0, 1.0] + [0.0] * 6
    rows = [("A", i, q) for i in range(8)] + [("B", 0, other), ("C", 0, [-1.0] + [0.0] * 7), ("Z", 0, [0.0] * 8), ("W", 0, [1.0]), ("N", 0, None), ("D", 100, other), ("D", 101, q)]
    df = spark.createDataFrame([(e, i, "h", v) for e, i, v in rows], "entity_id string, chunk_index int, content_hash string, embedding array<float>")
    got = [(r.entity_id, round(r.distance, 6), r.chunk_index) for r in searches.rank(df, q, mode=mode).collect()]
    assert got == [("A", 0, 0), ("D", 0, 101), ("B", 1, 0), ("C", 2, 0)]
    assert [r.entity_id for r in searches.rank(df, q, min_similarity=0.0, mode=mode).collect()] == ["A", "D", "B"]  # inclusive
    assert searches.rank(df, [0.0] * 8, mode=mode).count() == 0
    assert searches.rank(df.limit(0), q, mode=mode).count() == 0
    with pytest.raises(ValueError):
        searches.rank(df, q, scope=lambda x: x.select("entity_id"))


@pytest.mark.parametrize("mode", ["exact", "vectorised"])
def test_unusable_vectors_are_passed_over(spark, mode):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, "h", [1.0, 1.0]), (2, 0, "h", [nan, 1.0]), (3, 0, "h", [inf, 1.0]), (4, 0, "h", [None, 1.0])]
    df = spark.createDataFrame(rows, "entity_id bigint, chunk_index int, content_hash string, embedding array<float>")
    assert [(r.entity_id, round(r.distance, 6)) for r in searches.rank(df, [1.0, 1.0], mode=mode).collect()] == [(1, 0.0)]
    assert searches.rank(df, [nan, 1.0], mode=mode).count() == 0


def test_a_scope_may_only_filter(spark):
    df = spark.createDataFrame([(1, 0, "h", [1.0]), (2, 0, "h", [1.0])], "entity_id bigint, chunk_index int, content_hash string, embedding array<float>")
    few = lambda scope: [r.entity_id for r in searches.rank(df, [1.0], scope=scope).collect()]
    assert few(lambda c: c.where("entity_id > 1").where(F.col("chunk_index") == 0)) == [2] and few(lambda c: c) == [1, 2]
    for bad in (lambda c: c.limit(1), lambda c: c.union(c), lambda c: c.distinct(), lambda c: c.orderBy("entity_id"), lambda c: c.sample(0.5), lambda c: c.withColumn("chunk_index", F.lit(1)), lambda c: df.where("true")):
        with pytest.raises(ValueError):
            few(bad)


class Spread:
    """Vectors all over the place."""

    provider = "spread"

    def embed(self, texts, model, dimensions):
        return [np.random.default_rng(int(t.split()[1])).standard_normal(dimensions).tolist() for t in texts]


def numbered(spark, n, changed=()):
    c = EntityCatalog()
    c.register("item", spark.range(n).selectExpr("id", f"CAST(CASE WHEN id IN ({','.join(map(str, changed)) or '-1'}) THEN id + 100000 ELSE id END AS string) AS name"), spec=DocumentSpec(("name",)))
    return c


def test_vector_index(spark, tmp_path):
    ix = Index(spark, str(tmp_path), numbered(spark, 600), EngineConfig(dimensions=16, search_mode="ann", buckets=8), Spread())
    ix.sync("item", embed=True)
    with pytest.raises(UnsupportedBackend):
        ix.rank("item", [1.0] * 16)
    assert {c: level for c, level, _ in ix.doctor()}["vector index of item"] == "WARN"
    assert ix.build_vector_index("item") == 24 and ix.vector_index("item") == (24, 0, 8)
    assert {c: level for c, level, _ in ix.doctor()}["vector index of item"] == "OK"
    exact = Index(spark, str(tmp_path), numbered(spark, 600), EngineConfig(dimensions=16), Spread())
    hits = 0
    for i in range(0, 600, 100):
        q = np.random.default_rng(i + 7).standard_normal(16).tolist()
        hits += len({r.entity_id for r in ix.rank("item", q).collect()} & {r.entity_id for r in exact.rank("item", q).collect()})
        assert [tuple(r) for r in ix.rank("item", q, probes=24).collect()] == [tuple(r) for r in exact.rank("item", q).collect()]
    assert hits >= 0.8 * 60
    changed = Index(spark, str(tmp_path), numbered(spark, 601, [5]), EngineConfig(dimensions=16, search_mode="ann"), Spread())
    changed.sync("item", [5, 600], embed=True)
    assert 1 <= changed.vector_index("item")[1] <= 2
    for n in (100_005, 600):  # what changed and what came is found, without a rebuild
        assert changed.rank("item", np.random.default_rng(n).standard_normal(16).tolist(), 1, probes=1).first().entity_id == n % 100_000
    old = changed.rank("item", np.random.default_rng(5).standard_normal(16).tolist(), 1, probes=24).first()
    assert old.entity_id != 5 or old.distance > 0.01  # what was there before is not
    changed.forget("item", [600])
    assert changed.rank("item", np.random.default_rng(600).standard_normal(16).tolist(), 5, probes=24).where("entity_id = 600").count() == 0
    assert Index(spark, str(tmp_path / "no"), numbered(spark, 3), EngineConfig(dimensions=16)).build_vector_index("item") == 0


def failing(spark, bad=(1,), names=("Speaker", "Laptop")):
    c = catalog(spark, names)
    rows = c["product"].rows.withColumn("name", F.when(F.col("id").isin(list(bad)), F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("name")))
    c.register("product", rows, relations=c["product"].relations, spec=c["product"].spec)
    return c


def test_failures_stay_with_their_documents(spark, tmp_path):
    ix = index(spark, tmp_path)
    ix.sync("product")
    broken = index(spark, tmp_path, failing(spark, names=("Speaker", "Tablet")))
    events = []
    broken.listeners.append(lambda e: events.append(e.kind))
    assert broken.sync("product", [1, 2, 99])["product"] == {"synced": 1, "skipped": 0, "failed": 1}
    now = statuses(broken)
    assert now[1][0] == "failed" and "broken row" in now[1][2] and now[2] == ("pending", 1, None) and set(events) == {"synced", "sync_failed"}
    both = index(spark, tmp_path, failing(spark, (1, 2)))
    assert both.sync("product")["product"] == {"synced": 0, "skipped": 0, "failed": 2} and {s for s, _, _ in statuses(both).values()} == {"failed"}
    fresh = index(spark, tmp_path / "fresh", failing(spark))
    assert fresh.sync("product")["product"]["failed"] == 1 and set(statuses(fresh)) == {2}  # no document to hold the message


def test_a_pass_is_tried_again(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    real, left = Index._sync, [2]

    def flaky(self, *args):
        if left[0]:
            left[0] -= 1
            raise PySparkException("the store is away")
        return real(self, *args)

    monkeypatch.setattr(Index, "_sync", flaky)
    assert index(spark, tmp_path, pauses=(0, 0)).sync("product")["product"] == {"synced": 2, "skipped": 0, "failed": 0}
    left[0] = 99

    def away(*_):
        raise PySparkException("the folder is away")

    monkeypatch.setattr("marginalia.index.cut_lineage", away)
    with pytest.raises(PySparkException, match="folder"):  # not the documents' fault: none is marked
        index(spark, tmp_path, pauses=(0,)).sync("product")
    assert {s for s, _, _ in statuses(index(spark, tmp_path)).values()} == {"pending"}


class Picky:
    def encode(self, text):
        if "Speaker" in text:
            raise RuntimeError("can't cut this")
        return text.split()

    def decode(self, tokens):
        return " ".join(tokens)

    def identifier(self):
        return "picky"


def test_a_tokenizer_fails_for_its_text_only(spark, tmp_path, monkeypatch):
    from marginalia.functions import chunking

    ix = index(spark, tmp_path)
    ix.sync("product")
    monkeypatch.setattr(chunking, "make_tokenizer", lambda *_: Picky())
    monkeypatch.setattr("marginalia.functions.tokens.make_tokenizer", lambda *_: Picky())
    other = index(spark, tmp_path, tokenizer="x.Picky")
    assert other.sync("product")["product"] == {"synced": 1, "skipped": 0, "failed": 1}
    assert statuses(other)[1][0] == "failed" and "can't cut this" in statuses(other)[1][2] and statuses(other)[2][0] == "pending"


class Counted(Keywords):
    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts, model, dimensions):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(texts)))
        return super().embed(texts, model, dimensions)


def test_only_rewritten_documents_are_embedded(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ix = index(spark, tmp_path / "ix", catalog(spark, ("a", "b", "c", "d")), Counted(str(calls)), auto_embed=True, auto_batch_size=2)
    ix.sync("product", [1], embed=False)
    ix.sync("product", [2, 3, 4])
    sizes = [int(f.read_text()) for f in calls.iterdir()]
    assert sum(sizes) == 3 and max(sizes) <= 2
    assert {i: s for i, (s, _, _) in statuses(ix).items()} == {1: "pending", 2: "synced", 3: "synced", 4: "synced"}
    ix.sync("product", [2, 3, 4])
    assert len(list(calls.iterdir())) == len(sizes)  # nothing rewritten, nothing asked


def test_one_document_costs_one_bucket(spark, tmp_path):
    ix = Index(spark, str(tmp_path), numbered(spark, 200), EngineConfig(buckets=16))
    ix.sync("item")
    before = dict(ix.store.manifest())
    changed = Index(spark, str(tmp_path), numbered(spark, 200, [7]), EngineConfig(buckets=3))  # the index keeps its own number of buckets
    assert changed.sync("item", [7])["item"] == {"synced": 1, "skipped": 0, "failed": 0}
    after = changed.store.manifest()
    assert sorted(k.split("@")[0] for k in after if after[k] != before.get(k)) == ["chunks", "documents"]  # without relations no dependencies
    assert changed.table("documents").count() == 200 and changed.document("item", 7).count() == 1
    assert changed.forget("item", [7, 7, 999]) == 1 and changed.table("documents").count() == 199
    changed.store.vacuum(keep=1)
    assert changed.table("chunks").count() == 199


def test_lost_races_begin_anew(spark, tmp_path, monkeypatch):
    ix, rival = index(spark, tmp_path), index(spark, tmp_path)
    ix.sync("product", [1])
    real, races = SnapshotStore.commit, []

    def commit(self, *args, **kwargs):
        if self is ix.store and len(races) < 2:
            races.append(1)
            rival.sync("product", force=True)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(SnapshotStore, "commit", commit)
    assert ix.forget("product", [1]) == 1 and len(races) == 2
    assert set(statuses(ix)) == {2}
    assert not [s for s, _, _ in statuses(ix).values() if s == "failed"]


def test_text_ids(spark, tmp_path):
    c = EntityCatalog()
    c.register("tag", spark.createDataFrame([("t1", "Red")], "id string, name string"))
    c.register("page", spark.createDataFrame([("a-1", "Speaker", "t1"), ("b", "Laptop", None)], "id string, name string, tag string"), relations={"tag": Relation("one", "tag", local="tag")}, spec=DocumentSpec(("name",), ("tag.name",)))
    ix = index(spark, tmp_path, c, id_type="string")
    assert ix.sync("page", ["a-1", "b", "zz"], embed=True)["page"]["synced"] == 2
    assert [r.entity_id for r in ix.search("page", "a laptop").collect()] == ["b", "a-1"]
    assert {tuple(r) for r in ix.affected("tag", "t1").collect()} == {("page", "a-1")}
    assert ix.verify("page")["ok"] and ix.forget("page", ["b"]) == 1
    numbers = index(spark, tmp_path / "n")
    numbers.sync("product", ["1"])
    assert numbers.key("1") == 1 and ix.key(1) == "1" and numbers.document("product", "1").count() == 1


def made_for_commands(spark):
    return catalog(spark), EngineConfig(dimensions=3), Keywords()


def test_commands(spark, tmp_path):
    told = []

    def command(*words):
        told.clear()
        return commands.main(["--root", str(tmp_path), "--catalog", f"{__name__}:made_for_commands", *words], spark, told.append)

    assert command("sync") == 0 and told == ["nothing to do"]
    assert command("sync", "product") == 0 and told == ["product: synced 2, skipped 0, failed 0", "product: embedded 2, failed 0"]
    assert command("status") == 0 and "documents: 2" in told
    assert command("sync", "product", "--id", "1") == 0 and "product: synced 0, skipped 1, failed 0" in told
    assert command("sync", "--dependency", "category:1") == 0 and "product: synced 0, skipped 2, failed 0" in told
    assert command("rebuild") == 0 and "product: synced 2, skipped 0, failed 0" in told
    assert command("dependencies", "product", "1") == 0 and told == ["category 1"]
    assert command("dependencies", "product", "9") == 1 and command("forget", "product", "9") == 1
    assert command("index", "product") == 0 and told == ["product: 1 cells"]
    assert command("doctor") == 0 and command("verify", "product") == 0 and told[-1] == "checked 2, drifted 0, fixed 0, orphaned 0"
    assert command("forget", "product", "2") == 0 and command("verify", "product") == 1 and told[0] == "product 2: missing"
    assert command("verify", "product", "--fix") == 0 and command("prune") == 0 and told == ["product: 0 pruned"]
    for bad in (("sync", "--id", "1"), ("sync", "product", "--dependency", "category:1"), ("sync", "--dependency", "category:")):
        with pytest.raises(ValueError):
            command(*bad)


class Broken(Keywords):
    def __init__(self, how):
        self.how = how

    def embed(self, texts, model, dimensions):
        if self.how == "raise":
            raise RuntimeError("down")
        return [[0.0] * 3] * (len(texts) + 1) if self.how == "count" else [[0.0] * 2 for _ in texts]


@pytest.mark.parametrize(("how", "word"), [("count", "vectors were asked for"), ("width", "instead of 3"), ("raise", "down")])
def test_embedder_failures_write_nothing(spark, tmp_path, how, word):
    ix = index(spark, tmp_path, embedder=Broken(how))
    ix.sync("product")
    assert ix.embed("product")["failed"] == 2
    assert set(statuses(ix).values()) == {("pending", 1, None)}
    ix.embed("product", record=True)
    assert all(s == "failed" and word in e for s, _, e in statuses(ix).values())
    assert ix.sync("product")["product"]["skipped"] == 2 and statuses(ix)[1][0] == "failed"  # stays so until embedded
    healthy = index(spark, tmp_path)
    healthy.embed("product")
    assert statuses(healthy)[1][0] == "synced"


def test_stale_vectors_are_dropped(spark):
    chunks = spark.createDataFrame([(1, 0, "new", None), (1, 1, "same", None)], f"entity_id bigint, chunk_index int, content_hash string, embedding array<float>").selectExpr(
        "*", "CAST(NULL AS string) AS embedding_provider", "CAST(NULL AS string) AS embedding_model", "CAST(NULL AS int) AS embedding_dimensions", "CAST(NULL AS string) AS embedding_hash", "CAST(NULL AS timestamp) AS updated_at"
    )
    vectors = spark.createDataFrame([(1, 0, "old", [1.0]), (1, 1, "same", [2.0])], "entity_id bigint, chunk_index int, content_hash string, embedding array<float>")
    got = {r.chunk_index: r.embedding for r in embeds.with_vectors(chunks, vectors, Keywords(), EngineConfig(dimensions=1)).collect()}
    assert got == {0: None, 1: [2.0]}


def test_drift_and_repair(spark, tmp_path):
    ix = index(spark, tmp_path)
    assert ix.sync() == {}
    ix.sync("product", embed=True)
    assert ix.verify("product")["ok"] and ix.drift("product").count() == 0
    renamed = index(spark, tmp_path, catalog(spark, ("Speaker", "Laptop", "New"), category="Gadgets"))
    assert {r.entity_id: r.drift for r in renamed.drift("product").collect()} == {1: ["content"], 2: ["content"], 3: ["missing"]}
    assert renamed.verify()["drifted"] == 2  # missing ones count with an explicit type only
    assert renamed.verify("product", sample=1)["checked"] == 1
    done = renamed.verify("product", fix=True)
    assert done["ok"] and done["fixed"] == 3 and renamed.drift("product").count() == 0
    other = index(spark, tmp_path, catalog(spark, ("Speaker", "Laptop", "New"), category="Gadgets"), max_tokens=123)
    assert {tuple(r.drift) for r in other.drift("product").collect()} == {("configuration",)}
    shrunk = index(spark, tmp_path, catalog(spark, ("Speaker",), category="Gadgets"))
    assert shrunk.verify("product")["orphaned"] == 2 and shrunk.verify("product")["ok"]
    assert shrunk.prune() == {"product": 2} and set(statuses(shrunk)) == {1}
    with pytest.raises(ValueError):
        ix.verify("product", sample=0)


def test_invalidate_and_operations(spark, tmp_path):
    ix = index(spark, tmp_path)
    ix.sync("product", embed=True)
    assert {(r.entity_type, r.entity_id, r.batch_no) for r in ix.invalidate("category", 1).collect()} == {("product", 1, 0), ("product", 2, 0)}
    assert ix.invalidate("category", [7]).count() == 0 and ix.invalidate("category", []).count() == 0
    renamed = index(spark, tmp_path, catalog(spark, category="Gadgets"))
    assert renamed.sync_affected("category:1") == {"product": {"synced": 2, "skipped": 0, "failed": 0}}
    status = renamed.status()
    assert (status["documents"], status["chunks"], status["dependencies"], status["by_status"], status["by_type"]) == (2, 2, 2, {"pending": 2}, {"product": 2})
    assert [tuple(r)[:2] for r in renamed.dependencies_of("product", 1).collect()] == [("category", 1)]
    with pytest.raises(KeyError):
        renamed.dependencies_of("product", 99)
    levels = {check: level for check, level, _ in renamed.doctor()}
    assert levels["dimensions"] == "OK" and levels["pending documents"] == "WARN" and levels["failed documents"] == "OK"
    assert levels["capabilities"] == "OK" and levels["vector index of product"] == "WARN"
    wrong = {check: level for check, level, _ in index(spark, tmp_path, dimensions=4).doctor()}
    assert wrong["dimensions"] == "FAIL"  # the width declared when the index began
    assert renamed.forget("product", [1, 99]) == 1 and renamed.forget("product", [1]) == 0
    assert renamed.table("chunks").select("entity_id").distinct().count() == 1
    empty = index(spark, tmp_path / "empty")
    assert empty.status() == {"documents": 0, "chunks": 0, "dependencies": 0}


def test_invalid_spec_fails_its_type_only(spark, tmp_path):
    ix = index(spark, tmp_path)
    ix.sync("product")
    c = catalog(spark)
    c.register("product", c["product"].rows, relations=c["product"].relations, spec=DocumentSpec(("name",), ("categroy.name",)))
    tally = index(spark, tmp_path, c).sync("product")
    assert tally["product"]["failed"] == 2 and all(s == "failed" and "categroy" in e for s, _, e in statuses(ix).values())


def test_repeated_keys_and_shrinking_chunks(spark):
    desired = spark.createDataFrame([(1, "a", "g"), (1, "a", "g")], "entity_id bigint, content_hash string, configuration_hash string")
    stored = spark.createDataFrame([], reconcile.DOCUMENTS.format(id="bigint"))
    assert reconcile.actions(desired, stored).count() == 1 and reconcile.new_documents(desired, stored).count() == 1
    assert reconcile.new_documents(desired.limit(0), stored).count() == 0
    chunks = spark.createDataFrame([(1, i, f"h{i}") for i in range(3)] + [(2, 0, "x")], "entity_id bigint, chunk_index int, content_hash string")
    old = chunks.selectExpr("*", "array(CAST(1 AS float)) AS embedding", "'p' AS embedding_provider", "'m' AS embedding_model", "1 AS embedding_dimensions", "'e' AS embedding_hash", "CAST(NULL AS string) AS metadata", "CAST(NULL AS timestamp) AS created_at", "CAST(NULL AS timestamp) AS updated_at")
    touched = spark.createDataFrame([(1, True, False)], "entity_id bigint, is_changed boolean, configuration_changed boolean")
    new = reconcile.new_chunks(chunks.where("entity_id = 1 AND chunk_index < 1"), old, touched)
    assert {(r.entity_id, r.chunk_index) for r in new.collect()} == {(1, 0), (2, 0)}
    vacuous = reconcile.flipped(reconcile.new_documents(desired, stored), old.limit(0), desired)
    assert vacuous.first().status == "synced"  # no chunk is no chunk without a vector


def test_bridges(spark, tmp_path):
    c = catalog(spark)
    c.register("feature", spark.createDataFrame([(1, "Waterproof"), (2, "Bluetooth"), (3, "Light")], "id bigint, name string"))
    bridge = spark.createDataFrame([(1, 1, "x")], "product_id bigint, feature_id bigint, note string")
    c["product"].relations["features"] = Relation("bridge", "feature", local="product_id", foreign="feature_id", bridge=bridge)
    c["product"].spec = c["product"].spec.relation("features.name")
    ix = index(spark, tmp_path, c)
    ix.sync("product")
    ix.attach("product", "features", 1, [2, 2, 1])
    own = lambda: {r.dependency_id for r in ix.dependencies_of("product", 1).where("dependency_type = 'feature'").collect()}
    assert own() == {1, 2} and ix.drift("product").count() == 0
    assert ix.sync_relation("product", "features", 1, [2, 3]) == {"attached": [3], "detached": [1]} and own() == {2, 3}
    assert ix.detach("product", "features", 1) == 2 and own() == set() and ix.drift("product").count() == 0
    with pytest.raises(InvalidRelationPath):
        ix.attach("product", "category", 1, [1])


class Flaky(Keywords):
    calls = 0

    def embed(self, texts, model, dimensions):
        Flaky.calls += 1
        if Flaky.calls < 3:
            raise RuntimeError("busy")
        return super().embed(texts, model, dimensions)


def test_retrying():
    assert embeds.Retrying(Flaky(), (0, 0)).embed(["speaker"], "m", 3) == [[1.0, 0.0, 0.1]] and Flaky.calls == 3
    with pytest.raises(embeds.InvalidEmbeddingResponse):
        embeds.Retrying(Broken("count"), (0,)).embed(["x"], "m", 3)


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    a = spark.range(3)
    assert store.version == 0 and not store.has("t")
    store.commit({"t": a, "u": a})
    base = store.version
    store.commit({"t": store.read(spark, "t").where("id > 0")}, append={"u": spark.range(3, 5)}, expected=base)
    assert store.read(spark, "t").count() == 2 and store.read(spark, "u").count() == 5 and store.read(spark, "t", 1).count() == 3
    with pytest.raises(CommitConflict):
        store.commit({"t": a}, expected=base)
    with pytest.raises(Exception):
        store.commit({"t": a.selectExpr("raise_error('no') AS id")})
    assert store.version == 2 and store.read(spark, "t").count() == 2
    store.commit({"t": a})
    assert store.vacuum(keep=1) >= 2 and store.read(spark, "t").count() == 3 and store.read(spark, "u").count() == 5


def test_recording_double(spark):
    fake = RecordingIndex(catalog(spark)).search_returns("product", lambda q, n: [q] * 5)
    fake.assert_nothing_synced()
    fake.assert_nothing_searched()
    fake.sync("product", [1, 1], force=True)
    fake.embed("product")
    fake.forget("product", [2])
    fake.invalidate("category", 1)
    assert fake.search("product", "x", limit=2) == ["x", "x"] and fake.search_with_scores("other", "y") == []
    fake.assert_synced("product", 1, lambda s: s[2])
    fake.assert_not_synced("product", 2)
    fake.assert_synced_times("product", 2)
    fake.assert_embedded("product")
    fake.assert_not_embedded("category")
    fake.assert_forgotten("product", 2)
    fake.assert_searched("product", lambda q, limit, least: q == "x" and limit == 2 and least is None)
    fake.assert_not_embedded("product", 5)
    fake.assert_invalidated("category", 1)
    assert fake.rendered_for("product", 1) == "name: Speaker\ncategory.name: Electronics" and fake.rendered_for("product", 2) is None
    fake.catalog = catalog(spark, ("Other",))
    assert fake.rendered_for("product", 1).startswith("name: Speaker") and fake.render("product", 1).startswith("name: Other") and fake.render("product", 5) is None
    with pytest.raises(AssertionError):
        fake.assert_synced("category")
    with pytest.raises(ValueError):
        fake.search("product", "x", limit=0)
