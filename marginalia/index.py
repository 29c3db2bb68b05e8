"""The index: one object that syncs, embeds, searches, invalidates, verifies and repairs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any, TypeVar
from urllib.parse import quote, unquote

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import EngineConfig, configuration_hash
from marginalia.functions.chunking import chunk_errors
from marginalia.functions.chunking import chunks as chunked
from marginalia.plans import ann, invalidate, reconcile
from marginalia.plans import drift as drifts
from marginalia.plans import embed as embeds
from marginalia.plans import search as searches
from marginalia.plans.render import Keys, only, render_hashed
from marginalia.plans.render import dependencies as desired_dependencies
from marginalia.runtime import cut_lineage
from marginalia.sources.store import CommitConflict, SnapshotStore
from marginalia.spec import EntityCatalog, InvalidRelationPath, Relation

_SCHEMAS = {"documents": reconcile.DOCUMENTS, "chunks": reconcile.CHUNKS, "dependencies": reconcile.DEPENDENCIES}
#: Rows a report shows at most, and examples a check names.
REPORT_ROWS, EXAMPLES = 20, 3
#: The oldest Spark whose functions suffice (try_cast as a method, is_valid_utf8).
LEAST_SPARK = (4, 0)
#: Ids in a list that become a filter of the scan; longer lists are joined. Characters of an error that are kept.
LISTED_IDS, MESSAGE = 1_000, 1_000

T = TypeVar("T")


class UnsupportedBackend(RuntimeError):
    """Stored vectors and settings don't fit."""


@dataclass(frozen=True)
class Event:
    """What happened: synced, embedded, sync_failed or embedding_failed, with the keys concerned."""

    kind: str
    entity_type: str
    keys: DataFrame | None
    detail: dict[str, Any]


@dataclass(frozen=True)
class _View:
    """One version of the store."""

    version: int
    manifest: dict[str, list[str]]


def _message(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}"[:MESSAGE]


class Index:
    """Documents, chunks and dependencies of the catalogue's entities in a snapshot store.

    Each entity type has its own part of each table, and each part is divided into buckets by the hash of the entity's id. A
    pass reads and writes only the buckets of the documents it changes, so one changed row costs one bucket however large the
    index is. It publishes all three tables by one commit against the version it read; if somebody else committed
    meanwhile it begins anew. Work and events are given out only after the commit.
    """

    def __init__(self, spark: SparkSession, root: str, catalog: EntityCatalog, config: EngineConfig | None = None, embedder: embeds.Embedder | None = None) -> None:
        self.spark, self.catalog, self.config, self.embedder = spark, catalog, config or EngineConfig(), embedder
        self.store = SnapshotStore(spark, root)
        self.listeners: list[Callable[[Event], None]] = []

    # -- tables ------------------------------------------------------------
    def _view(self) -> _View:
        return _View(*self.store._newest())

    def _retried(self, attempt: Callable[[], T], patient: bool = True) -> T:
        """The result of an attempt that may lose a race with another writer, or fail for a while; the last error is raised."""
        lost, pauses = 0, list(self.config.pauses) if patient else []
        while True:
            try:
                return attempt()
            except CommitConflict:
                lost += 1
                if lost >= self.config.attempts:
                    raise
            except PySparkException:
                if not pauses:
                    raise
                time.sleep(pauses.pop(0))

    @staticmethod
    def _name(table: str, entity_type: str) -> str:
        return f"{table}@{quote(entity_type, safe='')}"

    def _schema(self, table: str) -> str:
        return _SCHEMAS[table].format(id=self.config.id_type)

    def _folders(self, table: str, entity_type: str, view: _View) -> dict[int, str]:
        """Bucket -> folder of a part."""
        prefix = f"{self._name(table, entity_type)}@"
        return {int(n[len(prefix) :]): f[0] for n, f in view.manifest.items() if n.startswith(prefix)}

    def _read(self, folders: Sequence[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _part(self, table: str, entity_type: str, buckets: Sequence[int] | None = None, view: _View | None = None) -> DataFrame:
        """A type's part of a table, or some of its buckets."""
        folders = self._folders(table, entity_type, view or self._view())
        return self._read([f for b, f in sorted(folders.items()) if buckets is None or b in buckets], self._schema(table))

    def _bucket(self) -> Column:
        """The bucket of entity_id. Their number is that of the index, whatever the settings say now."""
        return F.pmod(F.xxhash64("entity_id"), F.lit(int((self.store.note("buckets") or [str(self.config.buckets)])[0]))).cast("int")

    def _buckets_of(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # as many as there are buckets at most

    def _bucketed(self, tables: dict[str, DataFrame], entity_type: str, buckets: list[int]) -> dict[str, tuple[DataFrame, list[int]]]:
        return {self._name(t, entity_type): (df.withColumn("__bucket", self._bucket()), buckets) for t, df in tables.items()}

    def _notes(self, view: _View) -> dict[str, list[str]]:
        """What the index says of itself, from its first commit on: number of buckets and width of vectors."""
        return {} if "#buckets" in view.manifest else {"buckets": [str(self.config.buckets)], "dimensions": [str(self.config.dimensions)]}

    def table(self, table: str) -> DataFrame:
        """A whole index table, with entity_type."""
        view = self._view()
        parts = [self._part(table, t, view=view).withColumn("entity_type", F.lit(t)) for t in self.entity_types(view)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{self._schema(table)}, entity_type string")

    def entity_types(self, view: _View | None = None) -> list[str]:
        """Types that have a document in the index."""
        return sorted({unquote(n.split("@")[1]) for n in (view or self._view()).manifest if n.startswith("documents@")})

    def key(self, entity_id: int | str) -> int | str:
        """An id as the index has it: a number for a text of digits, or a text for a number, as its ids are."""
        return str(entity_id) if self.config.id_type == "string" else int(entity_id)

    def _keys(self, ids: Sequence[int | str] | DataFrame | None) -> Keys:
        if ids is None or isinstance(ids, DataFrame):
            return ids if ids is None else ids.select(F.col("entity_id").cast(self.config.id_type).alias("entity_id"))
        listed = sorted({self.key(i) for i in ids})
        return listed if len(listed) <= LISTED_IDS else self.spark.createDataFrame([(i,) for i in listed], f"entity_id {self.config.id_type}")

    def _listed(self, keys: DataFrame) -> Keys:
        """Few keys as a list, which becomes a filter of the scans; many stay a table."""
        few = keys.limit(LISTED_IDS + 1).collect()
        return [r[0] for r in few] if len(few) <= LISTED_IDS else keys

    def document(self, entity_type: str, entity_id: int | str) -> DataFrame:
        """The document of an entity; only its bucket is read."""
        row = self.spark.createDataFrame([(self.key(entity_id),)], f"entity_id {self.config.id_type}")
        return self._part("documents", entity_type, self._buckets_of(row)).where(F.col("entity_id") == self.key(entity_id))

    def _tell(self, kind: str, entity_type: str, keys: DataFrame | None, **detail: Any) -> None:
        for listener in self.listeners:
            listener(Event(kind, entity_type, keys, detail))

    def _hash(self, entity_type: str) -> str:
        return configuration_hash(self.catalog[entity_type].spec, self.config)

    def desired(self, entity_type: str, keys: Keys = None) -> DataFrame:
        """(entity_id, text, content_hash, configuration_hash) as the entities are now."""
        rows = render_hashed(self.catalog, entity_type, self._hash(entity_type), keys=keys)
        return rows.withColumn("entity_id", F.col("entity_id").cast(self.config.id_type))

    def _dependencies(self, entity_type: str, keys: Keys = None) -> DataFrame:
        return desired_dependencies(self.catalog, entity_type, keys=keys, id_type=self.config.id_type).withColumn("entity_id", F.col("entity_id").cast(self.config.id_type))

    def fresh_chunks(self, entity_type: str, keys: Keys = None) -> DataFrame:
        return chunked(self.desired(entity_type, keys), ["entity_id"], "text", self.config)

    # -- sync --------------------------------------------------------------
    def sync(self, entity_type: str | None = None, ids: Sequence[int | str] | DataFrame | None = None, force: bool = False, embed: bool | None = None) -> dict[str, dict[str, int]]:
        """Reconcile one type, some of its ids, or every type already indexed; tallies by type.

        Ids without an entity are skipped. An entity that can't be rendered or cut fails alone: its document, if there is one, gets
        the message, the others go on. A type whose spec is invalid fails as a whole, other types go on. With nothing
        indexed and no type given: no tally. Afterwards missing vectors are filled: of the whole type if embed is given, of the
        documents just rewritten if an embedder is there and the settings say auto.
        """
        if ids is not None and entity_type is None:
            raise ValueError("ids need an entity type")
        tallies = {}
        for t in [entity_type] if entity_type else self.entity_types():
            keys = self._keys(ids)
            try:
                self.catalog.validate_spec(t, self.catalog[t].spec)
            except InvalidRelationPath as e:
                concerned = cut_lineage(only(self._part("documents", t).select("entity_id"), "entity_id", keys))
                self.record_failure(t, concerned.withColumn("message", F.lit(_message(e))))
                tallies[t] = {"synced": 0, "skipped": 0, "failed": concerned.count()}
                continue
            tallies[t], rewritten = self._isolated(t, keys, force)
            if embed:
                self.embed(t)
            elif embed is None and self.config.auto_embed and self.embedder and rewritten is not None:
                self.embed(t, rewritten)
        return tallies

    def _isolated(self, t: str, keys: Keys, force: bool, depth: int = 0) -> tuple[dict[str, int], DataFrame | None]:
        """(tally, rewritten keys) of a pass; one that an entity's rows break is halved by the hash of the ids until those alone are left."""
        try:
            return self._retried(lambda: self._sync(t, keys, force), patient=not depth)
        except PySparkException as e:
            if not depth:
                cut_lineage(self._part("documents", t).limit(1))  # if the store or the shared folder is away, that is no row's fault
            key = self.catalog[t].key
            rows = only(self.catalog[t].rows.where(F.col(key).isNotNull()).select(key), key, keys)
            ids = cut_lineage(rows.select(F.col(key).cast(self.config.id_type).alias("entity_id")).distinct())
            n = ids.count()
            if n <= 1 or depth >= 63:
                self.record_failure(t, ids.withColumn("message", F.lit(_message(e))))
                return {"synced": 0, "skipped": 0, "failed": n}, None
            bit = F.shiftright(F.xxhash64("entity_id"), depth).bitwiseAND(1)
            parts = [self._isolated(t, ids.where(bit == side), force, depth + 1) for side in (0, 1)]
            done = [r for _, r in parts if r is not None]
            return {k: sum(tally[k] for tally, _ in parts) for k in parts[0][0]}, reduce(DataFrame.unionByName, done) if done else None

    def _sync(self, t: str, keys: Keys, force: bool) -> tuple[dict[str, int], DataFrame | None]:
        view = self._view()
        desired = self.desired(t, keys)
        if self._folders("documents", t, view):
            # Most documents are as they should be: hashes alone are kept of all, texts only of those to be rewritten.
            hashes = cut_lineage(desired.select("entity_id", "content_hash", "configuration_hash"))
            stored = self._part("documents", t, None if keys is None else self._buckets_of(hashes), view)
            touched = cut_lineage(reconcile.actions(hashes, stored, force))
            desired = cut_lineage(self.desired(t, self._listed(touched.where("is_changed").select("entity_id"))))
        else:
            desired = cut_lineage(desired)
            touched = cut_lineage(reconcile.actions(desired, self._part("documents", t, [], view), force))
        work = touched.where("is_changed").select("entity_id")
        errors = None
        if self.config.tokenizer != "whitespace":
            errors = cut_lineage(chunk_errors(desired.join(work, "entity_id", "left_semi"), ["entity_id"], "text", self.config))
            touched = touched.join(errors.select("entity_id"), "entity_id", "left_anti")
            work = touched.where("is_changed").select("entity_id")
        failed = 0 if errors is None else errors.count()
        tally = touched.agg(F.count_if("is_changed").alias("s"), F.count_if(~F.col("is_changed")).alias("k")).first()
        rewritten = None
        if tally.s:
            rewritten = work = cut_lineage(work)
            buckets = self._buckets_of(work)
            documents, chunks, dependencies = (self._part(name, t, buckets, view) for name in _SCHEMAS)
            now = F.lit(self.spark.sql("SELECT current_timestamp()").first()[0])
            changed = desired.join(work, "entity_id", "left_semi")
            fresh = chunked(changed, ["entity_id"], "text", self.config)
            tables = {
                "documents": reconcile.new_documents(changed, documents, force, now),
                "chunks": reconcile.new_chunks(fresh, chunks, touched, now),
                "dependencies": reconcile.new_dependencies(self._dependencies(t, self._listed(work)), dependencies, touched, now),
            }
            self.store.commit({}, bucketed=self._bucketed(tables, t, buckets), notes=self._notes(view), expected=view.version)
            self._tell("synced", t, work, forced=force, count=tally.s)
        if failed:
            self.record_failure(t, errors)
        return {"synced": tally.s, "skipped": tally.k, "failed": failed}, rewritten

    def rebuild(self, entity_type: str | None = None) -> dict[str, dict[str, int]]:
        """sync with force: versions rise, unchanged chunks keep their vectors."""
        return self.sync(entity_type, force=True)

    def record_failure(self, entity_type: str, errors: DataFrame) -> None:
        """Documents of errors (entity_id, message) set to failed; keys without a document are left alone."""
        errors = cut_lineage(errors.groupBy("entity_id").agg(F.min("message").alias("message")))

        def attempt() -> None:
            view = self._view()
            buckets = [b for b in self._buckets_of(errors) if b in self._folders("documents", entity_type, view)]
            if buckets:
                failed = reconcile.with_failures(self._part("documents", entity_type, buckets, view), errors)
                self.store.commit({}, bucketed=self._bucketed({"documents": failed}, entity_type, buckets), expected=view.version)

        self._retried(attempt)
        self._tell("sync_failed", entity_type, errors)

    # -- bridges -----------------------------------------------------------
    def _bridge(self, entity_type: str, relation: str) -> Relation:
        edge = self.catalog[entity_type].relations.get(relation)
        if edge is None or edge.kind != "bridge":
            raise InvalidRelationPath(f"{entity_type} has no bridge {relation!r}")
        return edge

    def _rebridge(self, entity_type: str, relation: str, rows: DataFrame, owner: int | str, resync: bool) -> None:
        """The relation over other pairs, written so that later reads don't compute them again; the owner is synced."""
        entity = self.catalog[entity_type]
        entity.relations = {**entity.relations, relation: replace(entity.relations[relation], bridge=cut_lineage(rows))}
        if resync:
            self.sync(entity_type, [owner])

    def attach(self, entity_type: str, relation: str, owner: int | str, ids: Sequence[int | str], resync: bool = True) -> None:
        """Pair an owner with more rows; pairs that are there stay as they are."""
        edge = self._bridge(entity_type, relation)
        kinds = {f.name: f.dataType.simpleString() for f in edge.bridge.schema}
        new = self.spark.createDataFrame([(str(owner), str(i)) for i in ids], "a string, b string")
        new = new.select(F.col("a").cast(kinds[edge.local]).alias(edge.local), F.col("b").cast(kinds[edge.foreign]).alias(edge.foreign)).distinct()
        new = new.join(edge.bridge.select(edge.local, edge.foreign), [edge.local, edge.foreign], "left_anti")
        self._rebridge(entity_type, relation, edge.bridge.unionByName(new, allowMissingColumns=True), owner, resync)

    def detach(self, entity_type: str, relation: str, owner: int | str, ids: Sequence[int | str] | None = None, resync: bool = True) -> int:
        """Take an owner's pairs apart, all if no ids are given; how many there were."""
        edge = self._bridge(entity_type, relation)
        own = F.col(edge.local) == owner
        gone = own if ids is None else own & F.col(edge.foreign).isin(list(ids))
        gone = F.coalesce(gone, F.lit(False))
        n = edge.bridge.where(gone).count()
        self._rebridge(entity_type, relation, edge.bridge.where(~gone), owner, resync)
        return n

    def sync_relation(self, entity_type: str, relation: str, owner: int | str, ids: Sequence[int | str], detaching: bool = True, resync: bool = True) -> dict[str, list]:
        """Make the ids an owner's pairs; which were attached and, if detaching, detached.

        Only the pairs that change come to the driver: of the owner's others none does.
        """
        edge = self._bridge(entity_type, relation)
        own = edge.bridge.where(F.col(edge.local) == owner).where(F.col(edge.foreign).isNotNull()).select(F.col(edge.foreign).alias("i"))
        there = {r[0] for r in own.where(F.col("i").isin(list(ids))).distinct().collect()} if ids else set()
        attached = sorted(set(ids) - there)
        detached = sorted(r[0] for r in (own.where(~F.col("i").isin(list(ids))) if ids else own).distinct().collect()) if detaching else []
        if detached:
            self.detach(entity_type, relation, owner, detached, resync=False)
        if attached:
            self.attach(entity_type, relation, owner, attached, resync=False)
        if resync:
            self.sync(entity_type, [owner])
        return {"attached": attached, "detached": detached}

    # -- embed -------------------------------------------------------------
    def embed(self, entity_type: str, keys: DataFrame | Sequence[int | str] | None = None, record: bool = False) -> dict[str, int]:
        """Fill missing vectors and set documents without any to synced; counts of vectors and failed chunks.

        keys: only these documents. Only documents that aren't synced are rendered and only their buckets are read and written.
        The embedder gets at most auto_batch_size texts a call, and its answers are written once before they are used, so nothing
        is asked for twice, even if a commit loses a race. Writes are guarded by chunk hash, the status by the document's
        hashes. record: note failures on the documents.
        """
        if self.embedder is None:
            raise ValueError("the index has no embedder")
        view = self._view()
        waiting = only(self._part("documents", entity_type, view=view), "entity_id", self._keys(keys)).where(F.col("status") != reconcile.SYNCED)
        waiting = cut_lineage(waiting.select("entity_id", "content_hash", "configuration_hash"))
        buckets = self._buckets_of(waiting)
        if not buckets:
            return {"embedded": 0, "failed": 0}
        desired = cut_lineage(self.desired(entity_type, waiting.select("entity_id")))
        current = cut_lineage(waiting.join(desired, ["entity_id", "content_hash", "configuration_hash"], "left_semi"))
        fresh = chunked(desired.join(current.select("entity_id"), "entity_id", "left_semi"), ["entity_id"], "text", self.config)
        work = embeds.pending(self._part("chunks", entity_type, buckets, view), fresh)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        answers = cut_lineage(embeds.embedded(work.repartition(n), self.embedder, self.config, self.config.auto_batch_size))
        counts = answers.agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
        errors = answers.where(F.col("error").isNotNull()).select("entity_id", F.col("error").alias("message"))

        def attempt() -> None:
            now = self._view()
            chunks = embeds.with_vectors(self._part("chunks", entity_type, buckets, now), answers, self.embedder, self.config)
            documents = reconcile.flipped(self._part("documents", entity_type, buckets, now), chunks, current)
            if record and counts.failed:
                documents = reconcile.with_failures(documents, errors)
            self.store.commit({}, bucketed=self._bucketed({"chunks": chunks, "documents": documents}, entity_type, buckets), expected=now.version)

        self._retried(attempt)
        if counts.done:
            self._tell("embedded", entity_type, answers.where("error IS NULL").select("entity_id").distinct(), count=counts.done)
        if counts.failed:
            self._tell("embedding_failed", entity_type, errors, count=counts.failed)
        return {"embedded": counts.done, "failed": counts.failed}

    # -- vector index --------------------------------------------------------
    def build_vector_index(self, entity_type: str, cells: int | None = None) -> int:
        """Sort all stored vectors of a type into cells on disk for approximate searches; the number of cells."""

        def attempt() -> int:
            view = self._view()
            chunks = self._part("chunks", entity_type, view=view)
            centres = ann.fit_on(chunks, self.config.dimensions, cells)
            name, made = self._name("cells", entity_type), list(range(len(centres)))
            old = tuple(n for n in view.manifest if n.startswith(f"{name}@"))
            if not made:
                return 0
            table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>")
            indexed = sorted(self._folders("chunks", entity_type, view).values())
            self.store.commit(
                {self._name("centroids", entity_type): table}, bucketed={name: (ann.assigned(chunks, centres), made)}, notes={self._name("indexed", entity_type): indexed}, drop=old, expected=view.version
            )
            return len(made)

        return self._retried(attempt)

    def vector_index(self, entity_type: str) -> tuple[int, int, int]:
        """(cells, buckets that changed since, buckets) of a type's vector index; no cells if there is none."""
        view = self._view()
        folders, indexed = self._folders("chunks", entity_type, view), set(view.manifest.get(f"#{self._name('indexed', entity_type)}", []))
        cells = self.spark.read.parquet(f"{self.store.root}/{view.manifest[c][0]}").count() if (c := self._name("centroids", entity_type)) in view.manifest else 0
        return cells, sum(f not in indexed for f in folders.values()), len(folders)

    def _near(self, entity_type: str, query: Sequence[float], probes: int | None) -> DataFrame:
        """The chunks in the nearest cells, and all of the buckets that changed since the cells were made: nothing stale, nothing left out for being new."""
        view = self._view()
        name = self._name("centroids", entity_type)
        if name not in view.manifest:
            raise UnsupportedBackend(f"{entity_type} has no vector index; build_vector_index makes one")
        rows = self.spark.read.parquet(f"{self.store.root}/{view.manifest[name][0]}").orderBy("cell").collect()  # at most ann.MOST_CELLS
        picked = ann.probes(np.array([r.centre for r in rows], np.float32), query, probes)
        indexed, folders = set(view.manifest.get(f"#{self._name('indexed', entity_type)}", [])), self._folders("chunks", entity_type, view)
        fresh = [b for b, f in folders.items() if f in indexed]
        cells, columns = self._folders("cells", entity_type, view), ["entity_id", "chunk_index", "content_hash", "embedding"]
        schema = f"entity_id {self.config.id_type}, chunk_index int, content_hash string, embedding array<float>"
        near = self._read([cells[c] for c in picked if c in cells], schema).where(self._bucket().isin(fresh) if fresh else F.lit(False))
        return near.unionByName(self._part("chunks", entity_type, [b for b in folders if b not in fresh], view).select(*columns))

    # -- search ------------------------------------------------------------
    def rank(self, entity_type: str, query: Sequence[float], limit: int = 10, min_similarity: float | None = None, scope: searches.Scope = None, probes: int | None = None) -> DataFrame:
        """The closest entities to a vector, by the search mode of the settings; probes: cells an approximate search looks into."""
        approximate = self.config.search_mode == "ann"
        chunks = self._near(entity_type, query, probes) if approximate else self._part("chunks", entity_type)
        return searches.rank(chunks, query, limit, min_similarity, scope, self.config.max_limit, "exact" if approximate else self.config.search_mode)

    def _ranked(self, entity_type: str, text: str, limit: int, min_similarity: float | None, scope: searches.Scope) -> DataFrame:
        limit = searches.validated_limit(limit, min_similarity, self.config.max_limit)  # before any call that costs
        if self.embedder is None:
            raise UnsupportedBackend("search needs an embedder")
        query = embeds.checked(self.embedder.embed([text], self.config.model, self.config.dimensions), [text], self.config.dimensions)[0]
        return self.rank(entity_type, query, limit, min_similarity, scope)

    def search(self, entity_type: str, text: str, limit: int = 10, min_similarity: float | None = None, scope: searches.Scope = None) -> DataFrame:
        """The entities' rows in order of closeness, with place; those gone since are left out."""
        entity = self.catalog[entity_type]
        return searches.hydrated(self._ranked(entity_type, text, limit, min_similarity, scope).select("entity_id", "distance"), entity.rows, entity.key)

    def search_with_scores(self, entity_type: str, text: str, limit: int = 10, min_similarity: float | None = None, scope: searches.Scope = None, with_text: bool = False) -> DataFrame:
        """search with score, distance and the closest chunk; with_text adds the chunk's text as it is now."""
        ranked = self._ranked(entity_type, text, limit, min_similarity, scope)
        if with_text:
            ranked = cut_lineage(ranked)
            ranked = searches.with_text(ranked, self.fresh_chunks(entity_type, [r[0] for r in ranked.select("entity_id").collect()]))  # max_limit rows at most
        entity = self.catalog[entity_type]
        return searches.hydrated(ranked, entity.rows, entity.key)

    # -- invalidation ------------------------------------------------------
    def affected(self, dependency_type: str, ids: Sequence[int | str] | int | str) -> DataFrame:
        """(entity_type, entity_id) of documents that depend on any of the rows; no id: none."""
        listed = [ids] if isinstance(ids, (int, str)) else list(ids)
        changes = self.spark.createDataFrame([(dependency_type, self.key(i)) for i in listed], f"dependency_type string, dependency_id {self.config.id_type}")
        return invalidate.affected(changes, self.table("dependencies"))

    def invalidate(self, dependency_type: str, ids: Sequence[int | str] | int | str) -> DataFrame:
        """(entity_type, entity_id, batch_no): work to be synced, in batches."""
        return invalidate.batches(self.affected(dependency_type, ids), ["entity_type", "entity_id"], self.config.batch_size)

    def sync_pairs(self, pairs: DataFrame, force: bool = False) -> dict[str, dict[str, int]]:
        """Sync documents by (entity_type, entity_id); types the catalogue doesn't know are left alone."""
        pairs = cut_lineage(pairs.select("entity_type", "entity_id").distinct())
        out = {}
        for t in sorted(r.entity_type for r in pairs.select("entity_type").distinct().collect() if r.entity_type is not None):
            if t in self.catalog:
                out |= self.sync(t, pairs.where(F.col("entity_type") == t).select("entity_id"), force)
        return out

    def sync_affected(self, reference: str) -> dict[str, dict[str, int]]:
        """Sync what depends on Type:id."""
        kind, key = invalidate.parse_reference(reference)
        return self.sync_pairs(self.affected(kind, key))

    # -- operations --------------------------------------------------------
    def forget(self, entity_type: str, ids: Sequence[int | str] | DataFrame) -> int:
        """Delete documents with their chunks and dependencies; how many there were. Works when the entity is gone."""
        keys = self._keys(ids)
        keys = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(i,) for i in keys], f"entity_id {self.config.id_type}")
        keys = cut_lineage(keys.select("entity_id").where(F.col("entity_id").isNotNull()).distinct())
        buckets = self._buckets_of(keys)

        def attempt() -> int:
            view = self._view()
            gone = self._part("documents", entity_type, buckets, view).join(keys, "entity_id", "left_semi").count()
            if gone:
                tables = {t: self._part(t, entity_type, buckets, view).join(keys, "entity_id", "left_anti") for t in _SCHEMAS}
                self.store.commit({}, bucketed=self._bucketed(tables, entity_type, buckets), expected=view.version)
            return gone

        return self._retried(attempt) if buckets else 0

    def prune(self) -> dict[str, int]:
        """Forget documents whose entity is gone; types the catalogue doesn't know are left alone."""
        out = {}
        for t in self.entity_types():
            if t in self.catalog:
                entity = self.catalog[t]
                out[t] = self.forget(t, drifts.pruned_keys(self._part("documents", t), entity.rows, entity.key))
        return out

    def dependencies_of(self, entity_type: str, entity_id: int | str) -> DataFrame:
        """(dependency_type, dependency_id, created_at); an error if there is no such document."""
        if self.document(entity_type, entity_id).isEmpty():
            raise KeyError(f"{entity_type} {entity_id} has no document")
        row = self.spark.createDataFrame([(self.key(entity_id),)], f"entity_id {self.config.id_type}")
        own = self._part("dependencies", entity_type, self._buckets_of(row)).where(F.col("entity_id") == self.key(entity_id))
        return own.select("dependency_type", "dependency_id", "created_at").orderBy("dependency_type", "dependency_id")

    def breakdown(self, column: str) -> DataFrame:
        """(column, documents): documents by status or entity_type, most first."""
        return self.table("documents").groupBy(column).agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), column)

    def status(self) -> dict[str, Any]:
        """Row counts, and breakdowns by status and type if there are documents."""
        out: dict[str, Any] = {t: self.table(t).count() for t in _SCHEMAS}
        if out["documents"]:
            out["by_status"] = {r[0]: r[1] for r in self.breakdown("status").collect()}
            out["by_type"] = {r[0]: r[1] for r in self.breakdown("entity_type").collect()}
        return out

    def drift(self, entity_type: str, sample: int | None = None, missing: bool = True) -> DataFrame:
        """(entity_id, drift) of a type, or of a random sample of its documents (then nothing is missing)."""
        stored, keys = self._part("documents", entity_type), None
        dependencies = self._part("dependencies", entity_type)
        if sample is not None:
            stored, missing = cut_lineage(drifts.sample(stored, sample)), False
            keys = stored.select("entity_id")
            dependencies = dependencies.join(keys, "entity_id", "left_semi")
        return drifts.drift(self.desired(entity_type, keys), stored, self._dependencies(entity_type, keys), dependencies, missing)

    def verify(self, entity_type: str | None = None, sample: int | None = None, fix: bool = False, force_dependencies: bool = False) -> dict[str, Any]:
        """Checked, drifted, fixed and orphaned counts, a report of at most REPORT_ROWS rows, and ok.

        Missing documents count only with an explicit type and no sample. Orphans are told but are no failure.
        fix syncs what drifted; since equal hashes are skipped, dependencies alone are repaired only with
        force_dependencies.
        """
        total, report, by_type = {"checked": 0, "drifted": 0, "fixed": 0, "orphaned": 0}, [], {}
        for t in [entity_type] if entity_type else self.entity_types():
            if t not in self.catalog:
                continue
            found = cut_lineage(self.drift(t, sample, missing=entity_type is not None and sample is None))
            orphaned = F.array_contains("drift", drifts.ORPHANED)
            counts = found.agg(F.count_if(orphaned).alias("o"), F.count_if(~orphaned).alias("d")).first()
            checked = self._part("documents", t).count()
            total["checked"] += min(checked, sample) if sample else checked
            total["drifted"] += counts.d
            total["orphaned"] += counts.o
            if len(report) < REPORT_ROWS:
                report += [(t, r.entity_id, list(r.drift)) for r in found.orderBy("entity_id").limit(REPORT_ROWS - len(report)).collect()]
            if fix and counts.d:
                self.sync(t, found.where(~orphaned).select("entity_id"), force=force_dependencies)
                total["fixed"] += counts.d
            by_type[t] = counts.d + counts.o
        return {**total, "report": report, "more": max(0, total["drifted"] + total["orphaned"] - len(report)), "ok": total["drifted"] == total["fixed"]}

    def _capabilities(self) -> tuple[str, str, str]:
        """Whether Spark and the packages that pass vectors to Python are there and recent enough."""
        version = tuple(int(x) for x in self.spark.version.split(".")[:2])
        missing = []
        for name in ("numpy", "pandas", "pyarrow"):
            try:
                __import__(name)
            except ImportError:
                missing.append(name)
        told = self.spark.version + (f", without {', '.join(missing)}" if missing else "")
        return ("capabilities", "OK" if version >= LEAST_SPARK and not missing else "FAIL", told)

    def doctor(self) -> list[tuple[str, str, str]]:
        """(check, level, detail): FAIL for what must be mended before use, WARN for what may be meant, else OK."""
        out = [self._capabilities()]
        documents, chunks, dependencies = (self.table(t) for t in _SCHEMAS)
        declared = [int(x) for x in self.store.note("dimensions")]
        widths = sorted(r[0] for r in chunks.where("embedding IS NOT NULL").select(F.size("embedding")).distinct().limit(EXAMPLES + 1).collect())
        wrong = [f"vectors of width {w}" for w in widths if w != self.config.dimensions] + [f"width {w} declared" for w in declared if w != self.config.dimensions]
        out.append(("dimensions", "FAIL", f"{', '.join(wrong)}, {self.config.dimensions} set") if wrong else ("dimensions", "OK", str(self.config.dimensions)))
        out.append(("embedder", "OK", self.embedder.provider) if self.embedder else ("embedder", "WARN", "none: no embedding and no search"))
        out.append(("search", "WARN", "approximate") if self.config.search_mode == "ann" else ("search", "OK", self.config.search_mode))
        for t in self.entity_types():
            cells, stale, buckets = self.vector_index(t)
            if cells:
                out.append((f"vector index of {t}", "WARN" if stale else "OK", f"{cells} cells, {stale} of {buckets} buckets changed since"))
            else:
                out.append((f"vector index of {t}", "WARN", "none: every search reads all vectors"))
        orphans = dependencies.join(documents.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti").count()
        out.append(("orphan dependencies", "WARN" if orphans else "OK", str(orphans)))
        for state in (reconcile.PENDING, reconcile.FAILED):
            rows = self.in_state(state)
            n = rows.count()
            shown = "; ".join(f"{r.entity_type} {r.entity_id}: {r.last_error}" for r in rows.orderBy("entity_type", "entity_id").limit(EXAMPLES).collect()) if n and state == reconcile.FAILED else ""
            out.append((f"{state} documents", "WARN" if n else "OK", f"{n} {shown}".strip()))
        return out

    def in_state(self, state: str) -> DataFrame:
        """The documents of a status."""
        return self.table("documents").where(F.col("status") == state)
