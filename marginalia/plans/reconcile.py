"""New states of documents, chunks and dependencies from desired and stored ones, as joins on keys.

Nothing here writes. Row identity is kept: unchanged rows carry their created_at, version and vectors over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, SYNCED, FAILED = "pending", "synced", "failed"

#: Schemas of the index tables; {id} is the type of ids.

DOCUMENTS = "entity_id {id}, version int, content_hash string, configuration_hash string, status string, last_error string, synced_at timestamp, created_at timestamp, updated_at timestamp"
CHUNKS = (
    "entity_id {id}, chunk_index int, content_hash string, embedding array<float>, embedding_provider string, embedding_model string, "
    "embedding_dimensions int, embedding_hash string, metadata string, created_at timestamp, updated_at timestamp"
)
DEPENDENCIES = "entity_id {id}, dependency_type string, dependency_id {id}, created_at timestamp"
PROVENANCE = ("embedding", "embedding_provider", "embedding_model", "embedding_dimensions", "embedding_hash")


def changed(force: bool, old_key: Column, hashes: list[tuple[Column, Column]]) -> Column:
    """Whether a document must be written: forced, not stored, or either hash differs."""
    differs = F.lit(force) | old_key.isNull()
    for a, b in hashes:
        differs = differs | ~a.eqNullSafe(b)
    return differs


def actions(desired: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(entity_id, existed, is_changed, configuration_changed) of each desired document. Repeated keys count once."""
    one = desired.select("entity_id", "content_hash", "configuration_hash").dropDuplicates(["entity_id"])
    old = stored.select(F.col("entity_id").alias("o"), F.col("content_hash").alias("oc"), F.col("configuration_hash").alias("og"))
    both = one.join(old, F.col("entity_id") == F.col("o"), "left")
    return both.select(
        "entity_id",
        F.col("o").isNotNull().alias("existed"),
        changed(force, F.col("o"), [(F.col("content_hash"), F.col("oc")), (F.col("configuration_hash"), F.col("og"))]).alias("is_changed"),
        (F.col("o").isNotNull() & ~F.col("configuration_hash").eqNullSafe(F.col("og"))).alias("configuration_changed"),
    )


def new_documents(desired: DataFrame, stored: DataFrame, force: bool = False, now: Column | None = None) -> DataFrame:
    """The documents table after a pass: changed ones pending, error cleared, version raised if forced and stored before;
    all others, and stored ones that aren't desired, as they were."""
    now = F.current_timestamp() if now is None else now
    one = desired.select("entity_id", "content_hash", "configuration_hash").dropDuplicates(["entity_id"]).select(F.col("entity_id").alias("k"), F.col("content_hash").alias("c"), F.col("configuration_hash").alias("g"))
    both = one.join(stored, F.col("k") == F.col("entity_id"), "full_outer")
    write = F.col("k").isNotNull() & changed(force, F.col("entity_id"), [(F.col("c"), F.col("content_hash")), (F.col("g"), F.col("configuration_hash"))])
    existed = F.col("entity_id").isNotNull()
    version = F.when(existed & F.lit(force), F.col("version") + 1).otherwise(F.coalesce("version", F.lit(1)))

    def pick(new: Column, old: str) -> Column:
        return F.when(write, new).otherwise(F.col(old)).alias(old)

    return both.select(
        F.coalesce("k", "entity_id").alias("entity_id"), pick(version.cast("int"), "version"), pick(F.col("c"), "content_hash"), pick(F.col("g"), "configuration_hash"),
        pick(F.lit(PENDING), "status"), pick(F.lit(None).cast("string"), "last_error"), pick(now, "synced_at"),
        F.coalesce("created_at", now).alias("created_at"), pick(now, "updated_at"),
    )


def new_chunks(desired: DataFrame, stored: DataFrame, touched: DataFrame, now: Column | None = None) -> DataFrame:
    """The chunks table after a pass.

    touched: the actions of the pass (entity_id, is_changed, configuration_changed). Chunks of changed
    documents become the desired ones; a vector stays only where the chunk's hash is the same and the
    document's configuration is. Surplus stored chunks of changed documents go; all others stay.
    """
    now = F.current_timestamp() if now is None else now
    work = touched.where("is_changed").select("entity_id", "configuration_changed")
    new = desired.join(work, "entity_id").select(
        F.col("entity_id").alias("k"), F.col("chunk_index").alias("i"), F.col("content_hash").alias("c"), F.col("configuration_changed").alias("g")
    )
    kept = stored.join(work.select("entity_id"), "entity_id", "left_anti")
    same = ~F.col("g") & F.col("c").eqNullSafe(F.col("content_hash"))
    both = new.join(stored, (F.col("k") == F.col("entity_id")) & (F.col("i") == F.col("chunk_index")), "left")
    written = both.select(
        F.col("k").alias("entity_id"), F.col("i").cast("int").alias("chunk_index"), F.col("c").alias("content_hash"),
        *[F.when(same, F.col(c)).alias(c) for c in PROVENANCE], F.col("metadata"),
        F.coalesce("created_at", now).alias("created_at"), F.when(same, F.col("updated_at")).otherwise(now).alias("updated_at"),
    )
    return kept.unionByName(written)


def new_dependencies(desired: DataFrame, stored: DataFrame, touched: DataFrame, now: Column | None = None) -> DataFrame:
    """The dependencies table after a pass: for changed documents stale rows go, new ones come, common ones keep created_at."""
    now = F.current_timestamp() if now is None else now
    keys = touched.where("is_changed").select("entity_id")
    triple = ["entity_id", "dependency_type", "dependency_id"]
    kept = stored.join(keys, "entity_id", "left_anti")
    written = desired.join(keys, "entity_id", "left_semi").select(*triple).distinct().join(stored, triple, "left").select(*triple, F.coalesce("created_at", now).alias("created_at"))
    return kept.select(*written.columns).unionByName(written)


def with_failures(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """errors (entity_id, message) recorded on stored documents; keys without a document are left alone."""
    one = errors.groupBy(F.col("entity_id").alias("k")).agg(F.min("message").alias("message"))
    failed = F.col("k").isNotNull()
    return documents.join(one, F.col("entity_id") == F.col("k"), "left").select(
        *[F.when(failed, F.lit(FAILED)).otherwise(F.col(c)).alias(c) if c == "status" else F.when(failed, F.col("message")).otherwise(F.col(c)).alias(c) if c == "last_error" else F.col(c) for c in documents.columns]
    )


def flipped(documents: DataFrame, chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents set to synced: hashes as expected (entity_id, content_hash, configuration_hash) and no chunk without a vector.

    A document without chunks is synced. last_error stays.
    """
    waiting = chunks.where(F.col("embedding").isNull()).select("entity_id").distinct()
    ready = expected.join(waiting, "entity_id", "left_anti").select(F.col("entity_id").alias("k"), F.col("content_hash").alias("c"), F.col("configuration_hash").alias("g"))
    both = documents.join(ready.distinct(), (F.col("entity_id") == F.col("k")) & F.col("content_hash").eqNullSafe(F.col("c")) & F.col("configuration_hash").eqNullSafe(F.col("g")), "left")
    return both.select(*[F.when(F.col("k").isNotNull(), F.lit(SYNCED)).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in documents.columns])
