"""Queries of the core over the tables of one directory, with their SQL; those of problems 2 to 5 first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import index_queries, operation_queries
from marginalia.operators import diffing, hotkeys, incremental, references
from marginalia.runtime import cut_lineage, shared_dir
from marginalia.sources.store import SnapshotStore
from marginalia.sources.tables import KIND_TABLES, current_rows, kind_of, micros, table

# -- 2: new or changed records ----------------------------------------------------------------------


def _current_records(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "rag_documents").select(
        F.lit("rag_documents").alias("table_name"), F.col("id").alias("record_id"), F.col("version"), "content_hash", "configuration_hash", F.lit(True).alias("compare_configuration")
    )
    chunks = table(spark, d, "rag_chunks").select(
        F.lit("rag_chunks").alias("table_name"), F.col("id").alias("record_id"), F.lit(0).alias("version"), "content_hash", F.lit(None).cast("string").alias("configuration_hash"), F.lit(False).alias("compare_configuration")
    )
    return documents.unionByName(chunks)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pending_records(_current_records(spark, d), table(spark, d, "sync_ledger"), table(spark, d, "sync_runs"))


def p2_processed_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The merged intervals of ids whose records are as the last successful run left them."""
    states = incremental.record_states(_current_records(spark, d), table(spark, d, "sync_ledger"), table(spark, d, "sync_runs"))
    return incremental.processed_intervals(states)


def _two_runs_source(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, record_id, at): each record of the two tables once."""
    parts = [table(spark, d, name).where("id IS NOT NULL").groupBy(F.col("id").alias("record_id")).agg(F.min("created_at").alias("at")).select(F.lit(name).alias("table_name"), "record_id", "at") for name in ("rag_documents", "rag_chunks")]
    return parts[0].unionByName(parts[1])


class _Died(RuntimeError):
    pass


class _DyingStore(SnapshotStore):
    """Its writer dies when all tables are written and before anything is published."""

    def _publish(self, version: int, manifest: dict[str, list[str]]) -> None:
        raise _Died


def p2_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """How often each record was processed by runs of which one dies at work, one commits while another works, and late records come between.

    The first run sees the records made in the earlier half of the time, whatever their ids; later ones see all.
    """
    store = SnapshotStore(spark, f"{shared_dir(spark)}/two-runs-{uuid.uuid4().hex[:8]}")
    runner, rival = (incremental.IncrementalProcessor(spark, store) for _ in range(2))
    every = cut_lineage(_two_runs_source(spark, d))
    low, high = every.agg(F.min(F.unix_micros(F.col("at").cast("timestamp"))), F.max(F.unix_micros(F.col("at").cast("timestamp")))).first()
    early = every.where(F.unix_micros(F.col("at").cast("timestamp")) <= ((low or 0) + (high or 0)) // 2)
    keep = lambda rows: rows.select("table_name", "record_id")
    runner.run(early, "record_id", keep)
    try:
        incremental.IncrementalProcessor(spark, _DyingStore(spark, store.root)).run(every, "record_id", keep)
    except _Died:
        pass

    def overtaken(rows: DataFrame) -> DataFrame:
        if store.version == 1:  # while this one works, the other commits part of the same
            rival.run(every.where("table_name = 'rag_chunks'"), "record_id", keep)
        return keep(rows)

    runner.run(every, "record_id", overtaken)
    if not store.has("output"):
        return keep(every.limit(0)).withColumn("times", F.lit(0).cast("bigint"))
    return store.read(spark, "output").groupBy("table_name", "record_id").agg(F.count(F.lit(1)).alias("times"))


P2_TWO_RUNS_SQL = """
SELECT 'rag_documents' AS table_name, id AS record_id, CAST(1 AS BIGINT) AS times FROM rag_documents WHERE id IS NOT NULL GROUP BY id
UNION ALL SELECT 'rag_chunks', id, CAST(1 AS BIGINT) FROM rag_chunks WHERE id IS NOT NULL GROUP BY id"""

_STATES_SQL = """
WITH cur AS (
  SELECT 'rag_documents' AS table_name, id AS record_id, content_hash, configuration_hash, true AS conf
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM rag_documents WHERE id IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT DISTINCT 'rag_chunks', id, content_hash, NULL, false FROM rag_chunks WHERE id IS NOT NULL),
last AS (
  SELECT table_name, record_id, content_hash, configuration_hash,
         row_number() OVER (PARTITION BY table_name, record_id ORDER BY run_id DESC) AS rn
  FROM sync_ledger WHERE run_id IN (SELECT run_id FROM sync_runs WHERE run_state = 'succeeded')),
states AS (
  SELECT c.table_name, c.record_id,
         l.record_id IS NOT NULL AND c.content_hash IS NOT DISTINCT FROM l.content_hash
         AND (NOT c.conf OR c.configuration_hash IS NOT DISTINCT FROM l.configuration_hash) AS processed
  FROM cur c LEFT JOIN (SELECT * FROM last WHERE rn = 1) l USING (table_name, record_id))
"""

P2_FOUND_SQL = _STATES_SQL + "SELECT table_name, record_id FROM states WHERE NOT processed"
P2_INTERVALS_SQL = (
    _STATES_SQL
    + """
SELECT table_name, min(record_id) AS lo, max(record_id) AS hi FROM (
  SELECT table_name, record_id, record_id - row_number() OVER (PARTITION BY table_name ORDER BY record_id) AS island
  FROM states WHERE processed) GROUP BY table_name, island"""
)

# -- 3: hot keys -------------------------------------------------------------------------------------


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rag_dependencies").select("id", kind_of(F.col("dependency_type")).alias("dependency_kind"), "dependency_id", micros(F.col("created_at")).alias("at"))


_KEY = ["dependency_kind", "dependency_id"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(_dependencies(spark, d), _KEY, "id", share=0.02).select(*_KEY)


def p3_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Per key: rows, and the exact quartiles of the dependencies' creation in microseconds."""
    return hotkeys.per_key_quantiles(_dependencies(spark, d), _KEY, "id", "at", (0.25, 0.5, 0.75))


_DEPS_SQL = r"""
WITH deps AS (
  SELECT DISTINCT id, lower(trim(list_last(string_split(dependency_type, '\')))) AS dependency_kind, dependency_id, epoch_us(created_at) AS made
  FROM rag_dependencies WHERE id IS NOT NULL AND dependency_type IS NOT NULL AND dependency_id IS NOT NULL)
"""
P3_FOUND_SQL = (
    _DEPS_SQL
    + """SELECT dependency_kind, dependency_id FROM deps GROUP BY ALL
HAVING count(*) * 50 >= (SELECT count(*) FROM deps)"""
)
P3_QUANTILES_SQL = (
    _DEPS_SQL
    + """SELECT dependency_kind, dependency_id, count(*) AS n, count(made) AS n_values,
quantile_disc(made, 0.25) AS q0, quantile_disc(made, 0.5) AS q1, quantile_disc(made, 0.75) AS q2 FROM deps GROUP BY ALL"""
)

# -- 4: orphan references ----------------------------------------------------------------------------


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, targets, deletions) of the three reference fields; repeated rows count once."""
    kinds = list(KIND_TABLES)
    documents = current_rows(table(spark, d, "rag_documents"), "id", "version", "model_type", "model_id", "created_at")
    dependencies = table(spark, d, "rag_dependencies").where("id IS NOT NULL").dropDuplicates(["id"])
    both = F.array(
        F.struct(F.lit("dependency_id").alias("f"), kind_of(F.col("dependency_type")).alias("kind"), F.col("dependency_id").cast("bigint").alias("key")),
        F.struct(F.lit("document_id").alias("f"), F.lit("ragdocument").alias("kind"), F.col("document_id").cast("bigint").alias("key")),
    )
    found = (
        documents.select(F.lit("rag_documents").alias("ref_table"), F.lit("model_id").alias("ref_field"), F.col("id").alias("row_id"), kind_of(F.col("model_type")).alias("kind"), F.col("model_id").cast("bigint").alias("key"), "created_at")
        .unionByName(
            dependencies.select("id", "created_at", F.explode(both).alias("r")).select(F.lit("rag_dependencies").alias("ref_table"), F.col("r.f").alias("ref_field"), F.col("id").alias("row_id"), "r.kind", "r.key", "created_at")
        )
        .where(F.col("kind").isin(kinds) & F.col("key").isNotNull())
    )
    targets = None
    for kind, name in KIND_TABLES.items():
        rows = documents if name == "rag_documents" else table(spark, d, name)
        one = rows.select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "created_at")
        targets = one if targets is None else targets.unionByName(one)
    deletions = table(spark, d, "entity_deletions").select(kind_of(F.col("entity_type")).alias("kind"), F.col("entity_id").alias("key"), "deleted_at")
    return found, targets, deletions


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = references.orphans(*_references(spark, d))
    return found.select("ref_table", "ref_field", "row_id", references.month_of(F.col("created_at")).alias("ref_month"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_references(spark, d))


_ORPHANS_SQL = r"""
WITH docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM rag_documents WHERE id IS NOT NULL) WHERE rn = 1),
deps AS (SELECT DISTINCT * FROM rag_dependencies WHERE id IS NOT NULL),
refs AS (
  SELECT 'rag_documents' AS ref_table, 'model_id' AS ref_field, id AS row_id, lower(trim(list_last(string_split(model_type, '\')))) AS kind, model_id AS k, created_at FROM docs
  UNION ALL SELECT 'rag_dependencies', 'dependency_id', id, lower(trim(list_last(string_split(dependency_type, '\')))), dependency_id, created_at FROM deps
  UNION ALL SELECT 'rag_dependencies', 'document_id', id, 'ragdocument', document_id, created_at FROM deps),
targets AS (
  SELECT 'product' AS kind, id AS k, created_at FROM products UNION SELECT 'brand', id, created_at FROM brands
  UNION SELECT 'category', id, created_at FROM categories UNION SELECT 'feature', id, created_at FROM features
  UNION SELECT 'ragdocument', id, created_at FROM docs),
gone AS (SELECT lower(trim(list_last(string_split(entity_type, '\')))) AS kind, entity_id AS k, max(deleted_at) AS deleted_at FROM entity_deletions GROUP BY ALL),
live AS (
  SELECT kind, k, min(t.created_at) AS born FROM targets t LEFT JOIN gone USING (kind, k)
  WHERE deleted_at IS NULL OR t.created_at IS NULL OR deleted_at < t.created_at GROUP BY ALL),
orphans AS (
  SELECT ref_table, ref_field, row_id, coalesce(strftime(created_at, '%Y-%m'), 'none') AS ref_month
  FROM refs r LEFT JOIN (SELECT *, true AS there FROM live) l USING (kind, k)
  WHERE r.k IS NOT NULL AND kind IN ('product', 'brand', 'category', 'feature', 'ragdocument') AND (there IS NULL OR born > r.created_at))
"""
P4_FOUND_SQL = _ORPHANS_SQL + "SELECT * FROM orphans"
P4_COUNTS_SQL = _ORPHANS_SQL + "SELECT ref_table, ref_field, ref_month, count(*) AS orphans FROM orphans GROUP BY ALL"

# -- 5: differences between copies -------------------------------------------------------------------

_FIELDS = ["content_hash", "configuration_hash", "model_id"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = diffing.differences(table(spark, d, "rag_documents"), table(spark, d, "rag_documents_copy"), "id", "version", _FIELDS)
    return found.withColumnRenamed("id", "document_id")


P5_FOUND_SQL = """
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM rag_documents WHERE id IS NOT NULL) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn FROM rag_documents_copy WHERE id IS NOT NULL) WHERE rn = 1)
SELECT id AS document_id, 'missing_in_copy' AS field_name FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'missing_in_main' FROM b WHERE id NOT IN (SELECT id FROM a)
UNION ALL SELECT a.id, 'content_hash' FROM a JOIN b USING (id) WHERE a.content_hash IS DISTINCT FROM b.content_hash
UNION ALL SELECT a.id, 'configuration_hash' FROM a JOIN b USING (id) WHERE a.configuration_hash IS DISTINCT FROM b.configuration_hash
UNION ALL SELECT a.id, 'model_id' FROM a JOIN b USING (id) WHERE a.model_id IS DISTINCT FROM b.model_id
"""

QUERIES = {
    "p2_found": (p2_found, P2_FOUND_SQL),
    "p2_processed_intervals": (p2_processed_intervals, P2_INTERVALS_SQL),
    "p2_two_runs": (p2_two_runs, P2_TWO_RUNS_SQL),
    "p3_found": (p3_found, P3_FOUND_SQL),
    "p3_quantiles": (p3_quantiles, P3_QUANTILES_SQL),
    "p4_found": (p4_found, P4_FOUND_SQL),
    "p4_counts": (p4_counts, P4_COUNTS_SQL),
    "p5_found": (p5_found, P5_FOUND_SQL),
} | index_queries.QUERIES | operation_queries.QUERIES
