"""How far stored documents are from what their entities would render now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING, CONTENT, CONFIGURATION, DEPENDENCIES, ORPHANED = "missing", "content", "configuration", "dependencies", "orphaned"


def _hash_of_set(df: DataFrame, name: str) -> DataFrame:
    """(entity_id, name): an order-free digest of the related rows of each document: their number and two sums of hashes.

    Sums merge in partial aggregation, so a document with very many dependencies is never gathered.
    """
    pair = df.select("entity_id", "dependency_type", "dependency_id").distinct()
    a, b = F.xxhash64("dependency_type", "dependency_id"), F.xxhash64(F.lit("second"), "dependency_id", "dependency_type")
    return pair.groupBy("entity_id").agg(F.struct(F.count(F.lit(1)), F.sum(a.cast("decimal(20,0)")), F.sum(b.cast("decimal(20,0)"))).alias(name))


def drift(desired: DataFrame, stored: DataFrame, desired_dependencies: DataFrame, stored_dependencies: DataFrame, missing: bool = True) -> DataFrame:
    """(entity_id, drift array<string>): entities and documents that don't agree.

    missing alone, orphaned alone (a document without an entity), else any of content, configuration and
    dependencies in that order. missing: whether entities without a document count.
    """
    new = desired.select(F.col("entity_id").alias("k"), F.col("content_hash").alias("c"), F.col("configuration_hash").alias("g"))
    old = stored.select("entity_id", "content_hash", "configuration_hash")
    both = new.join(old, F.col("k") == F.col("entity_id"), "full_outer")
    both = both.withColumn("id", F.coalesce("k", "entity_id"))
    both = both.join(_hash_of_set(desired_dependencies, "want").withColumnRenamed("entity_id", "id"), "id", "left")
    both = both.join(_hash_of_set(stored_dependencies, "have").withColumnRenamed("entity_id", "id"), "id", "left")
    kinds = F.when(F.col("entity_id").isNull(), F.array(F.lit(MISSING))).when(F.col("k").isNull(), F.array(F.lit(ORPHANED))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.col("c").eqNullSafe(F.col("content_hash")), F.lit(CONTENT)),
                F.when(~F.col("g").eqNullSafe(F.col("configuration_hash")), F.lit(CONFIGURATION)),
                F.when(~F.col("want").eqNullSafe(F.col("have")), F.lit(DEPENDENCIES)),
            )
        )
    )
    found = both.select(F.col("id").alias("entity_id"), kinds.alias("drift")).where(F.size("drift") > 0)
    return found if missing else found.where(~F.array_contains("drift", MISSING))


def sample(documents: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer), chosen at random."""
    if n < 1:
        raise ValueError("a sample must have at least 1 row")
    return documents.orderBy(F.rand(seed)).limit(n)


def orphan_dependencies(dependencies: DataFrame, documents: DataFrame) -> DataFrame:
    """Dependencies whose document isn't there."""
    return dependencies.join(documents.select("entity_id"), "entity_id", "left_anti")


def pruned_keys(documents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(entity_id) of documents whose entity row is gone."""
    return documents.select("entity_id").join(rows.select(F.col(key).alias("entity_id")), "entity_id", "left_anti")


def missing_keys(documents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(entity_id) of entity rows without a document."""
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("entity_id")).distinct().join(documents.select("entity_id"), "entity_id", "left_anti")
