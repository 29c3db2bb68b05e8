"""Cosine search over entities, each scored by its closest chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.vectors import cosine_distance, query_norm

Scope = Column | Callable[[DataFrame], DataFrame] | None


def validated_limit(limit: int, min_similarity: float | None, max_limit: int) -> int:
    """The limit, clamped; errors for a limit below 1 and a similarity outside [0, 1]."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if min_similarity is not None and not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity must lie in [0, 1]")
    return min(limit, max_limit)


def scoped(chunks: DataFrame, scope: Scope) -> DataFrame:
    """The chunks a scope admits; a Column is and-ed, a callable may only filter, which its plan must show: filters above the chunks and nothing else."""
    if scope is None:
        return chunks
    if isinstance(scope, Column):
        return chunks.where(scope)
    out = scope(chunks)
    plan, given = out._jdf.queryExecution().analyzed(), chunks._jdf.queryExecution().analyzed()
    while not plan.fastEquals(given):
        if plan.nodeName() != "Filter":
            raise ValueError("a scope may only filter")
        plan = plan.children().head()
    return out


def _exact(chunks: DataFrame, query: Sequence[float], floor: float | None) -> DataFrame:
    near = chunks.select("entity_id", "chunk_index", "content_hash", cosine_distance(F.col("embedding"), query).alias("distance")).where(F.col("distance").isNotNull())
    if floor is not None:  # below the aggregation: a chunk too far can't be the closest that counts
        near = near.where(F.col("distance") <= floor)
    best = F.min(F.struct("distance", "chunk_index", "content_hash"))
    return near.groupBy("entity_id").agg(best.alias("b")).select("entity_id", "b.distance", "b.chunk_index", F.col("b.content_hash").alias("chunk_hash"))


def _vectorised(chunks: DataFrame, query: Sequence[float], floor: float | None) -> DataFrame:
    """The same with one matrix product for each batch; a batch sends the best chunk of each of its entities."""
    q, most = np.asarray(query, np.float64), np.inf if floor is None else floor
    length = query_norm(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            right = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(q))
            x = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            own = np.sqrt(np.einsum("ij,ij->i", x, x))
            with np.errstate(invalid="ignore", divide="ignore"):
                distance = 1 - (x @ q) / (own * length)
            good = (own > 0) & np.isfinite(own) & (distance <= most)
            right, distance = right[good], distance[good]
            ids, index = batch.column(0).to_numpy(zero_copy_only=False)[right], batch.column(1).to_numpy(zero_copy_only=False)[right]
            order = np.lexsort((index, distance, ids))
            first = order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(order) else order
            at = pa.array(right[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(distance[first]), batch.column(1).take(at), batch.column(2).take(at)], ["entity_id", "distance", "chunk_index", "content_hash"])

    kind = chunks.schema["entity_id"].dataType.simpleString()
    near = chunks.select("entity_id", "chunk_index", "content_hash", "embedding").mapInArrow(run, f"entity_id {kind}, distance double, chunk_index int, content_hash string")
    best = F.min(F.struct("distance", "chunk_index", "content_hash"))
    return near.groupBy("entity_id").agg(best.alias("b")).select("entity_id", "b.distance", "b.chunk_index", F.col("b.content_hash").alias("chunk_hash"))


def rank(chunks: DataFrame, query: Sequence[float], limit: int = 10, min_similarity: float | None = None, scope: Scope = None, max_limit: int = 1000, mode: str = "exact") -> DataFrame:
    """(entity_id, distance, score, chunk_index, chunk_hash): the closest entities, ascending distance, ties by entity_id.

    chunks: entity_id, chunk_index, content_hash, embedding. An entity's distance is that of its closest chunk, of
    equal ones the first. Chunks without a vector, of another width, with a null or NaN in it or of norm 0 are passed over;
    a query of norm 0 finds nothing. min_similarity is inclusive and holds for each chunk before the closest is taken.
    """
    limit = validated_limit(limit, min_similarity, max_limit)
    live = scoped(chunks.where(F.col("embedding").isNotNull()), scope)
    floor = None if min_similarity is None else 1 - min_similarity
    if query_norm(query) == 0:
        live = live.limit(0)
    best = (_vectorised if mode == "vectorised" else _exact)(live, query, floor)
    return best.orderBy("distance", "entity_id").limit(limit).select("entity_id", "distance", (1 - F.col("distance")).alias("score"), "chunk_index", "chunk_hash")


def hydrated(ranked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """ranked with the entities' rows, numbered by place; entities that are gone leave fewer rows, never others.

    ranked has at most max_limit rows, so it is what is broadcast, not the entities.
    """
    from pyspark.sql import Window

    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy("distance", "entity_id")))
    return F.broadcast(placed).join(rows.withColumnRenamed(key, "entity_id"), "entity_id").orderBy("place")


def with_text(ranked: DataFrame, fresh: DataFrame) -> DataFrame:
    """ranked with chunk_text: the text of the chunk found, null if the entity's present text has not that chunk any more."""
    texts = fresh.join(F.broadcast(ranked.select("entity_id").distinct()), "entity_id", "left_semi")
    now = texts.select(F.col("entity_id").alias("__k"), F.col("chunk_index").alias("__i"), F.col("content_hash").alias("__h"), F.col("text").alias("chunk_text"))
    hit = (F.col("entity_id") == F.col("__k")) & (F.col("chunk_index") == F.col("__i")) & (F.col("chunk_hash") == F.col("__h"))
    return ranked.join(now, hit, "left").drop("__k", "__i", "__h")
