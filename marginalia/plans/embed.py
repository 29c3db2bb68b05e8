"""Filling of missing chunk vectors through an embedder of one's own."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.config import EngineConfig
from marginalia.functions.hashing import provenance_hash


class InvalidEmbeddingResponse(RuntimeError):
    """An embedder returned another number or width of vectors than asked for."""


class Embedder(Protocol):
    """provider: the name that goes into the provenance."""

    provider: str

    def embed(self, texts: list[str], model: str, dimensions: int) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors from a text's hash, for tests and dry runs."""

    provider = "hash"

    def embed(self, texts: list[str], model: str, dimensions: int) -> list[list[float]]:
        seeds = [int.from_bytes(hashlib.sha256(f"{model}\0{t}".encode()).digest()[:8], "big") for t in texts]
        return [np.random.default_rng(s).standard_normal(dimensions).astype(np.float32).tolist() for s in seeds]


class Retrying:
    """An embedder whose failed calls are made again, after the given pauses in seconds; the last error is raised."""

    def __init__(self, embedder: Embedder, pauses: tuple[float, ...] = (10.0, 60.0)) -> None:
        self.embedder, self.pauses, self.provider = embedder, pauses, embedder.provider

    def embed(self, texts: list[str], model: str, dimensions: int) -> list[list[float]]:
        for pause in (*self.pauses, None):
            try:
                return checked(self.embedder.embed(texts, model, dimensions), texts, dimensions)
            except Exception:
                if pause is None:
                    raise
                time.sleep(pause)
        raise AssertionError("unreachable")


def checked(vectors: list, texts: list[str], dimensions: int) -> list[list[float]]:
    if len(vectors) != len(texts):
        raise InvalidEmbeddingResponse(f"{len(texts)} vectors were asked for, {len(vectors)} came")
    for i, v in enumerate(vectors):
        if len(v) != dimensions:
            raise InvalidEmbeddingResponse(f"vector {i} has {len(v)} values instead of {dimensions}")
    return vectors


def pending(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """(entity_id, chunk_index, content_hash, text): stored chunks without a vector that the present text still has.

    fresh: the chunks of the documents as they are now, with text. A stored chunk with another hash, or an
    index that isn't there any more, stays as it is.
    """
    keys = ["entity_id", "chunk_index", "content_hash"]
    return chunks.where(F.col("embedding").isNull()).select(*keys).join(fresh.select(*keys, "text"), keys)


def embedded(work: DataFrame, embedder: Embedder, config: EngineConfig, batch: int = 64) -> DataFrame:
    """(entity_id, chunk_index, content_hash, embedding, error): one row for each row of work.

    The embedder is called with at most ``batch`` texts at a time. If a call fails or answers wrongly, its
    rows get the error and no vector; the other calls go on.
    """
    model, dimensions = config.model, config.dimensions

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                texts = part["text"].tolist()
                try:
                    vectors, error = checked(embedder.embed(texts, model, dimensions), texts, dimensions), None
                except Exception as e:  # one call's failure is that of its rows
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part[["entity_id", "chunk_index", "content_hash"]].assign(embedding=vectors, error=error)

    kind = work.schema["entity_id"].dataType.simpleString()
    return work.mapInPandas(run, f"entity_id {kind}, chunk_index int, content_hash string, embedding array<float>, error string")


def with_vectors(chunks: DataFrame, vectors: DataFrame, embedder: Embedder, config: EngineConfig) -> DataFrame:
    """The chunks with the vectors written in where key, index and hash are still those they were made for."""
    new = vectors.where(F.col("embedding").isNotNull()).select(F.col("entity_id").alias("k"), F.col("chunk_index").alias("i"), F.col("content_hash").alias("c"), F.col("embedding").alias("v"))
    both = chunks.join(new, (F.col("entity_id") == F.col("k")) & (F.col("chunk_index") == F.col("i")) & (F.col("content_hash") == F.col("c")), "left")
    fill = F.col("v").isNotNull() & F.col("embedding").isNull()
    values = {
        "embedding": F.col("v"),
        "embedding_provider": F.lit(embedder.provider),
        "embedding_model": F.lit(config.model),
        "embedding_dimensions": F.lit(config.dimensions),
        "embedding_hash": provenance_hash(F.col("content_hash"), embedder.provider, config.model, config.dimensions),
        "updated_at": F.current_timestamp(),
    }
    return both.select(*[F.when(fill, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in chunks.columns])
