"""An approximate index of stored vectors: cells around centroids, kept on disk by cell.

The centroids are fitted on a bounded sample; every usable vector goes to the cell of its nearest one. A search looks into
the cells whose centroids are nearest to the query, ranks what is there exactly, and reads nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import hash_sample, ship_code

#: Vectors the centroids are fitted on at most, and centroids at most.
SAMPLE, MOST_CELLS = 65_536, 4_096
#: One of so many cells is searched, but at least LEAST_PROBES.
PROBE_SHARE, LEAST_PROBES = 6, 8


def usable(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors in single precision) of vectors of that width, without null, NaN or infinite values and not all zero."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    place = np.flatnonzero(lengths == dimensions)
    x = vectors.take(pa.array(place)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return place[good], (x[good] / norm[good, None]).astype(np.float32)


def fit(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a centroid nothing is near to moves to a random vector."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), x[rng.choice(len(x), cells)])
    return centres.astype(np.float32)


def fit_on(chunks: DataFrame, dimensions: int, cells: int | None = None) -> np.ndarray:
    """Centroids for the vectors of chunks (entity_id, chunk_index, embedding): about the square root of their number, unless said."""
    keyed = chunks.where(F.size("embedding") == dimensions).select(F.xxhash64("entity_id", "chunk_index").alias("k"), "embedding")
    n = keyed.count()
    _, x = usable(hash_sample(keyed, "k", SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks(), dimensions)
    if not len(x):
        return np.zeros((0, dimensions), np.float32)
    return fit(x, cells or max(1, min(MOST_CELLS, int(n**0.5))))


def assigned(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(entity_id, chunk_index, content_hash, embedding, __bucket): each usable vector with the number of its cell."""
    ship_code(chunks.sparkSession)
    held = chunks.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            place, x = usable(batch.column(3), c.shape[1])
            cell = np.argmax(x @ c.T, axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(place)) for i in range(4)], pa.array(cell)], ["entity_id", "chunk_index", "content_hash", "embedding", "__bucket"])

    rows = chunks.select("entity_id", "chunk_index", "content_hash", "embedding").where(F.col("embedding").isNotNull())
    kind = rows.schema["entity_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"entity_id {kind}, chunk_index int, content_hash string, embedding array<float>, __bucket int")


def probes(centres: np.ndarray, query: Sequence[float], n: int | None = None) -> list[int]:
    """The cells to be searched, nearest first."""
    n = n or max(LEAST_PROBES, -(-len(centres) // PROBE_SHARE))
    return np.argsort(-(centres @ np.asarray(query, np.float32)), kind="stable")[:n].tolist()
