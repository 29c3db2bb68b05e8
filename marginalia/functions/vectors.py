"""Vector expressions in double arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def query_norm(query: Sequence[float]) -> float:
    return math.sqrt(sum(float(x) * float(x) for x in query))


def cosine_distance(vector: Column, query: Sequence[float]) -> Column:
    """1 - cosine to a fixed query; null for a null vector, another width, a null or NaN in it, or norm 0 or infinite on either side."""
    length = query_norm(query)
    literal = F.array(*[F.lit(float(x)) for x in query])
    own = norm(vector)
    valid = vector.isNotNull() & (F.size(vector) == len(query)) & (own > 0) & ~F.isnan(own) & (own < float("inf"))
    return F.when(valid & F.lit(0 < length < math.inf), 1 - dot(vector, literal) / (own * F.lit(length or 1.0)))


def parse_vector(text: Column, dimensions: int) -> Column:
    """A vector stored as a JSON list; null if it isn't one or has another width."""
    parsed = F.from_json(text, "array<float>")
    return F.when(F.size(parsed) == dimensions, parsed)
