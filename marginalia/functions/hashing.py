"""Content and provenance hashes as expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 of a text, in lower-case hexadecimal digits."""
    return F.sha2(text, 256)


def provenance_hash(chunk_hash: Column, provider: str | None, model: str, dimensions: int) -> Column:
    """Hash of what a vector was made of: the chunk's hash, and the resolved provider, model and width. Keys are in sorted order."""
    tail = json.dumps({"dimensions": dimensions, "model": model, "provider": provider}, separators=(",", ":"), ensure_ascii=False)
    return F.sha2(F.concat(F.lit('{"contentHash":"'), chunk_hash, F.lit('",' + tail[1:])), 256)


def vector_width(type_name: Column) -> Column:
    """The n of a type name vector(n) in any case, null if it says none."""
    found = F.regexp_extract(type_name, r"(?i)^\s*vector\s*\(\s*(\d+)\s*\)", 1)
    return F.when(found != "", found.cast("int"))
