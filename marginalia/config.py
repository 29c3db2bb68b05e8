"""All settings of an index, and the hash that says under which of them a document was made."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from typing import Any


def canonical_json(data: Any) -> str:
    """Compact JSON with sorted keys; lists keep their order; slashes and Unicode stay as they are, but U+2028 and U+2029."""
    text = json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class EngineConfig:
    """Settings; the defaults are those of the configuration table in the blueprint."""

    max_tokens: int = 400
    overlap: int = 40
    tokenizer: str = "whitespace"
    tokenizer_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    provider: str | None = None
    model: str = "text-embedding-3-small"
    dimensions: int = 1536
    auto_embed: bool = False
    auto_batch_size: int = 50
    batch_size: int = 500
    debounce_seconds: int = 5
    max_limit: int = 1000
    search_mode: str = "exact"
    id_type: str = "bigint"
    buckets: int = 64
    attempts: int = 3
    #: Seconds after which a pass that failed as a whole is tried again, such as (10, 60).
    pauses: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        check_chunking(self.max_tokens, self.overlap)
        if self.dimensions < 1:
            raise ValueError("dimensions must be at least 1")
        if self.search_mode not in ("exact", "vectorised", "ann"):
            raise ValueError("search_mode must be exact, vectorised or ann")
        if self.id_type not in ("bigint", "string"):
            raise ValueError("id_type must be bigint or string")
        if self.buckets < 1 or self.attempts < 1:
            raise ValueError("buckets and attempts must be at least 1")

    def with_(self, **changes: Any) -> EngineConfig:
        return replace(self, **changes)


def check_chunking(max_tokens: int, overlap: int) -> None:
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= max_tokens:
        raise ValueError("overlap must be below max_tokens")


def configuration_hash(spec, config: EngineConfig) -> str:
    """Hash of everything a document's text, chunks and vectors depend on besides the data; the provider as configured, null too.

    The tokenizer counts by its identity, which for a vocabulary says what is in it.
    """
    from marginalia.functions.tokens import make_tokenizer

    identity = make_tokenizer(config.tokenizer, config.tokenizer_path).identifier()
    return sha256(
        canonical_json(
            {
                "content": list(spec.content),
                "relations": list(spec.relations),
                "orderedPaths": list(spec.ordered),
                "chunk": {"max_tokens": config.max_tokens, "overlap": config.overlap, "tokenizer": identity},
                "embedding": {"provider": config.provider, "model": config.model, "dimensions": config.dimensions},
            }
        )
    )
