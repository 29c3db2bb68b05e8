"""A recording double of the index for tests of code that uses it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from marginalia.config import EngineConfig
from marginalia.plans.render import render
from marginalia.plans.search import validated_limit
from marginalia.spec import EntityCatalog


class RecordingIndex:
    """Takes the same calls, validates paths and arguments like the index, records, and writes nothing.

    A sync of ids renders them as they are at that moment and keeps the texts.
    """

    def __init__(self, catalog: EntityCatalog, config: EngineConfig | None = None) -> None:
        self.catalog, self.config = catalog, config or EngineConfig()
        self.synced: list[tuple[str, Any, bool]] = []
        self.embedded: list[tuple[str, Any]] = []
        self.forgotten: list[tuple[str, Any]] = []
        self.searched: list[tuple[str, str, int, float | None]] = []
        self.invalidated: list[tuple[str, Any]] = []
        self._answers: dict[str, Any] = {}
        self._texts: dict[tuple[str, Any], str] = {}

    # -- calls -------------------------------------------------------------
    def sync(self, entity_type: str, ids: Any = None, force: bool = False) -> None:
        self.catalog.validate_spec(entity_type, self.catalog[entity_type].spec)
        ids = None if ids is None else list(ids)
        self.synced += [(entity_type, i, force) for i in (ids if ids is not None else [None])]
        if ids:
            self._texts |= {(entity_type, r.entity_id): r.text for r in render(self.catalog, entity_type, keys=ids).collect()}

    def embed(self, entity_type: str, ids: Any = None) -> None:
        self.embedded += [(entity_type, i) for i in (ids if ids is not None else [None])]

    def forget(self, entity_type: str, ids: Any) -> None:
        self.forgotten += [(entity_type, i) for i in ids]

    def invalidate(self, dependency_type: str, ids: Any) -> None:
        self.invalidated += [(dependency_type, i) for i in ([ids] if isinstance(ids, (int, str)) else ids)]

    def search_returns(self, entity_type: str, results: Any) -> RecordingIndex:
        """results: a value, or a function of (query, limit)."""
        self._answers[entity_type] = results
        return self

    def search(self, entity_type: str, query: str, limit: int = 10, min_similarity: float | None = None) -> Any:
        limit = validated_limit(limit, min_similarity, self.config.max_limit)
        self.searched.append((entity_type, query, limit, min_similarity))
        answer = self._answers.get(entity_type, [])
        answer = answer(query, limit) if callable(answer) else answer
        return answer[:limit] if isinstance(answer, list) else answer

    search_with_scores = search

    def render(self, entity_type: str, entity_id: Any) -> str | None:
        """The text of an entity as it is now; None if there is no such entity."""
        row = render(self.catalog, entity_type, keys=[entity_id]).first()
        return row and row.text

    def rendered_for(self, entity_type: str, entity_id: Any) -> str | None:
        """The text that the last recorded sync of this entity rendered; None if it was never synced."""
        return self._texts.get((entity_type, entity_id))

    # -- assertions --------------------------------------------------------
    def _syncs(self, entity_type: str, entity_id: Any, where: Callable[[tuple], bool] | None) -> list[tuple]:
        return [s for s in self.synced if s[0] == entity_type and (entity_id is None or s[1] == entity_id) and (where is None or where(s))]

    def assert_synced(self, entity_type: str, entity_id: Any = None, where: Callable[[tuple], bool] | None = None) -> None:
        assert self._syncs(entity_type, entity_id, where), f"{entity_type} {entity_id} was not synced"

    def assert_not_synced(self, entity_type: str, entity_id: Any = None, where: Callable[[tuple], bool] | None = None) -> None:
        assert not self._syncs(entity_type, entity_id, where), f"{entity_type} {entity_id} was synced"

    def assert_synced_times(self, entity_type: str, times: int, entity_id: Any = None) -> None:
        n = len(self._syncs(entity_type, entity_id, None))
        assert n == times, f"{entity_type} {entity_id} was synced {n} times, not {times}"

    def assert_nothing_synced(self) -> None:
        assert not self.synced, f"synced: {self.synced}"

    def _embeds(self, entity_type: str, entity_id: Any) -> bool:
        return any(t == entity_type and entity_id in (None, i) for t, i in self.embedded)

    def assert_embedded(self, entity_type: str, entity_id: Any = None) -> None:
        assert self._embeds(entity_type, entity_id), f"{entity_type} {entity_id} was not embedded"

    def assert_not_embedded(self, entity_type: str, entity_id: Any = None) -> None:
        assert not self._embeds(entity_type, entity_id), f"{entity_type} {entity_id} was embedded"

    def assert_forgotten(self, entity_type: str, entity_id: Any = None) -> None:
        assert any(t == entity_type and entity_id in (None, i) for t, i in self.forgotten), f"{entity_type} {entity_id} was not forgotten"

    def assert_searched(self, entity_type: str, query: str | Callable[[str, int, float | None], bool] | None = None) -> None:
        """query: the exact one, or a function of (query, limit, min_similarity)."""
        hit = (lambda *x: query(*x)) if callable(query) else (lambda q, *_: query is None or q == query)
        assert any(t == entity_type and hit(*rest) for t, *rest in self.searched), f"{entity_type} was not searched"

    def assert_nothing_searched(self) -> None:
        assert not self.searched, f"searched: {self.searched}"

    def assert_invalidated(self, dependency_type: str, dependency_id: Any = None) -> None:
        assert any(t == dependency_type and dependency_id in (None, i) for t, i in self.invalidated), f"{dependency_type} {dependency_id} was not invalidated"
