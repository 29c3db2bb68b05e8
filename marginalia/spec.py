"""What makes up a document: specs, relations between entities, and the catalogue that knows both."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


class InvalidRelationPath(ValueError):
    """A path that doesn't lead from an entity over its relations to a column."""


@dataclass(frozen=True)
class DocumentSpec:
    """Own columns, related columns and paths whose lists keep their order. content replaces, the others append."""

    content: tuple[str, ...] = ()
    relations: tuple[str, ...] = ()
    ordered: tuple[str, ...] = ()

    def with_content(self, *columns: str) -> DocumentSpec:
        return replace(self, content=columns)

    def relation(self, path: str) -> DocumentSpec:
        return replace(self, relations=(*self.relations, path))

    def keep_order(self, *paths: str) -> DocumentSpec:
        return replace(self, ordered=(*self.ordered, *paths))


@dataclass(frozen=True)
class Relation:
    """An edge to another entity.

    one: ``local`` here equals the target's key. many: ``foreign`` there equals the key here. bridge: rows of
    ``bridge`` pair ``local`` (key here) with ``foreign`` (key there). order_by: columns of the target (many)
    or the bridge that order the list where a spec keeps order.
    """

    kind: str
    target: str
    local: str | None = None
    foreign: str | None = None
    bridge: DataFrame | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        need = {"one": (self.local,), "many": (self.foreign,), "bridge": (self.local, self.foreign, self.bridge)}
        if self.kind not in need or any(x is None for x in need[self.kind]):
            raise ValueError(f"relation of kind {self.kind!r} lacks a column")


@dataclass
class Entity:
    name: str
    rows: DataFrame
    key: str = "id"
    relations: dict[str, Relation] = field(default_factory=dict)
    spec: DocumentSpec = DocumentSpec()


class EntityCatalog:
    def __init__(self) -> None:
        self._entities: dict[str, Entity] = {}

    def register(self, name: str, rows: DataFrame, key: str = "id", relations: dict[str, Relation] | None = None, spec: DocumentSpec | None = None) -> Entity:
        if key not in rows.columns:
            raise ValueError(f"{name} has no column {key}")
        self._entities[name] = Entity(name, rows, key, relations or {}, spec or DocumentSpec())
        return self._entities[name]

    def __contains__(self, name: str) -> bool:
        return name in self._entities

    def __getitem__(self, name: str) -> Entity:
        if name not in self._entities:
            raise KeyError(f"no entity named {name}")
        return self._entities[name]

    def names(self) -> list[str]:
        return sorted(self._entities)

    def validate(self, name: str, path: str) -> list[Relation]:
        """The relations a path leads over; an error if a segment before the last isn't a relation."""
        segments = path.split(".")
        if len(segments) < 2:
            raise InvalidRelationPath(f"{name}: {path!r} names no relation, only a column")
        at, edges = self[name], []
        for segment in segments[:-1]:
            edge = at.relations.get(segment)
            if edge is None and segment in at.rows.columns:
                raise InvalidRelationPath(f"{name}: {segment!r} in {path!r} is a column of {at.name}, not a relation")
            if edge is None:
                raise InvalidRelationPath(f"{name}: {at.name} has no relation {segment!r} (in {path!r})")
            edges.append(edge)
            at = self[edge.target]
        return edges

    def validate_spec(self, name: str, spec: DocumentSpec) -> None:
        for path in spec.relations:
            self.validate(name, path)
