"""Rendering of entities into documents, and the related rows each depends on.

A path is resolved from its end: the last entity's column becomes (key, text), each relation before it
lifts that to the entity before. To-one relations are left joins (small targets broadcast by Spark's own
size estimate), to-many ones are grouped lists; all lists of one entity are grouped by its key, so the
joins that put them together reuse that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.canon import ITEM_SEPARATOR, canon
from marginalia.functions.hashing import content_hash
from marginalia.spec import DocumentSpec, Entity, EntityCatalog, Relation

Keys = DataFrame | Sequence | None


def only(df: DataFrame, column: str, keys: Keys) -> DataFrame:
    """The rows of df whose column is one of the keys: a list (few; a filter that reaches the scan) or a table with entity_id."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col("entity_id").alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(keys)))


def _leaf(entity: Entity, column: str, ordered: bool, strict: bool) -> DataFrame:
    """(k, v) of a column; a column that doesn't exist is null everywhere, or an error if strict."""
    if column not in entity.rows.columns:
        if strict:
            raise ValueError(f"{entity.name} has no column {column}")
        return entity.rows.select(F.col(entity.key).alias("k"), F.lit(None).cast("string").alias("v"))
    value = F.col(column)
    return entity.rows.select(F.col(entity.key).alias("k"), F.when(value.isNotNull(), canon(value, entity.rows.schema[column].dataType, ordered)).alias("v"))


def _pairs(catalog: EntityCatalog, entity: Entity, edge: Relation) -> DataFrame:
    """(k, t, o): key here, key there, order columns as a struct, of each related pair."""
    target = catalog[edge.target]
    if edge.kind == "one":
        return entity.rows.select(F.col(entity.key).alias("k"), F.col(edge.local).alias("t"), F.struct(F.lit(0)).alias("o"))
    rows, k, t = (target.rows, edge.foreign, target.key) if edge.kind == "many" else (edge.bridge, edge.local, edge.foreign)
    order = F.struct(*[F.col(c) for c in edge.order_by], F.col(t).alias("__t")) if edge.order_by else F.struct(F.col(t).alias("__t"))
    return rows.where(F.col(k).isNotNull() & F.col(t).isNotNull()).select(F.col(k).alias("k"), F.col(t).alias("t"), order.alias("o"))


def resolve(catalog: EntityCatalog, name: str, path: str, ordered: bool = False, strict: bool = False, keys: Keys = None) -> DataFrame:
    """(k, v): the canonical text at a path for each key, or those of ``keys``; null where anything on the way is null."""
    first, _, rest = path.partition(".")
    entity = catalog[name]
    if not rest:
        return _leaf(entity, first, ordered, strict)
    edge = entity.relations[first]
    # The order of the outermost list is the one that can be kept; lists within it are always sorted.
    inner = resolve(catalog, edge.target, rest, ordered and edge.kind == "one", strict)
    pairs = only(_pairs(catalog, entity, edge), "k", keys)
    if edge.kind == "one":
        return pairs.join(inner.withColumnRenamed("k", "t"), "t", "left").select("k", "v")
    items = pairs.join(inner.withColumnRenamed("k", "t"), "t").select("k", "o", F.coalesce("v", F.lit("")).alias("v"))
    if ordered:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"])
    else:
        listed = F.array_sort(F.collect_list("v"))
    return items.groupBy("k").agg(F.array_join(listed, ITEM_SEPARATOR).alias("v"))


def render(catalog: EntityCatalog, name: str, spec: DocumentSpec | None = None, strict: bool = False, keys: Keys = None) -> DataFrame:
    """(entity_id, text): the document of each entity row, a line ``path: text`` for each path, content first.

    keys: (entity_id) or a list, to render only those. Rows with a null key have no document. An invalid relation path
    raises; a column that doesn't exist is empty unless strict.
    """
    entity = catalog[name]
    spec = spec or entity.spec
    catalog.validate_spec(name, spec)
    rows = only(entity.rows.where(F.col(entity.key).isNotNull()), entity.key, keys)
    own = {f.name: f.dataType for f in entity.rows.schema}
    out, lines = rows, []
    joined: list[tuple[str, DataFrame, str]] = []
    for i, path in enumerate([*spec.content, *spec.relations]):
        ordered = path in spec.ordered
        if path in own:
            text = canon(F.col(f"`{path}`"), own[path], ordered)
        elif "." in path and path.partition(".")[0] in entity.relations:
            edge = entity.relations[path.partition(".")[0]]
            if edge.kind == "one":
                inner = resolve(catalog, edge.target, path.partition(".")[2], ordered, strict)
                joined.append((edge.local, inner, f"__v{i}"))
            else:
                joined.append((entity.key, resolve(catalog, name, path, ordered, strict, keys), f"__v{i}"))
            text = F.coalesce(F.col(f"__v{i}"), F.lit(""))
        elif strict:
            raise ValueError(f"{name} has no column {path}")
        else:
            text = F.lit("")
        lines.append(F.concat(F.lit(f"{path}: "), text))
    wanted = {c for c in own if c in spec.content} | {entity.key} | {local for local, _, _ in joined}
    out = out.select(*[F.col(f"`{c}`") for c in own if c in wanted])
    for local, values, column in joined:
        out = out.join(values.select(F.col("k").alias(f"__k{column}"), F.col("v").alias(column)), F.col(local) == F.col(f"__k{column}"), "left").drop(f"__k{column}")
    return out.select(F.col(entity.key).alias("entity_id"), (F.concat_ws("\n", *lines) if lines else F.lit("")).alias("text"))


def render_hashed(catalog: EntityCatalog, name: str, configuration: str, spec: DocumentSpec | None = None, keys: Keys = None) -> DataFrame:
    """(entity_id, text, content_hash, configuration_hash) of each entity row."""
    return render(catalog, name, spec, keys=keys).select("entity_id", "text", content_hash(F.col("text")).alias("content_hash"), F.lit(configuration).alias("configuration_hash"))


def dependencies(catalog: EntityCatalog, name: str, spec: DocumentSpec | None = None, keys: Keys = None, track_intermediate: bool = False, id_type: str = "bigint") -> DataFrame:
    """(entity_id, dependency_type, dependency_id), each once: the last related row of every relation path.

    track_intermediate: the rows on the way too. Related keys without a row are no dependency.
    """
    entity = catalog[name]
    spec = spec or entity.spec
    found: list[DataFrame] = []
    for path in dict.fromkeys(spec.relations):
        edges = catalog.validate(name, path)
        at, reached = name, None
        for i, edge in enumerate(edges):
            step = _pairs(catalog, catalog[at], edge).select("k", "t")
            if i == 0:
                step = only(step, "k", keys)
            if i == 0 and edge.kind != "one":  # pairs may name rows that aren't there
                step = step.join(entity.rows.select(F.col(entity.key).alias("k")), "k", "left_semi")
            reached = step if reached is None else reached.withColumnRenamed("t", "m").join(step.withColumnRenamed("k", "m"), "m").select("k", "t")
            at = edge.target
            if track_intermediate or i == len(edges) - 1:
                there = catalog[at].rows.select(F.col(catalog[at].key).alias("t"))
                found.append(reached.join(there, "t", "left_semi").select(F.col("k").alias("entity_id"), F.lit(at).alias("dependency_type"), F.col("t").cast(id_type).alias("dependency_id")))
    if not found:
        return entity.rows.select(F.col(entity.key).alias("entity_id"), F.lit("").alias("dependency_type"), F.lit(0).cast(id_type).alias("dependency_id")).limit(0)
    every = reduce(DataFrame.unionByName, found)
    return every.where(F.col("entity_id").isNotNull()).distinct()
