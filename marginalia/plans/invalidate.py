"""From changed related rows to batches of documents to be made anew."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import broadcast_if_small, cut_lineage

_CHANGE = ["dependency_type", "dependency_id"]


def parse_reference(text: str) -> tuple[str, str]:
    """Type:id split at the first colon; an error without a type or an id."""
    kind, colon, key = text.partition(":")
    if not colon or not kind or not key:
        raise ValueError(f"{text!r} isn't of the form Type:id")
    return kind, key


def with_dependents(changes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The changes that any document depends on; looked up before anything is throttled."""
    return changes.join(dependencies.select(*_CHANGE).distinct(), _CHANGE, "left_semi")


def affected(changes: DataFrame, dependencies: DataFrame, keys: tuple[str, ...] = ("entity_type", "entity_id")) -> DataFrame:
    """(entity_type, entity_id), each once: documents that depend on a changed row. Null keys match nothing.

    A reverse lookup: few changes are broadcast to the dependencies (checked by count), many are shuffled.
    """
    few = broadcast_if_small(changes.select(*_CHANGE))
    return dependencies.join(few, _CHANGE, "left_semi").select(*keys).distinct()


def batches(work: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """work with batch_no: rows in that order, ``size`` a batch, from 0.

    Numbered over a range-sorted copy by an offset for each partition, so no task sees all rows; only one number for each
    partition goes through the driver. Work is computed once, kept until the copy is written. order must be unique for
    a defined result.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    n = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.persist(StorageLevel.MEMORY_AND_DISK)  # sampled for the ranges, then sorted
    ordered = cut_lineage(work.repartitionByRange(n, *order).sortWithinPartitions(*order))
    work.unpersist()
    numbered = ordered.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    counts = {r["__p"]: r["n"] for r in numbered.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, at = {}, 0
    for p in sorted(counts):
        offset[p] = at
        at += counts[p]
    offsets = F.broadcast(work.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "__p bigint, __o bigint"))
    place = F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1)
    return numbered.join(offsets, "__p").select(*work.columns, F.floor(place / size).cast("bigint").alias("batch_no"))


def passing(times: np.ndarray, until: int | None, ttl: int) -> tuple[np.ndarray, int | None]:
    """(places of the ascending times that pass, the time until which later ones are dropped): one jump for each that passes."""
    places, at = [], 0 if until is None else int(np.searchsorted(times, until))
    while at < len(times):
        places.append(at)
        until = int(times[at]) + ttl
        at = int(np.searchsorted(times, until))
    return np.array(places, np.int64), until


#: Width of a block of time in ttls; at most so many events of a key pass in a block.
BLOCK_TTLS = 1024


#: Before any time: nothing is dropped.
NEVER = -(1 << 63)


def _groups(frames: Iterator[pd.DataFrame], by: list[str], values: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """(key, arrays of values) of each run of equal keys in sorted frames; one run is held at a time."""
    key, held = None, None
    for frame in frames:
        if frame.empty:
            continue
        columns, own = [frame[c].to_numpy() for c in by], [frame[c].to_numpy() for c in values]
        new = np.zeros(len(frame), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            at, part = tuple(c[a] for c in columns), [v[a:b] for v in own]
            if held is not None and at == key:
                held = [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)]
                continue
            if held is not None:
                yield key, held
            key, held = at, part
    if held is not None:
        yield key, held


def _frames(rows: Iterator[tuple[tuple, list[np.ndarray]]], by: list[str], values: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    """(key, arrays of values) as frames of some rows."""
    keys, parts, n = [], [], 0

    def frame() -> pd.DataFrame:
        times = [len(p[0]) for p in parts]
        made = {c: np.repeat(np.array([k[i] for k in keys]), times) for i, c in enumerate(by)}
        return pd.DataFrame({**made, **{c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(values)}})

    for key, part in rows:
        keys.append(key)
        parts.append(part)
        n += len(part[0])
        if n >= size:
            yield frame()
            keys, parts, n = [], [], 0
    if keys:
        yield frame()


def leaving(times: np.ndarray, start: int, ttl: int, ttls: int = BLOCK_TTLS) -> tuple[np.ndarray, np.ndarray]:
    """(hi, until): if the first event of a block to pass is one up to hi, later ones are dropped until ``until`` when the block is left.

    Only events within a ttl of the block's start, and the next one, can be the first to pass. The later the first, the
    later the last: so both ascend, and equal ends are one row.
    """
    after = np.searchsorted(times, times + ttl)
    last = np.where(after < len(times), after, np.arange(len(times)))
    for _ in range(ttls.bit_length()):  # jumps of jumps: after these the last event that passes is reached
        last = last[last]
    first = min(len(times), int(np.searchsorted(times, start + ttl)) + 1)
    until = times[last[:first]] + ttl
    edge = np.flatnonzero(np.r_[until[1:] != until[:-1], True])
    return times[edge], until[edge]


class _Leaving:
    """(keys, __b, at) sorted -> (keys, __b, hi, until) of each block."""

    def __init__(self, keys: list[str], ttl: int, ttls: int) -> None:
        self.by, self.ttl, self.ttls = [*keys, "__b"], ttl, ttls

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = self.ttl * self.ttls
        rows = ((key, list(leaving(times, int(key[-1]) * width, self.ttl, self.ttls))) for key, (times,) in _groups(frames, self.by, ["at"]))
        yield from _frames(rows, self.by, ["hi", "until"])


class _Entering:
    """(keys, __b, hi, until) sorted -> (keys, __b, until): until when a block's events are dropped as it is entered."""

    def __init__(self, keys: list[str]) -> None:
        self.by = [*keys, "__b"]

    def chained(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
        open_key, until = None, NEVER
        for key, (hi, ends) in _groups(frames, self.by, ["hi", "until"]):
            if key[:-1] != open_key:
                open_key, until = key[:-1], NEVER
            yield key, [np.array([until])]
            at = int(np.searchsorted(hi, until))
            if at < len(hi):  # else nothing passes in this block
                until = int(ends[at])

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(self.chained(frames), self.by, ["until"])


class _Passing:
    """(keys, __b, at, until) sorted -> the (keys, at) that pass."""

    def __init__(self, keys: list[str], ttl: int) -> None:
        self.keys, self.by, self.ttl = keys, [*keys, "__b"], ttl

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((key[:-1], [times[passing(times, int(until[0]), self.ttl)[0]]]) for key, (times, until) in _groups(frames, self.by, ["at", "until"]))
        yield from _frames(rows, self.keys, ["at"])


def throttle(events: DataFrame, keys: list[str], at: str, ttl_micros: int, dropped_until: DataFrame | None = None) -> DataFrame:
    """(keys, at) of the events that pass a leading-edge throttle of each key.

    dropped_until (keys, until): what an earlier call left; events of a key before its time are dropped.
    The first event passes; those before its time plus the ttl are dropped; the next one begins anew. at: a
    bigint in microseconds. Null keys or times are left out; repeated events pass once.

    That is sequential for a key, but what happens in a block of BLOCK_TTLS ttls depends on the past by one number only, and
    only the events of its first ttl can be the first to pass. So for each block the end is worked out for each
    possible beginning, which are few rows; these are chained along the key; and then the blocks' events are
    passed or dropped. A hot key's events are spread over its blocks; a task holds the times of one block.
    """
    present = F.col(at).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    rows = events.where(present).select(*keys, F.col(at).cast("bigint").alias("at")).distinct()
    if dropped_until is not None:
        held = dropped_until.groupBy(*keys).agg(F.max("until").alias("__until"))
        rows = rows.join(held, keys, "left").where(F.col("__until").isNull() | (F.col("at") >= F.col("__until"))).drop("__until")
    block = [*keys, "__b"]
    rows = rows.withColumn("__b", F.expr(f"CAST((at - pmod(at, {ttl_micros * BLOCK_TTLS}L)) div {ttl_micros * BLOCK_TTLS}L AS BIGINT)"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = lambda *columns: ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in columns)
    parted = rows.repartition(*block).sortWithinPartitions(*block, "at")
    ends = parted.mapInPandas(_Leaving(keys, ttl_micros, BLOCK_TTLS), schema(*block, "hi", "until"))
    entered = ends.repartition(*keys).sortWithinPartitions(*block, "hi").mapInPandas(_Entering(keys), schema(*block, "until"))
    met = rows.join(entered, block).repartition(*block).sortWithinPartitions(*block, "at")
    return met.mapInPandas(_Passing(keys, ttl_micros), schema(*keys, "at"))


def fan_out(changes: DataFrame, dependencies: DataFrame, size: int = 500, keys: tuple[str, ...] = ("entity_type", "entity_id")) -> DataFrame:
    """(keys, batch_no): the documents affected by the changes, in batches. No change or no dependent: no row."""
    return batches(affected(changes, dependencies, keys), list(keys), size)
