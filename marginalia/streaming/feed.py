"""A change feed drives the index: entity events sync or forget, any saved row fans out to its dependents.

Events: entity_type string, entity_id bigint, op string (created, updated, restored, deleted), at timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.index import Index
from marginalia.plans import invalidate
from marginalia.plans.invalidate import passing
from marginalia.runtime import cut_lineage
from marginalia.sources.tables import micros

SAVED = ("created", "updated", "restored")


#: Throttle times are kept so long after the newest event seen; older ones can't matter to events in time.
RETAINED_MICROS = 86_400_000_000
_STATE = "dependency_type string, dependency_id {id}, until bigint"


def _held(index: Index) -> DataFrame:
    """(dependency_type, dependency_id, until): what earlier batches of events left of the throttle."""
    return index.store.read(index.spark, "throttle") if index.store.has("throttle") else index.spark.createDataFrame([], _STATE.format(id=index.config.id_type))


def _hold(index: Index, passed: DataFrame, ttl: int) -> None:
    """Remember until when events of the keys that just passed are dropped; keys that were quiet for long are let go."""
    now = passed.select("dependency_type", "dependency_id", (F.col("at") + ttl).alias("until"))

    def attempt() -> None:
        base = index.store.version
        every = _held(index).unionByName(now).groupBy("dependency_type", "dependency_id").agg(F.max("until").alias("until"))
        newest = now.agg(F.max("until")).first()[0]
        index.store.commit({"throttle": every.where(F.col("until") > newest - RETAINED_MICROS)}, expected=base)

    index._retried(attempt)


def process(index: Index, events: DataFrame) -> None:
    """One batch of events. Keys only: the rows are read as they are now, so late and repeated events converge.

    Deletions forget, saves sync, both once for each key by its last event; then saved rows others depend on are
    throttled, going on from what earlier batches let pass, and their dependents are synced. The throttle's times are
    published after that: a batch that dies before it is played again as a whole, and syncing twice changes nothing.
    """
    events = events.where(F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull()).withColumn("entity_id", F.col("entity_id").cast(index.config.id_type))
    last = cut_lineage(events.groupBy("entity_type", "entity_id").agg(F.max(F.struct("at", "op")).alias("e")).select("entity_type", "entity_id", "e.op"))
    for t in [r[0] for r in last.select("entity_type").distinct().collect()]:
        own = last.where(F.col("entity_type") == t)
        if t in index.catalog and index.catalog[t].spec.content:
            saved = own.where(F.col("op").isin(*SAVED)).select("entity_id")
            if not saved.isEmpty():
                index.sync(t, saved)
            index.forget(t, own.where(F.col("op") == "deleted").select("entity_id"))
    changes = events.where(F.col("op").isin(*SAVED)).select(F.col("entity_type").alias("dependency_type"), F.col("entity_id").alias("dependency_id"), micros(F.col("at")).alias("at"))
    dependencies = index.table("dependencies")
    ttl = index.config.debounce_seconds * 1_000_000
    passed = cut_lineage(invalidate.throttle(invalidate.with_dependents(changes, dependencies), ["dependency_type", "dependency_id"], "at", ttl, _held(index)))
    if not passed.isEmpty():
        index.sync_pairs(invalidate.affected(passed, dependencies))
        _hold(index, passed, ttl)


def follow(index: Index, events: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``process`` on each micro-batch; a batch that is played again changes nothing, since syncing is idempotent."""
    writer = events.writeStream.foreachBatch(lambda batch, _: process(index, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def throttled(events: DataFrame, keys: list[str], at: str, ttl_micros: int, watermark: str = "1 day") -> DataFrame:
    """The leading-edge throttle over a stream: state is one time a key, let go once the watermark passes it.

    at: an event-time column; a key's events of one micro-batch are taken in their order, events older than the
    last accepted one of an earlier batch are dropped. Null keys and times are left out; events of equal time pass once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # Only the times of a key's events are kept, eight bytes each; what passes is made from them.
        times = np.unique(np.concatenate([f["__at"].to_numpy() for f in frames]))
        places, until = passing(times, state.get[0] if state.exists else None, ttl_micros)
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({**dict(zip(keys, ([k] * len(places) for k in key), strict=True)), at: pd.to_datetime(times[places], unit="us")})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, at])
    return (
        events.withWatermark(at, watermark)
        .select(*keys, at, micros(F.col(at)).alias("__at"))
        .where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, at]))
        .groupBy(*keys)
        .applyInPandasWithState(run, schema, "until bigint", "append", GroupStateTimeout.EventTimeTimeout)
    )
