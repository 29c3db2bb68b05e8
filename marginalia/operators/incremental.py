"""Processing of only the new or changed records, by intervals of processed sequence numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import intervals as iv
from marginalia.runtime import broadcast_if_small, cut_lineage
from marginalia.sources.store import CommitConflict, SnapshotStore


def record_states(current: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """(table_name, record_id, processed): whether each current record is as its last successful run left it.

    current: table_name, record_id, version, content_hash, configuration_hash, compare_configuration (boolean).
    ledger: table_name, record_id, run_id, content_hash, configuration_hash. runs: run_id, run_state.

    Of repeated current rows that of the greatest version counts; of ledger rows that of the greatest
    run_id among succeeded runs. Hashes are compared exactly and null equals null only. Null ids and
    names are left out; records only the ledger knows are no record. One shuffle for both inputs, with
    partial aggregation, so neither a hot record nor repeated rows gather in one task.
    """
    succeeded = runs.where(F.col("run_state") == "succeeded").select("run_id").distinct()
    done = ledger.join(broadcast_if_small(succeeded), "run_id", "left_semi")
    rows = current.select(
        "table_name", "record_id", F.col("version").cast("int").alias("at"), "content_hash", "configuration_hash", "compare_configuration"
    ).unionByName(
        done.select("table_name", "record_id", F.col("run_id").cast("int").alias("at"), "content_hash", "configuration_hash", F.lit(None).cast("boolean").alias("compare_configuration"))
    )
    entry = F.struct("at", "content_hash", "configuration_hash")
    is_current = F.col("compare_configuration").isNotNull()
    both = (
        rows.where(F.col("record_id").isNotNull() & F.col("table_name").isNotNull())
        .groupBy("table_name", "record_id")
        .agg(
            F.max(F.when(is_current, entry)).alias("now"),
            F.max(F.when(~is_current, entry)).alias("then"),
            F.max("compare_configuration").alias("compare_configuration"),
        )
        .where(F.col("now").isNotNull())
    )
    same = (
        F.col("then").isNotNull()
        & F.col("now.content_hash").eqNullSafe(F.col("then.content_hash"))
        & (~F.col("compare_configuration") | F.col("now.configuration_hash").eqNullSafe(F.col("then.configuration_hash")))
    )
    return both.select("table_name", "record_id", same.alias("processed"))


def pending_intervals(states: DataFrame) -> DataFrame:
    """Gaps of record states: the available ranges minus the processed ones."""
    keys = ["table_name"]
    available, processed = iv.islands(states, keys, "record_id"), iv.islands(states.where("processed"), keys, "record_id")
    return iv.subtract(available, processed, keys, within_blocks=True)


def processed_intervals(states: DataFrame) -> DataFrame:
    """The processed ranges of record states, merged."""
    return iv.merge(iv.islands(states.where("processed"), ["table_name"], "record_id"), ["table_name"])


def pending_records(current: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """(table_name, record_id) of every record that is new or changed since the last successful run."""
    states = cut_lineage(record_states(current, ledger, runs))
    return iv.expand(pending_intervals(states), ["table_name"], "record_id")


class IncrementalProcessor:
    """Runs that process each sequence number exactly once, whatever fails, however late numbers commit, whoever else runs.

    Output and merged processed intervals are published by one pointer of the snapshot store: either both
    or neither, and only if nobody else committed since the intervals were read. A run that lost that race has
    published nothing and begins anew with the intervals as they are then. Nothing is a high-water mark, so a number
    that commits after larger ones were processed is a gap and is worked on by the next run. Empty input commits
    nothing. Rows whose number or key is null are left out; of rows with equal number all are processed together.
    """

    def __init__(self, spark: SparkSession, store: SnapshotStore, output: str = "output", keys: tuple[str, ...] = ("table_name",), attempts: int = 5) -> None:
        self.spark, self.store, self.output, self.keys, self.attempts = spark, store, output, list(keys), attempts

    def processed(self, like: DataFrame, version: int | None = None) -> DataFrame:
        if self.store.has("intervals", version):
            return self.store.read(self.spark, "intervals", version)
        return like.select(*self.keys, F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi")).limit(0)

    def pending(self, source: DataFrame, number: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows to process, their intervals), by the intervals of a version."""
        gaps = cut_lineage(iv.subtract(iv.islands(source, self.keys, number), self.processed(source, version), self.keys))
        todo = iv.expand(gaps, self.keys, number)
        return source.join(todo, [*self.keys, number], "left_semi"), gaps

    def run(self, source: DataFrame, number: str, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process what is pending; the count of intervals worked on. An exception leaves the last commit as it is.

        CommitConflict after ``attempts`` lost races.
        """
        for attempt in range(self.attempts):
            base = self.store.version
            rows, gaps = self.pending(source, number, base)
            worked = gaps.count()
            if not worked:
                return 0
            merged = iv.merge(self.processed(source, base), self.keys, gaps)
            try:
                self.store.commit({"intervals": merged}, append={self.output: process(rows)}, expected=base)
                return worked
            except CommitConflict:
                if attempt == self.attempts - 1:
                    raise
        return 0
