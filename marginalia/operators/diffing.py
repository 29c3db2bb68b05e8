"""Differences between two copies of a table: one shared range partitioning, sorted streams, a two-pointer merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import ship_code

MISSING_IN_COPY, MISSING_IN_MAIN = "missing_in_copy", "missing_in_main"


def differences(main: DataFrame, copy: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """(key, field_name) for each key that one side lacks and each field whose current values differ.

    The current row of a key is the one with the greatest version on its side (null versions are the
    least). Values are compared exactly as strings of their type; null equals null only. Null keys are left
    out. Repeated rows count once. Two empty tables give an empty result.

    Each batch of rows first drops those that a greater version of their key in the same batch supersedes, so a
    key that holds a third of all rows sends a few for each batch. Both sides are then range-partitioned by key
    with the same split points (they go through one exchange) and sorted by key, side and descending version; each
    task streams its stretch once and keeps the current row of each side for one key at a time.
    """
    ship_code(main.sparkSession)

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(
            F.col(key).cast("bigint").alias("k"), F.lit(number).alias("s"), F.coalesce(F.col(version), F.lit(-(2**31))).alias("v"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]
        )

    both = side(main, 0).unionByName(side(copy, 1))
    both = both.mapInArrow(_newest_of_batch, both.schema)
    n = int(main.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merge = _Merge(key, fields)
    return (
        both.repartitionByRange(n, "k")
        .sortWithinPartitions("k", "s", F.desc("v"))
        .mapInArrow(merge, f"`{key}` bigint, field_name string")
    )


def _newest_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            k, s, v = (batch.column(i).to_numpy() for i in range(3))
            order = np.lexsort((-v.astype(np.int64), s, k))
            k, s = k[order], s[order]
            yield batch.take(pa.array(order[np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]]))


class _Merge:
    """Streams batches sorted by (k, s, descending v); vectorised within a batch, one open key carried over."""

    def __init__(self, key: str, fields: list[str]) -> None:
        self.key, self.fields = key, fields

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = self.current(pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch]))
            if not table.num_rows:
                continue
            keys = table["k"].to_numpy()
            open_from = int(np.searchsorted(keys, keys[-1]))
            held = table.slice(open_from).combine_chunks()
            yield from self.compared(table.slice(0, open_from))
        if held is not None:
            yield from self.compared(held)

    def current(self, table: pa.Table) -> pa.Table:
        """The first row of each key and side: that of the greatest version."""
        if table.num_rows < 2:
            return table
        k, s = table["k"].to_numpy(), table["s"].to_numpy()
        first = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        return table.filter(pa.array(first)).combine_chunks()

    def compared(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        k, s = table["k"].to_numpy(), table["s"].to_numpy()
        paired = np.r_[k[1:] == k[:-1], False]  # a main row followed by its copy
        second = np.r_[False, paired[:-1]]
        alone = ~paired & ~second
        out = [(k[alone & (s == 0)], MISSING_IN_COPY), (k[alone & (s == 1)], MISSING_IN_MAIN)]
        left = np.flatnonzero(paired)
        for i, field in enumerate(self.fields):
            column = table[f"f{i}"]
            a, b = column.take(pa.array(left)), column.take(pa.array(left + 1))
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out.append((k[left][~same.to_numpy(zero_copy_only=False)], field))
        ids = np.concatenate([x for x, _ in out])
        if len(ids):
            names = np.repeat([n for _, n in out], [len(x) for x, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], [self.key, "field_name"])
