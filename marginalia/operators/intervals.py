"""Sets of sequence numbers as disjoint closed intervals, with the algebra on them as plain Spark plans.

An interval table has the key columns given by ``keys`` and bigint ``lo`` and ``hi`` (both inclusive). Long
intervals stay whole: only their ends are looked at by block of the number line, what lies between as a few
aligned nodes of a binary tree over the blocks. Every window is grouped by key and by a block of the number line
(BLOCK numbers, or BLOCK blocks, which are a region), so no task holds more than BLOCK rows of one key however
hot that key is; only one row for each region of 2^32 numbers goes through a window over the whole key.
``subtract`` and ``merge`` leave rows out whose key is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import cut_lineage

#: Width of a block of the number line (as bits and as numbers); the bound on what one window partition can hold.
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
#: Levels of the tree over the blocks of all bigints.
LEVELS = 48


def _block(position: Column) -> Column:
    return F.shiftright(position, BLOCK_BITS)


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The numbers of each key as maximal intervals within blocks; nulls are left out, repeats count once.

    Intervals that touch at a block's edge stay two; ``merge`` joins them where that matters.
    """
    numbers = df.where(F.col(number).isNotNull()).select(*keys, F.col(number).cast("bigint").alias("__n")).distinct()
    w = Window.partitionBy(*keys, "__block").orderBy("__n")
    return (
        numbers.withColumn("__block", _block(F.col("__n")))
        .withColumn("__new", F.coalesce((F.col("__n") - F.lag("__n").over(w) > 1).cast("int"), F.lit(1)))
        .withColumn("__island", F.sum("__new").over(w))
        .groupBy(*keys, "__block", "__island")
        .agg(F.min("__n").alias("lo"), F.max("__n").alias("hi"))
        .select(*keys, "lo", "hi")
    )


def _clipped(intervals: DataFrame, keys: list[str], ends_only: bool = False) -> DataFrame:
    """The intervals cut at block edges; ends_only: no more than the first and the last part of each."""
    first, last = _block(F.col("lo")), _block(F.col("hi"))
    parts = F.array_distinct(F.array(first, last)) if ends_only else F.sequence(first, last)
    return (
        _keyed(intervals, keys)
        .where(F.col("lo") <= F.col("hi"))
        .select(*keys, "lo", "hi", F.explode(parts).alias("__block"))
        .withColumn("lo", F.greatest(F.col("lo"), F.col("__block") * BLOCK))
        .withColumn("hi", F.least(F.col("hi"), F.col("__block") * BLOCK + (BLOCK - 1)))
    )


def _inner_nodes(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __level, __node): the blocks between an interval's first and last as aligned nodes, at most two a level.

    A node of level l stands for 2^l consecutive blocks.
    """
    a, b = _block(F.col("lo")) + 1, _block(F.col("hi")) - 1
    level = lambda l: F.pow(F.lit(2.0), l).cast("bigint")

    def nodes(l: Column) -> Column:  # noqa: E741
        low, high = F.ceil(a / level(l)).cast("bigint"), (F.floor((b + 1) / level(l)) - 1).cast("bigint")
        left = F.when((low <= high) & (F.pmod(low, F.lit(2)) == 1), F.struct(l.alias("__level"), low.alias("__node")))
        right = F.when((low <= high) & (F.pmod(high, F.lit(2)) == 0), F.struct(l.alias("__level"), high.alias("__node")))
        return F.array_compact(F.array_distinct(F.array(left, right)))

    inner = _keyed(intervals, keys).where(a <= b)
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), nodes))
    return inner.select(*keys, F.explode(every).alias("__x")).select(*keys, "__x.__level", "__x.__node").distinct()


def subtract(available: DataFrame, processed: DataFrame, keys: list[str], within_blocks: bool = False) -> DataFrame:
    """available minus processed: the gaps still to be worked on, cut at block edges.

    available: intervals of numbers that are there (cut at block edges here, which for intervals made by ``islands`` they are
    already). processed may hold intervals of any length: work is in proportion to their number, not their length.
    within_blocks: the caller knows that no processed interval leaves its block, so nothing is asked for whole blocks.
    """
    kept = _clipped(available, keys)
    levels = []
    if not within_blocks:
        nodes = cut_lineage(_inner_nodes(processed, keys))
        levels = sorted(r[0] for r in nodes.select("__level").distinct().collect())  # LEVELS + 1 values at most
    if levels:
        above = F.array(*[F.struct(F.lit(l).alias("__level"), F.floor(F.col("__block") / F.lit(2.0**l)).cast("bigint").alias("__node")) for l in levels])  # noqa: E741
        asked = kept.select(*keys, "__block").distinct().select(*keys, "__block", F.explode(above).alias("__x"))
        covered = asked.select(*keys, "__block", "__x.__level", "__x.__node").join(nodes, [*keys, "__level", "__node"], "left_semi")
        kept = kept.join(covered.select(*keys, "__block").distinct(), [*keys, "__block"], "left_anti")

    def events(pieces: DataFrame, k: int, r: int) -> DataFrame:
        # Both ends come from one row, so the intervals are computed once.
        first = F.struct(F.col("lo").alias("at"), F.lit(k).alias("k"), F.lit(r).alias("r"))
        behind = F.struct((F.col("hi") + 1).alias("at"), F.lit(-k).alias("k"), F.lit(-r).alias("r"))
        ends = pieces.select(*keys, "__block", F.explode(F.array(first, behind)).alias("__end"))
        return ends.select(*keys, "__block", F.col("__end.at").alias("__at"), F.col("__end.k").alias("__k"), F.col("__end.r").alias("__r"))

    every = events(kept, 1, 0).unionByName(events(_clipped(processed, keys, ends_only=True), 0, 1))
    w = Window.partitionBy(*keys, "__block").orderBy("__at")
    return (
        every.groupBy(*keys, "__block", "__at")
        .agg(F.sum("__k").alias("__k"), F.sum("__r").alias("__r"))
        .withColumn("__k", F.sum("__k").over(w))
        .withColumn("__r", F.sum("__r").over(w))
        .withColumn("__next", F.lead("__at").over(w))
        .where((F.col("__k") > 0) & (F.col("__r") == 0) & F.col("__next").isNotNull())
        .select(*keys, F.col("__at").alias("lo"), (F.col("__next") - 1).alias("hi"))
    )


def _with_greatest_before(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows (keys, __region, __block, lo, ...) with the greatest value of all rows of the key with a lesser lo; null if there is none."""
    earlier = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "__region", "__block").agg(F.max(value).alias("__m"))
    regions = blocks.groupBy(*keys, "__region").agg(F.max("__m").alias("__m"))
    regions = regions.select(*keys, "__region", F.max("__m").over(earlier(*keys, order="__region")).alias("__r"))
    blocks = blocks.select(*keys, "__region", "__block", F.max("__m").over(earlier(*keys, "__region", order="__block")).alias("__b"))
    carried = blocks.join(regions, [*keys, "__region"]).select(*keys, "__block", F.greatest("__b", "__r").alias("__c"))
    local = rows.withColumn("__l", F.max(value).over(earlier(*keys, "__block", order="lo")))
    return local.join(carried, [*keys, "__block"]).withColumn(name, F.greatest("__l", "__c")).drop("__l", "__c")


def merge(intervals: DataFrame, keys: list[str], more: DataFrame | None = None) -> DataFrame:
    """The union of overlapping, repeated and touching intervals as the fewest disjoint ones.

    An interval begins a new one if it lies beyond the greatest end of all before it; each then goes to the latest
    beginning before it. Both are running maxima, taken within blocks, over blocks and over regions.
    """
    every = intervals.select(*keys, "lo", "hi")
    if more is not None:
        every = every.unionByName(more.select(*keys, "lo", "hi"))
    block = _block(F.col("lo"))
    rows = _keyed(every, keys).where(F.col("lo") <= F.col("hi")).groupBy(*keys, "lo").agg(F.max("hi").alias("hi"))
    rows = cut_lineage(rows).withColumn("__block", block).withColumn("__region", _block(block))
    rows = _with_greatest_before(rows, keys, "hi", "__end")
    rows = rows.withColumn("__start", F.when(F.col("__end").isNull() | (F.col("lo") - 1 > F.col("__end")), F.col("lo")))
    rows = _with_greatest_before(rows, keys, "__start", "__before")
    run = F.coalesce("__start", "__before")
    return rows.groupBy(*keys, run.alias("__run")).agg(F.max("hi").alias("hi")).select(*keys, F.col("__run").alias("lo"), "hi")


def expand(intervals: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """One row for each number of each interval."""
    return intervals.select(*keys, F.explode(F.sequence("lo", "hi")).alias(number))
