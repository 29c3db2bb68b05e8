"""Exact per-key counts and quantiles where a handful of keys hold most rows.

Distributed selection: per key a histogram of the values is refined around each wanted rank until one
value is left. Histograms are counts, merged by partial aggregation before any shuffle, so a hot key costs
at most BINS numbers for each input partition and round; its values are never gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import BROADCAST_ROWS, cut_lineage

#: Bins of one refinement.
BINS = 1024
#: A key with more than 1/HOT_SHARE of the rows is hot: there are at most HOT_SHARE of them, so their state may be broadcast.
HOT_SHARE = 1000


def key_counts(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows of each key over distinct row ids: (keys, n).

    Rows where a key or the id is null are left out; redelivered rows (equal id) count once.
    """
    return _distinct(df, keys, row_id).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _distinct(df: DataFrame, keys: list[str], row_id: str, *values: str) -> DataFrame:
    present = F.lit(True)
    for c in [*keys, row_id]:
        present = present & F.col(c).isNotNull()
    return df.where(present).select(*keys, row_id, *values).dropDuplicates([row_id, *keys]).drop(row_id)


def _quantile_ranks(p: float, n: Column) -> Column:
    return F.greatest(F.ceil(F.lit(p) * n), F.lit(1)).cast("bigint")


def per_key_quantiles(df: DataFrame, keys: list[str], row_id: str, value: str, quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, n, n_values, q0, q1, ...): count, count of non-null values and exact discrete quantiles of each key.

    value: a bigint column; null values count in n only. The quantile p of m values is the one at place
    max(ceil(p * m), 1) of the ascending order; null if m is 0. Distinct rows are decided by row_id as in
    ``key_counts``; nulls in keys or id leave a row out; an empty table gives an empty result.

    Plan: one shuffle on row_id (uniform), one written copy, then the selection. Hot keys' rows never move.
    """
    names = {f"q{i}": p for i, p in enumerate(quantiles)}
    given, keys = keys, [f"__key{i}" for i in range(len(keys))]  # own names, whatever the columns are called
    df = df.select(*[F.col(c).alias(k) for c, k in zip(given, keys, strict=True)], F.col(row_id).alias("__id"), F.col(value).cast("bigint").alias("__v"))
    base = cut_lineage(_distinct(df, keys, "__id", "__v"))
    totals = cut_lineage(
        base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("__v").alias("n_values"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    )
    limit = (totals.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), _quantile_ranks(p, F.col("n_values")).alias("rank")) for q, p in names.items()])
    state = (
        totals.where("n_values > 0")
        .select(*keys, (F.col("n") > F.lit(limit)).alias("__hot"), F.col("__min").alias("lo"), F.col("__max").alias("hi"), F.explode(wanted).alias("w"))
        .select(*keys, "__hot", "lo", "hi", "w.q", "w.rank")
    )
    solved = _select(base.where(F.col("__v").isNotNull()), state, keys)
    pivoted = solved.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(q) for q in names])
    out = totals.select(*keys, "n", "n_values").join(pivoted, keys, "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(given, keys, strict=True)], "n", "n_values", *names)


def _select(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q, value) of each state (keys, __hot, lo, hi, q, rank): the value at that rank among those of the key in [lo, hi].

    Each round takes one pass over ``values`` (keys, __v). Their number is logarithmic in the range of the values and
    independent of the row count. State is cut after each round: it is small, and rounds must not repeat rounds.
    """
    solved = None
    while True:
        state = cut_lineage(state)
        done = state.where("lo = hi").select(*keys, "q", F.col("lo").alias("value"))
        solved = done if solved is None else solved.unionByName(done)
        state = state.where("lo < hi")
        hot, cold = state.agg(F.count_if("__hot"), F.count_if(~F.col("__hot"))).first()
        if not hot + cold:
            return solved
        state = _refined(values, state, keys, hot, cold)


def _refined(values: DataFrame, state: DataFrame, keys: list[str], hot: int, cold: int) -> DataFrame:
    """The states after one more histogram: lo, hi and rank within what is left.

    Ranks of a key that lie in the same range share its histogram. Hot keys' ranges (of at most HOT_SHARE keys) are
    broadcast; other keys' rows meet theirs in a shuffle join, or in a broadcast one as soon as a count proves that few are left.
    """
    ranges = state.select(*keys, "__hot", F.col("lo").alias("__lo"), F.col("hi").alias("__hi")).distinct()
    within = F.col("__v").between(F.col("__lo"), F.col("__hi"))

    def histogram(rows: DataFrame) -> DataFrame:
        # Doubles lose low bits of a wide range, and its width may exceed a bigint: bins are found by division of decimals' whole parts.
        wide = "CAST({} AS DECIMAL(20,0))"
        binned = rows.where(within).select(
            *keys, "__lo", "__hi", "__v", F.expr(f"CAST(({wide.format('__v')} - {wide.format('__lo')}) div (({wide.format('__hi')} - {wide.format('__lo')}) div {BINS} + 1) AS INT)").alias("bin")
        )
        return binned.groupBy(*keys, "__lo", "__hi", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("a"), F.max("__v").alias("b"))

    made = []
    if hot:
        made.append(histogram(values.join(F.broadcast(ranges.where("__hot")), keys)))
    if cold:
        rest = values.join(F.broadcast(ranges.where("__hot").select(*keys).distinct()), keys, "left_anti") if hot else values
        few = ranges.where("NOT __hot")
        made.append(histogram(rest.join(F.broadcast(few) if cold <= BROADCAST_ROWS else few, keys)))
    w = Window.partitionBy(*keys, "__lo", "__hi").orderBy("bin")
    bins = reduce(DataFrame.unionByName, made).withColumn("upto", F.sum("c").over(w))
    own = state.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__hot", "lo", "hi", "q", "rank")
    hit = (F.col("__lo") == F.col("lo")) & (F.col("__hi") == F.col("hi")) & (F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto"))
    for k in keys:
        hit = hit & (F.col(k) == F.col(f"__of_{k}"))
    return bins.join(own, hit).select(*keys, "__hot", F.col("a").alias("lo"), F.col("b").alias("hi"), "q", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"))


def heavy_keys(df: DataFrame, keys: list[str], row_id: str, value: str | None = None, share: float = 0.01) -> DataFrame:
    """The keys with at least that share of all counted rows: (keys, n), with value also (n_values, q0), its count and median.

    Found by selection: in any order of the rows by key, a key with at least m = ceil(share * rows) of them stands at one of the
    ranks m, 2m, 3m, ... So the keys at those at most 1 / share ranks are selected, over the hash of the key as the value, by
    the same refined histograms as quantiles are; only their rows are counted by key. Keys of equal hash are told apart there.
    Rows are decided by row_id as in ``key_counts``. An empty table gives an empty result.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    given, own = keys, [f"__key{i}" for i in range(len(keys))]
    columns = [F.col(c).alias(k) for c, k in zip(given, own, strict=True)]
    named = df.select(*columns, F.col(row_id).alias("__id"), *([F.col(value).cast("bigint").alias("__value")] if value else []))
    base = cut_lineage(_distinct(named, own, "__id", *(["__value"] if value else [])).withColumn("__v", F.xxhash64(*own)).withColumn("__all", F.lit(True)))
    total, low, high = base.agg(F.count(F.lit(1)), F.min("__v"), F.max("__v")).first()
    least = max(1, math.ceil(math.nextafter(share, 0.0) * total))  # a key exactly at the share counts, whatever the rounding of the product
    ranks = [(True, True, low, high, f"r{i}", rank) for i, rank in enumerate(range(least, total + 1, least))]
    state = df.sparkSession.createDataFrame(ranks, "__all boolean, __hot boolean, lo bigint, hi bigint, q string, rank bigint")
    candidates = F.broadcast(_select(base, state, ["__all"]).select(F.col("value").alias("__v")).distinct())  # at most 1 / share rows
    rows = base.join(candidates, "__v", "left_semi")
    heavy = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    if value:
        heavy = cut_lineage(heavy)
        few = rows.join(F.broadcast(heavy), own, "left_semi").withColumn("__row", F.monotonically_increasing_id())
        heavy = per_key_quantiles(few, own, "__row", "__value")
    return heavy.select(*[F.col(k).alias(c) for c, k in zip(given, own, strict=True)], "n", *(["n_values", "q0"] if value else []))
