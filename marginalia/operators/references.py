"""References to records that do not exist, per table and period, and row by row.

Skew-aware split. References are counted per key and period first (partial aggregation), and only those sums meet
the targets. Keys with more than a fixed share of all references are heavy; there can be at most HOT_SHARE of them,
so they are looked up among the targets by broadcast. The sums of all other keys go through a shuffle join. Both are united.
A sum is decided as a whole unless its period is the one in which the target was created. Rows are looked at only for
the keys that such sums leave open, or, where rows are wanted, for the keys with any orphan: heavy keys by broadcast,
so their rows never move, the others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import cut_lineage

#: A key with more than 1/HOT_SHARE of the references is heavy; so at most HOT_SHARE keys are broadcast.
HOT_SHARE = 1000


def live_targets(targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """(kind, key, born): what exists, one row a key; born is the creation of the oldest copy that no tombstone follows.

    targets: kind, key, created_at. deletions: kind, key, deleted_at. A target is gone if a tombstone of its
    key is at or after its creation; a later re-creation under the same key is there again. A target without
    created_at cannot be told to be later than anything: born is null and only a missing row makes it an orphan.
    """
    last = deletions.where(F.col("deleted_at").isNotNull()).groupBy("kind", "key").agg(F.max("deleted_at").alias("deleted_at"))
    return (
        targets.where(F.col("key").isNotNull())
        .join(last, ["kind", "key"], "left")
        .where(F.col("deleted_at").isNull() | F.col("created_at").isNull() | (F.col("deleted_at") < F.col("created_at")))
        .groupBy("kind", "key")
        .agg(F.min("created_at").alias("born"))
    )


def _judged(present: DataFrame, targets: DataFrame, deletions: DataFrame, group: list[str]) -> DataFrame:
    """(group, kind, key, __month, __n, __heavy, __there, __born): sums of references by key and month with what their target is like.

    The heavy keys are sent to the targets, not the targets to them; what comes back has one row a key.
    """
    sums = cut_lineage(present.groupBy(*group, "kind", "key", "__month").agg(F.count(F.lit(1)).alias("__n")))
    counts = cut_lineage(sums.groupBy("kind", "key").agg(F.sum("__n").alias("__all")))
    total = counts.agg(F.sum("__all")).first()[0] or 0
    heavy = cut_lineage(counts.where(F.col("__all") > F.lit(total / HOT_SHARE)).select("kind", "key"))  # at most HOT_SHARE rows
    live = live_targets(targets, deletions).select("kind", "key", F.col("born").alias("__born"), F.lit(True).alias("__there"))
    there = live.join(F.broadcast(heavy), ["kind", "key"], "left_semi")
    verdicts = heavy.join(F.broadcast(there), ["kind", "key"], "left").withColumn("__heavy", F.lit(True))
    hot = sums.join(F.broadcast(verdicts), ["kind", "key"])
    cold = sums.join(F.broadcast(heavy), ["kind", "key"], "left_anti").join(live, ["kind", "key"], "left").withColumn("__heavy", F.lit(False))
    return hot.unionByName(cold)


def _open_to(judged: DataFrame) -> tuple[Column, Column]:
    """(whether all of a sum's references are orphans, whether its rows must be looked at)."""
    born = month_of(F.col("__born"))
    dated = F.col("__there") & F.col("__born").isNotNull() & (F.col("__month") != "none")
    return F.col("__there").isNull() | F.coalesce(dated & (born > F.col("__month")), F.lit(False)), F.coalesce(dated & (born == F.col("__month")), F.lit(False))


def _looked_at(present: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """present joined with keys (on, __heavy, ...): heavy keys' few rows are broadcast, the others are shuffled.

    keys has at most one row for each value of ``on``, and heavy ones are few by their definition.
    """
    hot, cold = keys.where("__heavy").drop("__heavy"), keys.where("NOT __heavy").drop("__heavy")
    return present.join(F.broadcast(hot), on).unionByName(present.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def _present(references: DataFrame) -> DataFrame:
    return references.where(F.col("kind").isNotNull() & F.col("key").isNotNull()).withColumn("__month", month_of(F.col("created_at")))


def orphans(references: DataFrame, targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """Rows of ``references`` (kind, key, created_at, and any other columns) whose target is missing, deleted or later.

    "Later" compares the target's creation with the referring row's and never holds if either is null. Null
    keys and kinds are left out. Rows that repeat in the input repeat in the result.
    """
    present = _present(references)
    judged = _judged(present, targets, deletions, [])
    whole, rows = _open_to(judged)
    # Keys whose sums are all in order are done with; of the others each row is judged.
    bad = cut_lineage(judged.where(whole | rows).select("kind", "key", "__heavy", "__born", "__there").distinct())
    later = F.coalesce(F.col("__born") > F.col("created_at"), F.lit(False))
    return _looked_at(present, bad, ["kind", "key"]).where(F.col("__there").isNull() | later).select(*references.columns)


def orphan_counts(references: DataFrame, targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_month, orphans): orphan references per table, field and month.

    references as for ``orphans``, with ref_table and ref_field; the month is that of created_at, or none if null.
    """
    group = ["ref_table", "ref_field"]
    present = _present(references).select(*group, "__month", "kind", "key", "created_at")
    judged = cut_lineage(_judged(present, targets, deletions, group))
    whole, rows = _open_to(judged)
    on = [*group, "__month", "kind", "key"]  # a key is left open in one month only: that of its target
    left = judged.where(rows).select(*on, "__heavy", "__born")
    single = _looked_at(present, left, on).where(F.col("created_at") < F.col("__born")).select(*group, "__month", F.lit(1).cast("bigint").alias("__n"))
    every = judged.where(whole).select(*group, "__month", "__n").unionByName(single)
    return every.groupBy(*group, F.col("__month").alias("ref_month")).agg(F.sum("__n").alias("orphans"))


def month_of(created_at: Column) -> Column:
    """YYYY-MM of a timestamp, or none for a null."""
    return F.coalesce(F.date_format(created_at, "yyyy-MM"), F.lit("none"))
