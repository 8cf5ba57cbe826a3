"""Merging runs level by level; the latest version of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .resolve import latest_per_key


def merge_pair(older: DataFrame, newer: DataFrame, drop_deleted: bool = False) -> DataFrame:
    """The union of two runs (key, value, ts, tombstone); equal keys: the larger ts, ties to the newer run.

    drop_deleted: a winning tombstone that removes a version of the other run goes with it. Only right where no older
    run can hold the key.
    """
    both = older.withColumn("_age", F.lit(0)).unionByName(newer.withColumn("_age", F.lit(1)))
    by = Window.partitionBy("key")
    rows = both.withColumns({"_n": F.count("*").over(by), "_rank": F.row_number().over(by.orderBy(F.desc("ts"), F.desc("_age")))}).filter("_rank = 1")
    return (rows.filter("not (_n = 2 and tombstone)") if drop_deleted else rows).drop("_n", "_rank", "_age")


def merge_step(runs: DataFrame, level: int, bottom: bool) -> DataFrame:
    """Merge runs 2i and 2i + 1 of the level into run i of the next; a last run without a partner stays.

    One shuffle for all pairs. At the bottom, deletes end in the oldest run, below which no version is left.
    """
    here = runs.filter(F.col("level") == level)
    rest = runs.filter(F.col("level") != level)
    last = here.agg(F.max("sstable").alias("_last"))
    here = here.crossJoin(F.broadcast(last))  # one row
    alone = here.filter("sstable = _last and sstable % 2 = 0").drop("_last")
    pairs = here.filter("not (sstable = _last and sstable % 2 = 0)").drop("_last").withColumn("sstable", F.expr("sstable div 2"))
    merged = latest_per_key(pairs, "sstable").withColumn("level", F.lit(level + 1))
    if bottom:
        merged = merged.filter("not (tombstone and sstable = 0)")
    return rest.unionByName(alone).unionByName(merged)


def compact(runs: DataFrame, max_levels: int) -> DataFrame:
    """All levels in turn. runs: level, sstable (dense from 0 in each level, older first), key, ord and the rest.

    A level takes the merged runs when it is empty, as in a first compaction. Each level is written once, as a store's is;
    the next one reads it from there.
    """
    runs = written(runs, "level-1")
    for level in range(1, max_levels):
        runs = written(merge_step(runs, level, bottom=level + 1 == max_levels), f"level-{level + 1}")
    return runs
