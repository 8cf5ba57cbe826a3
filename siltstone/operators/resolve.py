"""Version resolution: the latest operation of each key, and lookups against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, *by: str) -> DataFrame:
    """The last operation of each key (and of each value of by).

    A ranked window with a limit of one row: Spark keeps one row for each key of a task before the shuffle, so a hot key
    costs one row for each task.
    """
    w = Window.partitionBy(*by, "key").orderBy(F.desc("ord"))
    return log.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def snapshot(log: DataFrame) -> DataFrame:
    """Keys whose last operation is no delete."""
    return latest_per_key(log).filter(~F.col("tombstone"))


def get(log: DataFrame, key: str) -> DataFrame:
    """The live record of one key. Where the log has the key as it is stored (typed_key), the equality reaches the scan."""
    mine = log.filter(F.col("key") == key)
    if "typed_key" in log.columns:
        stored = F.lit(key).try_cast(log.schema["typed_key"].dataType)
        mine = mine.filter(F.col("typed_key") == stored)
    return snapshot(mine)


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """A row for each probe (key), with found and the live record's columns."""
    wanted = probes.select("key").distinct()
    live = snapshot(log.join(wanted, "key", "left_semi"))
    return probes.join(live.withColumn("found", F.lit(True)), "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def history_counts(log: DataFrame) -> DataFrame:
    puts = F.sum(F.when(F.col("tombstone"), 0).otherwise(1))
    return log.groupBy("key").agg(puts.alias("puts"), (F.count("*") - puts).alias("deletes"), F.count("*").alias("versions"))


def delete_outcomes(log: DataFrame) -> DataFrame:
    """Each delete with found: whether the key was live just before it."""
    w = Window.partitionBy("key").orderBy("ord")
    before = F.lag("tombstone").over(w)
    return log.withColumn("found", F.coalesce(~before, F.lit(False))).filter("tombstone")
