"""Operation logs: put and delete operations in order, as DataFrames.

Columns: ts (whole seconds), ord (a struct that orders the log without ties), key, value, tombstone, op.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def seconds(column: str) -> Column:
    """Whole seconds of a timestamp, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, cast({column} as timestamp_ntz))")


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast({column} as timestamp_ntz))")


def oplog(df: DataFrame, ts: str, tie: str, key: Column, value: Column, tombstone: Column, typed_key: Column | None = None) -> DataFrame:
    """A log from any table with a timestamp, a unique number that breaks ties, and columns for the rest.

    typed_key: the column that key is the text of, kept as typed_key: a filter on it can be pushed into the scan.
    """
    extra = [] if typed_key is None else [typed_key.alias("typed_key")]
    return df.select(
        *extra,
        seconds(ts).alias("ts"),
        F.struct(micros(ts).alias("us"), F.col(tie).alias("tie")).alias("ord"),
        key.alias("key"),
        value.alias("value"),
        tombstone.alias("tombstone"),
        F.when(tombstone, "delete").otherwise("put").alias("op"),
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return oplog(e, "ts", "event_id", F.col("user_id").cast("string"), F.col("props"), F.col("event_type") == "error", F.col("user_id"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return oplog(o, "o_orderdate", "o_orderkey", F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F")


def clean_input(text: Column) -> Column:
    """A typed line without its first line feed and first carriage return."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^([^\n]*)\n", "$1"), r"(?s)^([^\r]*)\r", "$1")


def with_seq(log: DataFrame) -> DataFrame:
    """seq from 1 in log order, without a window over all rows.

    The log is range-sorted once and written with each row's partition and place in it, so that counts and rows are of one
    evaluation; running sums over the partitions' counts (a row for each partition) number the rows.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = log.repartitionByRange(parts, "ord").sortWithinPartitions("ord")
    placed = written(ordered.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "log")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(counts), "_part").withColumn("seq", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
