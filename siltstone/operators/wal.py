"""The write-ahead log as a table: segments, retention, replay and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import log_crc, record_size
from .resolve import latest_per_key


def with_segment(log: DataFrame, size: int) -> DataFrame:
    """log needs seq (see with_seq). segment: size operations each, from 0."""
    return log.withColumn("segment", F.expr(f"(seq - 1) div {size}"))


def segments(log: DataFrame, size: int) -> DataFrame:
    """A row for each segment; durable: a later operation has arrived, so the segment is on disk."""
    s = with_segment(log, size).groupBy("segment").agg(
        F.count("*").alias("n_ops"), F.sum(record_size(F.col("key"), F.col("value"))).alias("n_bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )
    last = log.agg(F.max("seq").alias("_last"))
    return s.crossJoin(F.broadcast(last)).withColumn("durable", F.col("last_seq") < F.col("_last")).drop("_last")  # one row


def retained(log: DataFrame, size: int, low_mark: int) -> DataFrame:
    """Segments that clean-up leaves: the last low_mark ones."""
    s = segments(log, size)
    last = log.agg(F.expr(f"(max(seq) - 1) div {size}").alias("_last"))
    return s.crossJoin(F.broadcast(last)).filter(F.col("segment") > F.col("_last") - low_mark).drop("_last")  # one row


def replay(log: DataFrame, size: int) -> DataFrame:
    """The latest operation of each key that the durable segments hold."""
    last = log.agg(F.max("seq").alias("_last"))
    durable = with_segment(log, size).crossJoin(F.broadcast(last)).filter((F.col("segment") + 1) * size < F.col("_last")).drop("_last")
    return latest_per_key(durable)


def checksums(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", log_crc(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value")))
