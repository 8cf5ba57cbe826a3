"""The operation log as a stream: latest-wins tables, counts by window and session, and flushes, the cache and the rate
limiter as stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import FlushFold, LruFold, RateFold, shard_of
from ..sources.oplog import oplog
from ..sources.scratch import _store, discard

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_SNAPSHOT = "key string, value string, ts long, tombstone boolean"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_log(events: DataFrame) -> DataFrame:
    return oplog(events, "ts", "event_id", F.col("user_id").cast("string"), F.col("props"), F.col("event_type") == "error")


def latest_stream(log: DataFrame) -> DataFrame:
    """The last operation of each key so far (output mode complete or update). An operation that comes late loses to a
    later one by its order, so no watermark is needed; state is one row for each key."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "ts", "tombstone"), "ord").alias("r")).select("key", "r.*")


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Operations in each window of event time; rows that come later than allowed are dropped and state is bounded."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "5 minutes") -> DataFrame:
    """Operations in each session of a user: operations less than the gap apart. A session comes out once the
    watermark has passed its end, and its state goes."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    s = e.groupBy(F.session_window("at", gap).alias("session"), F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def _folded(log: DataFrame, make: Callable[[], object], by: Column, out: str, state: str, save: Callable, load: Callable, late: str | None = None, until: Callable | None = None) -> DataFrame:
    """A fold of folds.py for each value of by, over a stream: its state is kept between batches, and the operations of a
    batch are taken in log order. An operation that comes in a later batch than its order says is taken when it comes, as a
    store does that logs what it receives.

    late and until (a time in seconds, of the fold): state goes once the watermark has passed that time, and operations from
    before the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        fold = make()
        if held.exists:
            load(fold, held.get)
        rows = pd.concat(list(frames)).sort_values(["us", "tie"], kind="stable")
        found = [fold.step(k, t, o) for k, t, o in zip(rows["key"], rows["ts"].tolist(), rows["op"])]
        held.update(save(fold))
        if until is not None and late is not None:
            held.setTimeoutTimestamp(max(until(fold) * 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.concat([rows[["by", "key", "ts", "tie"]].reset_index(drop=True), pd.DataFrame(found, columns=list(fold.columns))], axis=1)

    rows = log.select(by.alias("by"), "key", "ts", F.col("ord.us").alias("us"), F.col("ord.tie").alias("tie"), "op")
    if late is not None:
        rows = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("by").applyInPandasWithState(step, f"by {dict(rows.dtypes)['by']}, key string, ts long, tie long, {out}", state, "append", timeout)


def flushed(log: DataFrame, threshold: int, shards: int = 8) -> DataFrame:
    """shard, key, ts, tie, segment: the memtable segment of each operation of independent stores, split by a hash of the key.
    State: a segment's number and its keys, no more than threshold."""
    d = _folded(log, lambda: FlushFold(threshold), shard_of(shards), "segment long", "segment long, keys array<string>", lambda f: (f.segment, sorted(f.keys)), lambda f, s: f.resume((s[0], s[1])))
    return d.withColumnRenamed("by", "shard")


def cached(log: DataFrame, capacity: int, shards: int = 8) -> DataFrame:
    """shard, key, ts, tie, hit, state: an LRU cache in front of each store. State: no more than capacity keys."""
    d = _folded(log, lambda: LruFold(capacity), shard_of(shards), "hit boolean, state string", "keys array<string>", lambda f: (list(f.keys),), lambda f, s: f.keys.update(dict.fromkeys(s[0])))
    return d.withColumnRenamed("by", "shard")


def rate_limited(log: DataFrame, most: int, interval: int, late: str | None = None) -> DataFrame:
    """key, ts, tie, admitted: one fixed-window limiter for each key.

    late: how late operations may come. A key's state goes once no operation can meet its window any more, so it is bounded
    by the keys of the last interval; without it every key's state stays.
    """
    d = _folded(
        log, lambda: RateFold(most, interval), F.col("key"), "admitted boolean, window_start long", "start long, used long", RateFold.state, RateFold.resume, late, lambda f: f.start + interval
    )
    return d.select("key", "ts", "tie", "admitted")


def write_changes(log: DataFrame, path: str, checkpoint: str):
    """A folder changes/version=N with the state of the keys that batch N touched; a batch that is run again replaces its own."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/version={epoch}")

    return latest_stream(log).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def _numbers(spark: SparkSession, folder: str, whole: bool = False) -> list[int]:
    """N of each subfolder name=N, ascending; whole: those only that a finished job has left."""
    store, path = _store(spark, folder)
    if not store.exists(path):
        return []
    below = [s.getPath() for s in store.listStatus(path) if "=" in s.getPath().getName()]
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in below if not whole or store.exists(done(p, "_SUCCESS")))


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """key, value, ts, tombstone after a batch (the last one): the newest base up to there and the changes since."""
    versions = [v for v in _numbers(spark, f"{path}/changes") if version is None or v <= version]
    bases = [b for b in _numbers(spark, f"{path}/base", whole=True) if version is None or b <= version][-1:]
    folders = [(f"{path}/base/upto={b}", b) for b in bases] + [(f"{path}/changes/version={v}", v) for v in versions if not bases or v > bases[0]]
    if not folders:
        raise ValueError(f"no snapshot at {path} up to version {version}")
    rows = spark.read.schema(_SNAPSHOT).parquet(*[f for f, _ in folders]).withColumn("_n", F.regexp_extract(F.col("_metadata.file_path"), r"(?:upto|version)=(\d+)/[^/]*$", 1).cast("long"))
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "ts", "tombstone"), "_n").alias("r")).select("key", "r.*")


def merge_changes(spark: SparkSession, path: str) -> int:
    """A new base from all changes so far, then changes and bases that it replaces go. Its number. A run that is cut off
    leaves an unfinished base, which isn't read. Readers of older versions must be through."""
    last = max(_numbers(spark, f"{path}/changes") + _numbers(spark, f"{path}/base", whole=True))
    if last not in _numbers(spark, f"{path}/base", whole=True):
        read_snapshot(spark, path, last).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    for kind, name, most in (("changes", "version", last), ("base", "upto", last - 1)):
        for n in _numbers(spark, f"{path}/{kind}"):
            if n <= most:
                discard(spark, f"{path}/{kind}/{name}={n}")
    return last
