import pytest
from pyspark.sql import functions as F

from siltstone.operators import folds, resolve
from siltstone.sources.oplog import events_log
from siltstone.streaming import snapshot


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """The events as four files, later ones first, so that operations come late."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(4, F.desc("event_id")).write.parquet(path)
    return path


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()


def test_stream_equals_batch(spark, sf, events, tmp_path):
    """After each batch the snapshot is that of the operations so far, and merging changes leaves it as it is."""
    log = snapshot.stream_log(snapshot.events_stream(spark, events))
    out = str(tmp_path / "out")
    finish(snapshot.write_changes(log, out, str(tmp_path / "state")))
    want = {tuple(r) for r in resolve.snapshot(events_log(spark, sf)).select("key", "value", "ts").collect()}
    live = lambda version=None: {tuple(r) for r in snapshot.read_snapshot(spark, out, version).filter("not tombstone").select("key", "value", "ts").collect()}
    assert live() == want and live(3) == want and snapshot._numbers(spark, f"{out}/changes") == [0, 1, 2, 3]
    (tmp_path / "out/base/upto=3").mkdir(parents=True)  # of a run that was cut off
    assert live() == want
    assert snapshot.merge_changes(spark, out) == 3
    assert live() == want and snapshot._numbers(spark, f"{out}/changes") == [] and snapshot._numbers(spark, f"{out}/base", whole=True) == [3]
    assert snapshot.merge_changes(spark, out) == 3 and live() == want


def test_windows(spark, sf, events, tmp_path):
    counts = snapshot.windowed_counts(snapshot.events_stream(spark, events, 4), late="40 days")
    finish(counts.writeStream.outputMode("update").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path)))
    got = spark.sql("select event_type, max(n) as n from (select window, event_type, max(n) as n from windows group by all) group by all")
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().count()


def test_rate_limiter_state(spark, sf, tmp_path, events):
    log = snapshot.stream_log(snapshot.events_stream(spark, events, 4))
    finish(snapshot.rate_limited(log, 2, 3600).writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path)))
    got = {r["tie"]: r["admitted"] for r in spark.table("limited").collect()}
    fold = {}
    want = {}
    for r in events_log(spark, sf).orderBy("ord").collect():
        f = fold.setdefault(r["key"], folds.RateFold(2, 3600))
        want[r["ord"]["tie"]] = f.step(r["key"], r["ts"], "put")[0]
    assert got == want


@pytest.fixture(scope="module")
def in_order(spark, sf, tmp_path_factory):
    """The events as four files that arrive in log order."""
    path = tmp_path_factory.mktemp("ordered") / "events"
    e = spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(4, "ts", "event_id").withColumn("part", F.spark_partition_id())
    for i in range(4):
        e.filter(f"part = {i}").drop("part").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def collected(spark, df, name, state):
    finish(df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(state)))
    return spark.table(name)


def by_fold(spark, sf, make, group, column):
    """tie -> value, by one fold for each group over the log in order."""
    state, out = {}, {}
    for r in events_log(spark, sf).withColumn("g", group).orderBy("ord").collect():
        f = state.setdefault(r["g"], make())
        out[r["ord"]["tie"]] = f.step(r["key"], r["ts"], r["op"])[list(f.columns).index(column)]
    return out


def test_flushes_keep_state_between_batches(spark, sf, in_order, tmp_path):
    log = snapshot.stream_log(snapshot.events_stream(spark, in_order))
    got = {r["tie"]: r["segment"] for r in collected(spark, snapshot.flushed(log, 4, 2), "flushed", tmp_path).collect()}
    assert got == by_fold(spark, sf, lambda: folds.FlushFold(4), folds.shard_of(2), "segment")


def test_cache_keeps_state_between_batches(spark, sf, in_order, tmp_path):
    log = snapshot.stream_log(snapshot.events_stream(spark, in_order))
    got = {r["tie"]: r["state"] for r in collected(spark, snapshot.cached(log, 2, 2), "cached", tmp_path).collect()}
    assert got == by_fold(spark, sf, lambda: folds.LruFold(2), folds.shard_of(2), "state")


def test_limiter_drops_old_state(spark, sf, in_order, tmp_path):
    """Files come in order, so nothing is late: results are as without a watermark, and state goes."""
    log = snapshot.stream_log(snapshot.events_stream(spark, in_order))
    q = snapshot.rate_limited(log, 2, 3600, late="1 hour").writeStream.outputMode("append").format("memory").queryName("bounded").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {r["tie"]: r["admitted"] for r in spark.table("bounded").collect()}
    assert got == by_fold(spark, sf, lambda: folds.RateFold(2, 3600), F.col("key"), "admitted")
    assert left < spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()


def test_sessions(spark, sf, in_order, tmp_path):
    """Sessions that the watermark has closed are those that plain Python finds."""
    d = snapshot.session_counts(snapshot.events_stream(spark, in_order), "2 days", "1 hour")
    got = {(r["key"], r["start"].timestamp()): r["n"] for r in collected(spark, d, "sessions", tmp_path).collect()}
    want, last = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts", "event_id").collect():
        key, at = str(r["user_id"]), r["ts"].timestamp()
        begin = last[key][0] if key in last and at - last[key][1] < 2 * 86400 else at
        last[key] = (begin, at)
        want[key, begin] = want.get((key, begin), 0) + 1
    ends = max(at for _, at in last.values()) - 3600
    still = {(k, b) for k, (b, at) in last.items() if at + 2 * 86400 > ends}
    assert got and got == {s: n for s, n in want.items() if s not in still}
