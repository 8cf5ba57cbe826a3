"""The queries over the operation log, by name. Each takes (spark, sf_dir); settings are the engine's defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions.hashing import HEADER_BYTES, from_little_endian, log_crc, record_size
from ..operators import compaction, folds, merkle, resolve, runs, sketches, wal
from ..sources import store_files
from ..sources.oplog import clean_input, events_log, orders_log, seconds, with_seq
from ..sources.record_files import data_record
from ..sources.scratch import scratch_folder, written
from ..streaming import snapshot as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BLOOM_M, BLOOM_K = runs.bloom_size(C.memtable_threshold, C.false_positive_rate)
CMS_DEPTH, CMS_WIDTH = sketches.cms_size(C.cms_epsilon, C.cms_delta)
HLL_P = 6
SEGMENTS_PER_FILE = 1024  # of log files
RECORD = ("key", "value", "ts", "tombstone")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(events_log(spark, sf_dir), C.memtable_threshold)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").cast("string").alias("item"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user id, and as many keys that don't exist."""
    return _twins(_ids(spark, sf_dir))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()


def _twins(ids: DataFrame) -> DataFrame:
    return ids.select(F.explode(F.array(F.col("user_id").cast("string"), F.concat(F.lit("x"), F.col("user_id").cast("string")))).alias("key"))


@query
def kv_latest_per_key(spark, sf_dir):
    return resolve.latest_per_key(events_log(spark, sf_dir)).select(*RECORD, record_size(F.col("key"), F.col("value")).alias("record_size"))


@query
def kv_live_snapshot(spark, sf_dir):
    return resolve.snapshot(events_log(spark, sf_dir)).select("key", "value", "ts")


@query
def kv_orders_snapshot(spark, sf_dir):
    return resolve.snapshot(orders_log(spark, sf_dir)).select("key", "value", "ts")


@query
def kv_point_get(spark, sf_dir):
    return resolve.get(events_log(spark, sf_dir), "7").select("key", "value", "ts")


@query
def kv_multi_get(spark, sf_dir):
    return resolve.multi_get(events_log(spark, sf_dir), _probes(spark, sf_dir)).select("key", "found", "value")


@query
def kv_deleted_keys(spark, sf_dir):
    return resolve.latest_per_key(events_log(spark, sf_dir)).filter("tombstone").select("key", "ts")


@query
def kv_delete_outcomes(spark, sf_dir):
    d = resolve.delete_outcomes(events_log(spark, sf_dir))
    return d.groupBy("key").agg(F.count("*").alias("deletes"), F.sum(F.col("found").cast("long")).alias("found"))


@query
def kv_history_counts(spark, sf_dir):
    return resolve.history_counts(events_log(spark, sf_dir))


@query
def wal_segments(spark, sf_dir):
    return wal.segments(with_seq(events_log(spark, sf_dir)), C.wal_segment)


@query
def wal_low_mark_retention(spark, sf_dir):
    return wal.retained(with_seq(events_log(spark, sf_dir)), C.wal_segment, C.wal_low_mark).select("segment", "n_ops", "first_seq", "last_seq")


@query
def wal_replay(spark, sf_dir):
    return wal.replay(with_seq(events_log(spark, sf_dir)), C.wal_segment).select(*RECORD)


@query
def wal_recover(spark, sf_dir):
    """Durable segments written as log files; the latest operation of each key that is read back from them."""
    folder = scratch_folder(spark)
    store_files.write_log(with_seq(events_log(spark, sf_dir)), folder, C.wal_segment, SEGMENTS_PER_FILE)
    return resolve.latest_per_key(store_files.recovered_log(spark, folder)).select(*RECORD)


@query
def wal_crc(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.select(F.col("ord.tie").alias("event_id"), log_crc(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value")).alias("crc"))


@query
def memtable_flush_segments(spark, sf_dir):
    s = folds.flush_segments(events_log(spark, sf_dir), C.memtable_threshold)
    return s.groupBy("segment").agg(F.count("*").alias("n_ops"), F.count_distinct("key").alias("n_keys"), F.min("ord.tie").alias("least_event"), F.max("ord.tie").alias("largest_event"))


@query
def memtable_flush_sharded(spark, sf_dir):
    """Eight independent stores: the form for many executors."""
    s = folds.flush_segments(events_log(spark, sf_dir), C.memtable_threshold, shards=8)
    return s.groupBy("shard", "segment").agg(F.count("*").alias("n_ops"), F.count_distinct("key").alias("n_keys"), F.min("ord.tie").alias("least_event"), F.max("ord.tie").alias("largest_event"))


@query
def sstable_sorted_scan(spark, sf_dir):
    return runs.sorted_scan(_runs(spark, sf_dir)).select("level", "sstable", "place", "key", "value", "tombstone")


@query
def sstable_index_offsets(spark, sf_dir):
    return runs.index(_runs(spark, sf_dir))


@query
def sstable_summary(spark, sf_dir):
    return runs.summary(_runs(spark, sf_dir))


@query
def summary_prune(spark, sf_dir):
    return runs.prune(runs.summary(_runs(spark, sf_dir)), _probes(spark, sf_dir))


@query
def index_lookup(spark, sf_dir):
    """Each probe's entries in the runs that have it: run, and offset of the record."""
    return runs.index(_runs(spark, sf_dir)).join(_probes(spark, sf_dir), "key").select("key", "sstable", "data_offset")


@query
def kv_get_over_runs(spark, sf_dir):
    """Every probe by range, filter, index and data of all runs."""
    return runs.get_over_runs(_runs(spark, sf_dir).select("level", "sstable", "ord", *RECORD), _probes(spark, sf_dir), BLOOM_M, BLOOM_K)


@query
def memtable_dump(spark, sf_dir):
    """The records of the open memtable, which is the last segment, in key order."""
    r = _runs(spark, sf_dir)
    last = r.join(F.broadcast(r.agg(F.max("sstable").alias("sstable"))), "sstable")  # one row
    return runs.sorted_scan(last).select("place", "key", "value", "tombstone")


@query
def write_path(spark, sf_dir):
    """Each operation's outcome: throttled ones go nowhere, admitted ones into the log and a memtable segment."""
    asked = folds.rate_limit(events_log(spark, sf_dir), C.token_bucket_max_token_num, 60 * C.token_bucket_reset_interval).drop("shard", "window_start")
    kept = folds.flush_segments(asked.filter("admitted"), C.memtable_threshold)
    out = kept.select(F.col("ord.tie").alias("event_id"), F.col("op").alias("outcome"), "segment")
    return out.unionByName(asked.filter("not admitted").select(F.col("ord.tie").alias("event_id"), F.lit("throttled").alias("outcome"), F.lit(None).cast("long").alias("segment")))


@query
def sstable_read_at_offset(spark, sf_dir):
    """Runs written as data and index files; the records that index entries of all probes point at, read at their places."""
    folder = scratch_folder(spark)
    summary = store_files.write_index(store_files.write_data(_runs(spark, sf_dir), f"{folder}/data"), f"{folder}/index")
    entries = store_files.read_index(summary, f"{folder}/index").join(_probes(spark, sf_dir), "key")
    got = store_files.read_at(entries, f"{folder}/data")
    return got.select("key", "sstable", F.col("value").cast("string").alias("value"), "ts", "tombstone", "ok")


@query
def merkle_listing(spark, sf_dir):
    """Nodes written as lines of files, and read back from there."""
    folder = scratch_folder(spark)
    listing = store_files.write_listing(merkle_preorder(spark, sf_dir).withColumn("level", F.lit(1)), folder)
    return store_files.read_listing(listing, folder).select("sstable", "place", "hash")


@query
def level_listing(spark, sf_dir):
    """Compacted runs written as Parquet, and what is found there by level."""
    folder = f"{scratch_folder(spark)}/runs"
    out = compaction.compact(_runs(spark, sf_dir).select("level", "sstable", "ord", *RECORD), C.max_levels)
    runs.write_runs(out.select("level", "sstable", *RECORD), folder)
    found = runs.read_runs(spark, folder).groupBy("level", "sstable").agg(F.count("*").alias("n"))
    return found.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_records"))


@query
def input_cleanup(spark, sf_dir):
    """Keys and values as typed lines, each with its line end: the first line feed and the first carriage return go."""
    line = F.concat("key", F.lit("\r\n"), "value", F.lit("\r\n"))
    return events_log(spark, sf_dir).select(F.col("ord.tie").alias("event_id"), clean_input(line).alias("line"))


@query
def sstable_manifest(spark, sf_dir):
    return runs.manifest(_runs(spark, sf_dir))


@query
def bloom_positions(spark, sf_dir):
    b = runs.bloom(_runs(spark, sf_dir), BLOOM_M, BLOOM_K)
    return b.select("level", "sstable", F.concat_ws(",", F.transform("positions", lambda x: x.cast("string"))).alias("positions"))


@query
def bloom_probe(spark, sf_dir):
    return runs.bloom_outcomes(_runs(spark, sf_dir), _probes(spark, sf_dir), BLOOM_M, BLOOM_K)


@query
def merkle_leaves(spark, sf_dir):
    return merkle.leaves(_runs(spark, sf_dir), C.memtable_threshold).select("sstable", "idx", "hash")


@query
def merkle_root(spark, sf_dir):
    leaf = merkle.leaves(_runs(spark, sf_dir), C.memtable_threshold)
    return merkle.roots(merkle.nodes(leaf, C.memtable_threshold)).select("sstable", "root")


@query
def merkle_preorder(spark, sf_dir):
    leaf = merkle.leaves(_runs(spark, sf_dir), C.memtable_threshold)
    return merkle.preorder(merkle.nodes(leaf, C.memtable_threshold)).select("sstable", "place", "hash")


@query
def crc_verify(spark, sf_dir):
    """Records in their byte layout, those of deletes with a damaged last byte, read back: which checksums don't fit."""
    rec = events_log(spark, sf_dir).select("tombstone", data_record(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value")).alias("r"))
    damaged = F.concat(F.expr("substring(r, 1, octet_length(r) - 1)"), F.unhex(F.lit("00")))
    rec = rec.select(F.when(F.col("tombstone"), damaged).otherwise(F.col("r")).alias("r"))
    key_size, value_size = (from_little_endian(F.col("r"), F.lit(1 + at), 8) for at in (21, 29))
    stored = from_little_endian(F.col("r"), F.lit(1), 4)
    read = rec.select(stored.alias("stored"), F.crc32(F.substring("r", 1 + HEADER_BYTES + key_size.cast("int"), value_size.cast("int"))).alias("crc"))
    return read.agg(F.count("*").alias("n"), F.sum((F.col("stored") != F.col("crc")).cast("long")).alias("bad"), F.sum("stored").alias("stored_sum"))


@query
def compaction_merge_pair(spark, sf_dir):
    merged = compaction.merge_step(_runs(spark, sf_dir).select("level", "sstable", "ord", *RECORD), 1, bottom=False)
    return merged.filter("level = 2").select("sstable", *RECORD)


@query
def compaction_levels(spark, sf_dir):
    return compaction.compact(_runs(spark, sf_dir).select("level", "sstable", "ord", *RECORD), C.max_levels).select("level", "sstable", *RECORD)


@query
def compaction_keeps_snapshot(spark, sf_dir):
    """The live snapshot read from runs that are compacted through all levels."""
    out = compaction.compact(_runs(spark, sf_dir).select("level", "sstable", "ord", *RECORD), C.max_levels)
    return resolve.snapshot(out).select("key", "value", "ts")


@query
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(_lineitem(spark, sf_dir), F.col("item"), HLL_P)


@query
def hll_estimate(spark, sf_dir):
    r = sketches.hll_registers(_lineitem(spark, sf_dir), F.col("item"), HLL_P)
    return sketches.hll_estimate(r, HLL_P).select(F.round("estimate", 4).alias("estimate"))


@query
def hll_estimate_rank0(spark, sf_dir):
    r = sketches.hll_registers(_lineitem(spark, sf_dir), F.col("item"), HLL_P, rank_offset=0)
    return sketches.hll_estimate(r, HLL_P).select(F.round("estimate", 4).alias("estimate"))


@query
def hll_by_flag(spark, sf_dir):
    """A sketch for each group, in one pass."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", F.col("l_partkey").cast("string").alias("item"))
    r = sketches.hll_registers(d, F.col("item"), HLL_P, by=("l_returnflag",))
    return sketches.hll_estimate(r, HLL_P, by=("l_returnflag",)).select("l_returnflag", F.round("estimate", 4).alias("estimate"))


def _halves(spark, sf_dir, *columns):
    """Lineitems in two parts, as they would come to a stored sketch."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", *columns, F.col("l_partkey").cast("string").alias("item"))
    return d.filter("l_linestatus = 'O'"), d.filter("l_linestatus <> 'O' or l_linestatus is null")


@query
def hll_stored(spark, sf_dir):
    """A sketch for each flag is created and stored; later rows are added to what is read back; then it is asked."""
    by = ("l_returnflag",)
    first, later = (sketches.hll_registers(d, F.col("item"), HLL_P, by=by) for d in _halves(spark, sf_dir, *by))
    grown = written(sketches.merge_registers(written(first, "hll").unionByName(later), by), "hll")
    return sketches.hll_estimate(grown, HLL_P, by=by).select("l_returnflag", F.round("estimate", 4).alias("estimate"))


@query
def cms_stored(spark, sf_dir):
    """The same with Count-Min cells."""
    first, later = (sketches.cms(d, F.col("item"), CMS_DEPTH, CMS_WIDTH) for d in _halves(spark, sf_dir))
    return written(sketches.merge_cells(written(first, "cms").unionByName(later)), "cms")


@query
def hll_builtin(spark, sf_dir):
    """Spark's own sketch, of 2**12 registers, against the exact count: within five standard errors."""
    return _lineitem(spark, sf_dir).agg(F.hll_sketch_estimate(F.hll_sketch_agg("item", F.lit(12))).alias("e"), F.count_distinct("item").alias("n")).select((F.abs(F.col("e") - F.col("n")) <= F.col("n") * 5 * 1.04 / 64).alias("within_bound"))


@query
def cms_cells(spark, sf_dir):
    return sketches.cms(_lineitem(spark, sf_dir), F.col("item"), CMS_DEPTH, CMS_WIDTH)


def _frequency(spark, sf_dir, independent_rows=True):
    d = _lineitem(spark, sf_dir)
    cells = sketches.cms(d, F.col("item"), CMS_DEPTH, CMS_WIDTH, independent_rows)
    return sketches.cms_frequency(cells, d.distinct(), CMS_DEPTH, CMS_WIDTH, independent_rows)


@query
def cms_frequency(spark, sf_dir):
    return _frequency(spark, sf_dir)


@query
def cms_frequency_shared_seed(spark, sf_dir):
    return _frequency(spark, sf_dir, independent_rows=False)


@query
def cms_error(spark, sf_dir):
    exact = _lineitem(spark, sf_dir).groupBy("item").agg(F.count("*").alias("exact"))
    return _frequency(spark, sf_dir).join(exact, "item").select("item", "exact", (F.col("estimate") - F.col("exact")).alias("error"))


@query
def lru_hits(spark, sf_dir):
    h = folds.lru(events_log(spark, sf_dir).filter("not tombstone"), C.cache_capacity)
    return h.groupBy("key").agg(F.count("*").alias("puts"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query
def lru_with_gets(spark, sf_dir):
    """Views are gets, which bring in what they read; errors are deletes; the rest are puts."""
    log = events_log(spark, sf_dir)
    views = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("tie"), (F.col("event_type") == "view").alias("view"))
    log = log.withColumn("tie", F.col("ord.tie")).join(views, "tie").withColumn("op", F.when(F.col("view"), "get").otherwise(F.col("op"))).drop("tie", "view")
    return folds.lru(log, C.cache_capacity).select(F.col("ord.tie").alias("event_id"), "hit", "state")


@query
def lru_with_deletes(spark, sf_dir):
    h = folds.lru(events_log(spark, sf_dir), C.cache_capacity)
    return h.select(F.col("ord.tie").alias("event_id"), "hit", "state")


@query
def lru_final_state(spark, sf_dir):
    """The cached keys after all puts, most recent first: the last distinct keys of the log."""
    last = events_log(spark, sf_dir).filter("not tombstone").groupBy("key").agg(F.max("ord").alias("ord"))
    top = last.orderBy(F.desc("ord")).limit(C.cache_capacity)
    return top.agg(F.sort_array(F.collect_list(F.struct("ord", "key")), False).alias("a")).select(F.posexplode("a").alias("place", "e")).select(F.col("place").cast("long").alias("place"), F.col("e.key").alias("key"))


@query
def rate_limit_admitted(spark, sf_dir):
    r = folds.rate_limit(events_log(spark, sf_dir), C.token_bucket_max_token_num, 60 * C.token_bucket_reset_interval)
    return r.select(F.col("ord.tie").alias("event_id"), "admitted", "window_start")


@query
def rate_limit_costs(spark, sf_dir):
    """A delete asks for two tokens: one of its own and one of the lookup it makes."""
    r = folds.rate_limit(events_log(spark, sf_dir), 2, 3600, {"delete": 2})
    return r.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.col("admitted").cast("long")).alias("admitted"))


@query
def sketch_namespace(spark, sf_dir):
    """Keys under which sketches of live keys would be created: those that aren't there yet."""
    live = resolve.snapshot(events_log(spark, sf_dir)).select("key")
    wanted = live.select(F.explode(F.array(F.concat("key", F.lit("_hll")), F.concat("key", F.lit("_cms")))).alias("key"))
    return wanted.join(live, "key", "left_anti").withColumn("kind", F.substring_index("key", "_", -1))


@query
def element_format(spark, sf_dir):
    """Records as printed lines; the checksum, which SQL lacks, is cut out."""
    s = resolve.snapshot(events_log(spark, sf_dir))
    text = runs.element_text(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value"))
    return s.select("key", F.regexp_replace(text, r"^CRC: \d+: ", "").alias("line"))


def _stream(spark, sf_dir):
    return streams.events_stream(spark, f"{sf_dir}/events.parque[t]")  # a pattern: the path may be a folder or a file


def _finished(df: DataFrame) -> DataFrame:
    """What a stream gives once it has read all that is there."""
    folder = scratch_folder(df.sparkSession)
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


@query
def stream_snapshot(spark, sf_dir):
    """The live snapshot kept by a stream: its changes, merged into a base and read back."""
    folder = scratch_folder(spark)
    streams.write_changes(streams.stream_log(_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    streams.merge_changes(spark, f"{folder}/out")
    return streams.read_snapshot(spark, f"{folder}/out").filter("not tombstone").select("key", "value", "ts")


@query
def stream_windows(spark, sf_dir):
    """Windows of ten minutes that the watermark, five minutes behind, has closed."""
    d = _finished(streams.windowed_counts(_stream(spark, sf_dir)))
    return d.select(seconds("window.start").alias("start"), "event_type", "n")


@query
def stream_sessions(spark, sf_dir):
    """Sessions with gaps of less than twelve hours that the watermark has closed."""
    d = _finished(streams.session_counts(_stream(spark, sf_dir), "12 hours"))
    return d.select("key", seconds("start").alias("start"), "n")


@query
def stream_flushed(spark, sf_dir):
    d = _finished(streams.flushed(streams.stream_log(_stream(spark, sf_dir)), C.memtable_threshold, 8))
    return d.groupBy("shard", "segment").agg(F.count("*").alias("n_ops"), F.count_distinct("key").alias("n_keys"), F.min("tie").alias("least_event"), F.max("tie").alias("largest_event"))


@query
def stream_cached(spark, sf_dir):
    d = _finished(streams.cached(streams.stream_log(_stream(spark, sf_dir)), C.cache_capacity, 8))
    return d.select(F.col("tie").alias("event_id"), "hit", "state")


@query
def stream_limited(spark, sf_dir):
    """A limiter for each user, of one operation in six hours."""
    d = _finished(streams.rate_limited(streams.stream_log(_stream(spark, sf_dir)), 1, 6 * 3600, late="1 hour"))
    return d.select(F.col("tie").alias("event_id"), "admitted")
