"""Sorted runs and what is derived from them: offsets, key ranges, filters and manifests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32, record_size, value_crc
from ..sources.scratch import ranges_of, written
from .folds import flush_segments
from .resolve import latest_per_key


def flush(log: DataFrame, threshold: int, shards: int = 1) -> DataFrame:
    """Level-1 runs of a log: level, sstable, then the latest record of each key of the run. Runs count from 0."""
    rows = flush_segments(log, threshold, shards).withColumnRenamed("segment", "sstable")
    by = ("shard", "sstable") if shards > 1 else ("sstable",)
    return latest_per_key(rows, *by).withColumn("level", F.lit(1))


def with_sizes(runs: DataFrame) -> DataFrame:
    return runs.withColumns({"key_size": F.octet_length("key").cast("long"), "value_size": F.octet_length("value").cast("long"), "crc": value_crc(F.col("value"))})


def write_runs(runs: DataFrame, path: str, mode: str = "append") -> None:
    """Runs as Parquet: a folder for each level, and files of about equal size in the order of run and key: small runs share
    a file, a large one takes several, and row groups have narrow ranges of both."""
    order = ("level", "sstable", "key")
    runs.repartitionByRange(ranges_of(runs), *order).sortWithinPartitions(*order).write.mode(mode).partitionBy("level").option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_runs(spark, path: str) -> DataFrame:
    """Filters on the level prune folders, those on run and key reach the row groups."""
    return spark.read.parquet(path)


def in_order(runs: DataFrame, sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """runs with the place of each row in its run's key order (from 1), and exclusive sums of columns in that order.

    A large table is range-sorted and written once; places and sums inside a range of a run are moved by those of the run's
    ranges before it, so that no task holds a whole run.
    """
    ranges = ranges or ranges_of(runs)
    run = ["level", "sstable"]
    rows = runs.withColumns({f"_{c}": x for c, x in sums.items()} | {"_one": F.lit(1).cast("long")})
    if ranges > 1:
        rows = written(rows.repartitionByRange(ranges, *run, "key").withColumn("_part", F.spark_partition_id()), "ordered")
        cells = rows.groupBy(*run, "_part").agg(*[F.sum(f"_{c}").alias(c) for c in (*sums, "one")])
        before = Window.partitionBy(*run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        base = cells.select(*run, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_base_{c}") for c in (*sums, "one")])
        rows, run = rows.join(base, [*run, "_part"]), [*run, "_part"]
    else:
        rows = rows.withColumns({f"_base_{c}": F.lit(0).cast("long") for c in (*sums, "one")})
    w = Window.partitionBy(*run).orderBy("key")
    so_far = {c: F.col(f"_base_{c}") + F.coalesce(F.sum(f"_{c}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}
    return rows.select(*runs.columns, (F.col("_base_one") + F.row_number().over(w)).alias("place"), *[x.alias(c) for c, x in so_far.items()])


def sorted_scan(runs: DataFrame) -> DataFrame:
    """Rows with their place in the run's key order."""
    return in_order(runs, {})


def index(runs: DataFrame) -> DataFrame:
    """data_offset and index_offset of each key: exclusive sums of record sizes, and of 16 + key bytes, in key order."""
    entry = (F.lit(16) + F.octet_length("key")).cast("long")
    return in_order(runs, {"data_offset": record_size(F.col("key"), F.col("value")), "index_offset": entry}).select("level", "sstable", "key", "data_offset", "index_offset")


def summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level", "sstable").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_keys"))


def prune(summaries: DataFrame, probes: DataFrame) -> DataFrame:
    """Of each probe (key, unique): runs whose key range may hold it, and runs that needn't be read.

    Runs that begin at the key or before it, less those that end before it: running sums over keys, in ranges of keys
    whose bounds are a few keys drawn by hash. No probe meets a run, so any number of probes goes.
    """
    zero = F.lit(0).cast("long")
    began = summaries.groupBy(F.col("first_key").alias("key")).agg(F.count("*").alias("began")).select("key", "began", zero.alias("ended"), F.lit(False).alias("probed"))
    ended = summaries.groupBy(F.col("last_key").alias("key")).agg(F.count("*").alias("ended")).select("key", zero.alias("began"), "ended", F.lit(False).alias("probed"))
    wanted = probes.select("key", zero.alias("began"), zero.alias("ended"), F.lit(True).alias("probed"))
    points = began.union(ended).union(wanted).groupBy("key").agg(F.sum("began").alias("began"), F.sum("ended").alias("ended"), F.max("probed").alias("probed"))
    pieces = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pivots = [r["key"] for r in points.select("key").orderBy(F.xxhash64("key"), "key").limit(min(pieces, 1000)).toLocalIterator()]
    part = F.size(F.filter(F.array(*map(F.lit, pivots)), lambda p: p <= F.col("key"))) if pivots else F.lit(0)
    points = points.withColumn("_part", part)
    sums = points.groupBy("_part").agg(F.sum("began").alias("_b"), F.sum("ended").alias("_e"))
    below = sums.alias("c").join(sums.alias("b"), F.expr("b._part < c._part"), "left").groupBy("c._part").agg(F.coalesce(F.sum(F.col("b._b") - F.col("b._e")), F.lit(0)).alias("_below"))
    w = Window.partitionBy("_part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    kept = points.withColumn("_here", F.sum("began").over(w) - F.sum("ended").over(w) + F.col("ended")).filter("probed").join(F.broadcast(below), "_part")  # a row for each range
    total = summaries.agg(F.count("*").alias("_all"))
    return kept.crossJoin(F.broadcast(total)).select("key", (F.col("_below") + F.col("_here")).alias("kept"), (F.col("_all") - F.col("_below") - F.col("_here")).alias("pruned"))  # one row


#: Names of a run's files, by fixed pattern; L is the level.
PARTS = ("usertable-L-Data.db", "usertable-L-Index.db", "usertable-L-Summary.db", "usertable-L-Filter.db", "usertable-L-Metadata.txt", "usertable-L-TOC.db")


def manifest(runs: DataFrame) -> DataFrame:
    names = F.array(*[F.regexp_replace(F.lit(p), "L", F.col("level").cast("string")) for p in PARTS])
    return runs.select("level", "sstable").distinct().select("level", "sstable", F.posexplode(names).alias("part", "file"))


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for n keys at a false-positive rate."""
    m = math.ceil(n * abs(math.log(rate)) / math.log(2) ** 2)
    return m, math.ceil(m / n * math.log(2))


def bloom(runs: DataFrame, m: int, k: int) -> DataFrame:
    """The set positions of each run's filter, ascending."""
    at = runs.select("level", "sstable", F.explode(F.array(*[F.pmod(hash32(i, F.col("key")), F.lit(m)) for i in range(k)])).alias("position"))
    return at.groupBy("level", "sstable").agg(F.array_sort(F.collect_set("position")).alias("positions"))


def bloom_probe(runs: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    """level, sstable, key of the runs whose filter may hold a probe (key, unique); all others needn't be read.

    Probes meet kinds of filters by their positions, of which m and k bound the number, then the runs of those kinds; what
    comes out are the maybes, which are what a reader reads.
    """
    at = F.array_sort(F.array_distinct(F.array(*[F.pmod(hash32(i, F.col("key")), F.lit(m)) for i in range(k)])))
    filters = bloom(runs, m, k)
    p = probes.withColumn("_at", at)
    says = p.select("_at").distinct().crossJoin(filters.select("positions").distinct()).filter(F.forall("_at", lambda x: F.array_contains("positions", x)))  # kinds of either
    return p.join(says, "_at").join(filters, "positions").select("level", "sstable", "key")


def bloom_outcomes(runs: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    """Of each probe (key, unique): the runs by what the filter says and what is true, as four counts.

    No probe meets a run. Equal filters count together, as do probes of equal positions, of which m and k bound the number;
    runs that hold a key are met by an equality join.
    """
    at = F.array_sort(F.array_distinct(F.array(*[F.pmod(hash32(i, F.col("key")), F.lit(m)) for i in range(k)])))
    filters = bloom(runs, m, k)
    kinds = filters.groupBy("positions").agg(F.count("*").alias("_runs"))
    p = probes.withColumn("_at", at)
    says = p.select("_at").distinct().crossJoin(kinds).filter(F.forall("_at", lambda x: F.array_contains("positions", x))).groupBy("_at").agg(F.sum("_runs").alias("_maybe"))
    there = runs.select("level", "sstable", "key").join(probes, "key", "left_semi").withColumn("_at", at).join(filters, ["level", "sstable"])
    there = there.groupBy("key").agg(F.count("*").alias("_there"), F.sum(F.forall("_at", lambda x: F.array_contains("positions", x)).cast("long")).alias("true_positive"))
    total = filters.agg(F.count("*").alias("_all"))
    out = p.join(says, "_at", "left").join(there, "key", "left").crossJoin(F.broadcast(total)).fillna(0, ["_maybe", "_there", "true_positive"])  # one row
    false_positive, false_negative = F.col("_maybe") - F.col("true_positive"), F.col("_there") - F.col("true_positive")
    return out.select("key", "true_positive", false_positive.alias("false_positive"), false_negative.alias("false_negative"), (F.col("_all") - F.col("_maybe") - false_negative).alias("true_negative"))


def get_over_runs(runs: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    """The read path over runs, for probes (key, unique): key, found, value, sstable, and the runs that each step leaves.

    in_range: runs whose key range holds the key; maybe: runs whose filter does; held: runs whose index has it. The newest
    of those answers, and a delete there means that the key isn't found. sstable: the run that answered.
    """
    passed = bloom_outcomes(runs, probes, m, k).select("key", (F.col("true_positive") + F.col("false_positive")).alias("maybe"))
    ranged = prune(summary(runs), probes).select("key", F.col("kept").alias("in_range"))
    here = runs.join(probes.select("key"), "key", "left_semi")
    newest = latest_per_key(here).select("key", F.col("sstable"), F.when(~F.col("tombstone"), F.col("value")).alias("value"), (~F.col("tombstone")).alias("found"))
    held = here.groupBy("key").agg(F.count("*").alias("held"))
    out = probes.select("key").join(ranged, "key").join(passed, "key").join(held, "key", "left").join(newest, "key", "left")
    return out.select("key", F.coalesce("found", F.lit(False)).alias("found"), "value", "sstable", "in_range", "maybe", F.coalesce("held", F.lit(0)).alias("held"))


def element_text(ts, tombstone, key, value):
    """A record as one printed line (a fixed format)."""
    return F.format_string(
        "CRC: %d: Timestamp: %d: Tombstone: %s: Key Size: %d: Value Size: %d: Key: %s: Value: %s",
        value_crc(value), ts, tombstone.cast("string"), F.octet_length(key), F.octet_length(value), key, value,
    )
