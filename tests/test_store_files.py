import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import merkle, resolve, runs, wal
from siltstone.sources import oplog, scratch, store_files


@pytest.fixture
def folder(tmp_path):
    return "file://" + str(tmp_path)


@pytest.fixture
def log(spark, sf):
    return oplog.with_seq(oplog.events_log(spark, sf))


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_runs_share_files_and_large_ones_take_several(spark, sf, folder, monkeypatch):
    monkeypatch.setattr(scratch, "RANGE_BYTES", 1 << 12)
    small = runs.flush(oplog.events_log(spark, sf), 4)
    every = oplog.events_log(spark, sf).withColumn("key", F.col("ord.tie").cast("string"))
    large = runs.flush(every, 10**6).withColumn("level", F.lit(2))
    both = scratch.written(small.unionByName(large), "runs")
    data = store_files.write_data(both, folder + "/data")
    n_files = data.select("file").distinct().count()
    assert 1 < n_files < both.select("level", "sstable").distinct().count()
    assert data.filter("level = 2").select("file").distinct().count() > 1
    summary = store_files.write_index(data, folder + "/index")
    assert rows(store_files.read_index(summary, folder + "/index"), "level", "sstable", "key", "file", "offset") == rows(data, "level", "sstable", "key", "file", "offset")
    got = store_files.read_at(data, folder + "/data")
    assert got.filter("not ok").count() == 0
    assert rows(got.withColumn("value", F.col("value").cast("string")), "level", "sstable", "key", "value", "ts", "tombstone") == rows(both, "level", "sstable", "key", "value", "ts", "tombstone")


def test_no_such_record(spark, sf, folder):
    data = store_files.write_data(runs.flush(oplog.events_log(spark, sf), 4), folder).limit(3)
    with pytest.raises(Exception, match="another key"):
        store_files.read_at(data.withColumn("key", F.lit("?")), folder).collect()
    with pytest.raises(Exception, match="cut off"):
        store_files.read_at(data.withColumn("offset", F.lit(10**9)), folder).collect()


def test_listing_over_several_files(spark, sf, folder, monkeypatch):
    tree = scratch.written(merkle.preorder(merkle.nodes(merkle.leaves(runs.flush(oplog.events_log(spark, sf), 4), 4), 4)), "tree")
    monkeypatch.setattr(scratch, "RANGE_BYTES", 1 << 12)
    listing = store_files.write_listing(tree, folder)
    assert listing.select("file").distinct().count() > 1
    assert rows(store_files.read_listing(listing, folder), "level", "sstable", "place", "hash") == rows(tree, "level", "sstable", "place", "hash")


@pytest.mark.parametrize("per_file", [1, 50])
def test_recovery(spark, log, folder, per_file):
    put = store_files.write_log(log, folder, 3, per_file)
    n = log.count()
    durable = ((n - 1) // 3) * 3
    assert put.count() == durable and put.select("file").distinct().count() == -(-durable // (3 * per_file))
    got = resolve.latest_per_key(store_files.recovered_log(spark, folder))
    assert rows(got, "key", "value", "ts", "tombstone") == rows(wal.replay(log, 3), "key", "value", "ts", "tombstone")


def test_clean_up_leaves_the_last_files(spark, log, folder):
    put = store_files.write_log(log, folder, 3, 50)
    files = put.select("file").distinct().count()
    assert store_files.clean_log(spark, folder, 2) == files - 2
    first = (files - 2) * 150
    want = log.filter((F.col("seq") > first) & (F.col("seq") <= put.count()))
    assert rows(store_files.recovered_log(spark, folder), "key", "value", "ts") == rows(want, "key", "value", "ts")
    assert store_files.clean_log(spark, folder, 2) == 0


def test_torn_file(spark, log, folder, tmp_path):
    store_files.write_log(log, folder, 3, 50)
    name = tmp_path / "wal1.db"
    whole = name.read_bytes()
    before = store_files.recovered_log(spark, folder).count()
    name.write_bytes(whole[:-1])
    assert store_files.recovered_log(spark, folder, torn=True).count() == before - 1
    name.write_bytes(whole[: len(whole) - 2] + bytes([whole[-2] ^ 1]) + whole[-1:])
    assert store_files.recovered_log(spark, folder, torn=True).count() == before - 1
    with pytest.raises(Exception, match="checksum"):
        store_files.recovered_log(spark, folder).collect()


def test_nothing_to_write(spark, log, folder):
    assert store_files.write_log(log.filter("seq <= 3"), folder, 3).count() == 0
    data = store_files.write_data(runs.flush(oplog.events_log(spark, "/root/testdata/sf0.001").limit(0), 4), folder)
    assert data.count() == 0 and not [f for f in os.listdir(folder.removeprefix("file://")) if f.endswith(".db")]
    assert store_files.read_at(data, folder).count() == 0


def test_null_values_and_keys(spark, folder):
    log = spark.createDataFrame([(1, "a", None, 5, False), (2, "", "x", 6, False), (3, "b", None, 7, True), (4, "c", "", 8, False)], "seq long, key string, value string, ts long, tombstone boolean")
    store_files.write_log(log, folder + "/log", 3)
    assert rows(store_files.recovered_log(spark, folder + "/log"), "key", "value", "ts", "tombstone") == sorted(map(repr, log.filter("seq < 4").fillna("").select("key", "value", "ts", "tombstone").collect()))
    with pytest.raises(Exception, match="no key"):
        store_files.write_log(log.withColumn("key", F.lit(None).cast("string")), folder + "/bad", 3)
