import re
import hashlib
import random
import zlib
from collections import OrderedDict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.functions import hashing
from siltstone.operators import compaction, folds, merkle, resolve, runs, sketches, wal
from siltstone.sources import oplog, record_files

LOG = "key string, value string, ts long, tombstone boolean, op string, ord struct<us:long, tie:long>"


def log_of(spark, ops):
    """ops: (key, value or None for a delete, ts)"""
    return spark.createDataFrame([(k, v or "", t, v is None, "delete" if v is None else "put", (t * 1_000_000, i)) for i, (k, v, t) in enumerate(ops)], LOG)


def random_ops(seed, n=120, keys=9):
    r = random.Random(seed)
    return [(f"k{r.randrange(keys)}", None if r.random() < 0.25 else f"v{i}", i // 3) for i in range(n)]


def live(ops):
    out = {}
    for k, v, _ in ops:
        out[k] = v
    return {k: v for k, v in out.items() if v is not None}


def kv(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshot_and_lookups(spark, seed):
    ops = random_ops(seed)
    log = log_of(spark, ops)
    want = live(ops)
    assert kv(resolve.snapshot(log)) == want
    key = sorted(want)[0]
    assert kv(resolve.get(log, key)) == {key: want[key]} and kv(resolve.get(log, "none")) == {}
    probes = spark.createDataFrame([(k,) for k in ["k0", "k1", "none"]], "key string")
    got = {r["key"]: (r["found"], r["value"]) for r in resolve.multi_get(log, probes).collect()}
    assert got == {k: (k in want, want.get(k)) for k in ["k0", "k1", "none"]}


def test_point_get_reaches_the_scan(spark, sf):
    plan = resolve.get(oplog.events_log(spark, sf), "7")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in resolve.latest_per_key(oplog.events_log(spark, sf))._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan)[1]
    assert "EqualTo(user_id,7)" in pushed


@pytest.mark.parametrize("seed", [3, 4])
def test_compaction_keeps_the_snapshot(spark, seed):
    ops = random_ops(seed, 200)
    level1 = runs.flush(log_of(spark, ops), 4)
    for levels in (2, 3, 4):
        out = compaction.compact(level1, levels)
        assert kv(resolve.snapshot(out)) == live(ops)
    shuffled = compaction.compact(level1.orderBy(F.rand(1)), 3)
    key = lambda df: sorted((r["level"], r["sstable"], r["key"], r["value"]) for r in df.collect())
    assert key(shuffled) == key(compaction.compact(level1, 3))


def test_merge_of_two_runs(spark):
    schema = "key string, value string, ts long, tombstone boolean"
    older = spark.createDataFrame([("a", "1", 5, False), ("b", "2", 5, False), ("c", "3", 9, False), ("d", "4", 5, False), ("f", "6", 5, True)], schema)
    newer = spark.createDataFrame([("b", "", 7, True), ("c", "x", 8, False), ("d", "y", 5, False), ("e", "", 7, True)], schema)
    want = [("a", "1", 5, False), ("c", "3", 9, False), ("d", "y", 5, False), ("e", "", 7, True), ("f", "6", 5, True)]
    assert sorted(map(tuple, compaction.merge_pair(older, newer, drop_deleted=True).select("key", "value", "ts", "tombstone").collect())) == want
    assert sorted(map(tuple, compaction.merge_pair(older, newer).select("key", "value", "ts", "tombstone").collect())) == sorted([*want, ("b", "", 7, True)])


def test_flush_boundaries():
    f = folds.FlushFold(4)
    assert [f.step(k, 0, "put")[0] for k in "abcdaebea"] == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_lru_states():
    f = folds.LruFold(2)
    ops = [("a", "put"), ("b", "put"), ("a", "get"), ("c", "put"), ("b", "get"), ("a", "delete"), ("d", "put")]
    assert [f.step(k, 0, o) for k, o in ops] == [(False, "a"), (False, "a,b"), (True, "b,a"), (False, "a,c"), (False, "c,b"), (False, "c,b"), (False, "b,d")]


def test_rate_windows():
    f = folds.RateFold(3, 10)
    got = [f.step("k", t, "put") for t in (0, 1, 2, 3, 9, 10, 11, 25, 26, 27, 28)]
    assert [g[0] for g in got] == [True, True, True, False, False, True, True, True, True, True, False]
    assert [g[1] for g in got] == [0, 0, 0, 0, 0, 10, 10, 25, 25, 25, 25]
    f = folds.RateFold(3, 10, lambda op: 2 if op == "delete" else 1)
    assert [f.step("k", 0, o)[0] for o in ("delete", "delete", "put")] == [True, False, False]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from(["put", "get", "delete"])), max_size=60), st.integers(1, 4))
def test_folds_keep_their_bounds(ops, size):
    cache, flush, model = folds.LruFold(size), folds.FlushFold(size), OrderedDict()
    segments = {}
    for k, o in ops:
        hit, state = cache.step(k, 0, o)
        assert hit == (k in model) and len([x for x in state.split(",") if x]) <= size
        model = OrderedDict.fromkeys(x for x in state.split(",") if x)
        segments.setdefault(flush.step(k, 0, o)[0], set()).add(k)
    sizes = [len(segments[s]) for s in sorted(segments)]
    assert all(n == size for n in sizes[:-1]) and all(n <= size for n in sizes)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_no_window_admits_more_than_allowed(gaps, most, interval):
    f, t, seen = folds.RateFold(most, interval), 0, {}
    for g in gaps:
        t += g
        ok, start = f.step("k", t, "put")
        seen[start] = seen.get(start, 0) + ok
    assert max(seen.values()) <= most


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghi"), st.integers(0, 6), st.sampled_from(["put", "delete"])), max_size=60), st.integers(1, 6), st.lists(st.integers(0, 60), max_size=5))
def test_ranges_chain_to_the_whole_fold(ops, size, cuts):
    """From summaries alone, each range is entered with the state that folding all before it leaves."""
    times, now = [], 0
    for _, gap, _ in ops:
        now += gap
        times.append(now)
    bounds = [0, *sorted(min(c, len(ops)) for c in cuts), len(ops)]
    for make in (lambda: folds.FlushFold(size), lambda: folds.LruFold(size), lambda: folds.RateFold(size, 7), lambda: folds.RateFold(size, 4, lambda op: 2 if op == "delete" else 1)):
        whole, state = make(), make().state()
        for lo, hi in zip(bounds, bounds[1:]):
            assert state == whole.state()
            if lo < hi:
                state = make().leave(state, make().summarise([o[0] for o in ops[lo:hi]], times[lo:hi], [o[2] for o in ops[lo:hi]]))
            for k in range(lo, hi):
                whole.step(ops[k][0], times[k], ops[k][2])
        assert state == whole.state()


def test_ranges_of_a_log(spark, sf):
    log = oplog.events_log(spark, sf)
    for name, f in (("segment", lambda n: folds.flush_segments(log, 4, ranges=n)), ("state", lambda n: folds.lru(log, 3, ranges=n)), ("window_start", lambda n: folds.rate_limit(log, 2, 3600, {"delete": 2}, ranges=n))):
        one, many = (sorted((r["ord"]["us"], r["ord"]["tie"], r[name]) for r in f(n).collect()) for n in (1, 7))
        assert one == many and len(one) > 500


def test_shards_are_independent(spark):
    log = log_of(spark, random_ops(5, 150, 20))
    rows = folds.flush_segments(log, 3, shards=4).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        f = by.setdefault(r["shard"], folds.FlushFold(3))
        assert f.step(r["key"], 0, "")[0] == r["segment"]
    assert len(by) > 1 and len(rows) == 150


def tree_of(spark, values, pad):
    df = spark.createDataFrame([(1, 0, f"k{i:03}", v) for i, v in enumerate(values)], "level int, sstable long, key string, value string")
    return merkle.nodes(merkle.leaves(df, pad), max(pad, len(values)))


# Roots of trees over the listed values.
GOLDEN = [
    (["1", "2", "3", "4"], 4, 15, "06e2b4a68e27b8661515e80856f646822b484031"),
    (["", "5", "6", "7"], 4, 15, "469ad00eff712838ad06fd236f7a5f0e2da0352b"),
    (["1", "2", "3", "4", "5", "6", "7"], 8, 31, "d17f9485a97c5bcecb4521989970b32b62a7a3d7"),
]


@pytest.mark.parametrize(("values", "pad", "lines", "root"), GOLDEN)
def test_merkle_golden(spark, values, pad, lines, root):
    tree = tree_of(spark, values, pad)
    assert merkle.roots(tree).first()["root"] == root
    listed = [r["hash"] for r in merkle.preorder(tree).orderBy("place").collect()]
    assert len(listed) == lines and listed[0] == root


@pytest.mark.parametrize("most", [merkle.ARRAY_LEAVES, 0])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7])
def test_merkle_of_any_size(spark, n, most, monkeypatch):
    monkeypatch.setattr(merkle, "ARRAY_LEAVES", most)
    def build(nodes):  # (hash, listing)
        up = []
        for i in range(0, len(nodes), 2):
            if i + 1 < len(nodes):
                h = hashlib.sha1(nodes[i][0] + nodes[i + 1][0]).digest()
                up.append((h, [h, *nodes[i][1], *nodes[i + 1][1]]))
            else:
                up.append((nodes[i][0], [nodes[i][0], *nodes[i][1], bytes(20)]))
        return up[0] if len(up) == 1 else build(up)

    values = [f"v{i}" for i in range(n)]
    leaf = [hashlib.sha1(v.encode()).digest() for v in values]
    root, listing = build([(h, [h, bytes(20), bytes(20)]) for h in leaf])
    tree = tree_of(spark, values, 0)
    assert merkle.roots(tree).first()["root"] == root.hex()
    assert [r["hash"] for r in merkle.preorder(tree).orderBy("place").collect()] == [h.hex() for h in listing]


def test_sizes_and_checksums(spark):
    assert runs.bloom_size(4, 0.4) == (8, 2) and runs.bloom_size(7, 0.4) == (14, 2) and runs.bloom_size(8, 0.4) == (16, 2)
    assert sketches.cms_size(0.1, 0.1) == (4, 28)
    r = spark.createDataFrame([("1", ""), ("", "é")], "key string, value string").select(hashing.value_crc(F.col("key")).alias("c"), hashing.record_size(F.col("key"), F.col("value")).alias("s"), F.conv(F.substring(F.sha1(F.col("key").cast("binary")), 1, 8), 16, 10).alias("h")).collect()
    assert (r[0]["c"], r[1]["c"], r[0]["s"], r[1]["s"], r[0]["h"]) == (2212294583, 0, 38, 39, "896145707")


def test_record_layout_round_trip(spark, tmp_path):
    ops = [("a", "1", 7), ("é", None, 8), ("long", "x" * 500, 1 << 33)]
    log = log_of(spark, ops)
    for log_format in (False, True):
        make = record_files.log_record if log_format else record_files.data_record
        rec = [bytes(r[0]) for r in log.orderBy("ord").select(make(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value"))).collect()]
        (tmp_path / f"f{log_format}").mkdir()
        (tmp_path / f"f{log_format}" / "x.db").write_bytes(b"".join(rec))
        got = record_files.read_record_files(spark, str(tmp_path / f"f{log_format}"), log_format).orderBy("offset").collect()
        assert [(r["key"], bytes(r["value"]).decode() if not r["tombstone"] else None, r["ts"], r["ok"]) for r in got] == [(*o, True) for o in ops]
        if not log_format:
            assert [r["crc"] for r in got] == [zlib.crc32((v or "").encode()) for _, v, _ in ops]
    bad = bytearray(b"".join(rec))
    bad[-1] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.db").write_bytes(bad)
    assert [r["ok"] for r in record_files.read_record_files(spark, str(tmp_path / "bad"), True).orderBy("offset").collect()] == [True, True, False]
    with pytest.raises(Exception, match="checksum"):
        record_files.read_record_files(spark, str(tmp_path / "bad"), True, strict=True).collect()
    with pytest.raises(ValueError, match="cut off"):
        list(record_files.decode(bytes(bad[:-3])))


def test_run_files(spark):
    level1 = runs.flush(log_of(spark, random_ops(8, 30)), 4)
    files = {r["sstable"]: bytes(r["content"]) for r in record_files.run_files(level1).collect()}
    want = {}
    for r in level1.orderBy("key").collect():
        want.setdefault(r["sstable"], []).append(r["key"])
    assert {s: [x[4] for x in record_files.decode(c)] for s, c in files.items()} == want


def test_runs_on_disk(spark, tmp_path):
    level1 = runs.flush(log_of(spark, random_ops(9)), 4)
    runs.write_runs(level1, str(tmp_path / "runs"), "overwrite")
    back = runs.read_runs(spark, str(tmp_path / "runs"))
    assert back.count() == level1.count()
    plan = back.filter("sstable = 1 and key = 'k1'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(key,k1)" in plan


def test_order_by_ranges(spark):
    """Places and offsets of runs that are cut into ranges, against whole runs."""
    rows = [(1, r, f"k{k:04d}", "v" * (k % 17), k) for r, n in ((0, 1), (1, 700), (2, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "level int, sstable long, key string, value string, size long").repartition(5)
    got = [sorted(map(tuple, runs.in_order(df, {"before": F.col("size")}, n).select("sstable", "key", "place", "before").collect())) for n in (1, 6)]
    assert got[0] == got[1] == [(r, f"k{k:04d}", k + 1, k * (k - 1) // 2) for r, n in ((0, 1), (1, 700), (2, 40)) for k in range(n)]


def test_bloom_has_no_false_negatives(spark):
    level1 = runs.flush(log_of(spark, random_ops(10)), 4).cache()
    probes = level1.select("key").distinct()
    maybe = runs.bloom_probe(level1, probes, 8, 2)
    assert maybe.count() > 0 and level1.join(maybe, ["level", "sstable", "key"], "left_anti").count() == 0


def test_sketch_bounds(spark):
    df = spark.range(1000).select((F.col("id") % 300).cast("string").alias("item"))
    est = sketches.hll_estimate(sketches.hll_registers(df, F.col("item"), 6), 6).first()["estimate"]
    half = sketches.hll_estimate(sketches.hll_registers(df, F.col("item"), 6, rank_offset=0), 6).first()["estimate"]
    assert abs(est - 300) <= 3 * 1.04 / 8 * 300 and half < 0.75 * est
    a, b = (sketches.hll_registers(df.filter(f"item % 2 = {k}"), F.col("item"), 6) for k in (0, 1))
    assert sorted(map(tuple, sketches.merge_registers(a.union(b)).collect())) == sorted(map(tuple, sketches.hll_registers(df, F.col("item"), 6).collect()))
    cells = sketches.cms(df, F.col("item"), 4, 28)
    got = {r["item"]: r["estimate"] for r in sketches.cms_frequency(cells, df.distinct(), 4, 28).collect()}
    exact = {r["item"]: r["count"] for r in df.groupBy("item").count().collect()}
    assert all(got[i] >= n for i, n in exact.items())
    assert sketches.hll_estimate(sketches.hll_registers(df.limit(0), F.col("item"), 6), 6).first()["estimate"] == 0


def test_wal(spark):
    ops = random_ops(11, 10)
    log = oplog.with_seq(log_of(spark, ops))
    assert [r["seq"] for r in log.orderBy("ord").collect()] == list(range(1, 11))
    s = {r["segment"]: (r["n_ops"], r["durable"]) for r in wal.segments(log, 3).collect()}
    assert s == {0: (3, True), 1: (3, True), 2: (3, True), 3: (1, False)}
    assert sorted(r["segment"] for r in wal.retained(log, 3, 2).collect()) == [2, 3]
    assert kv(wal.replay(log, 3).filter("not tombstone")) == live(ops[:9])


def test_seq_of_many_partitions(spark):
    """Wide values and unequal times, so that partitions differ in size and adaptive execution would join some of them."""
    n = 20_000
    wide = spark.range(n).select(F.expr("timestamp_seconds(pmod(xxhash64(id), 5000) * pmod(id, 3))").alias("t"), F.col("id").alias("tie"), F.repeat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(700)).cast("int")).alias("v"))
    log = oplog.oplog(wide.repartition(9), "t", "tie", F.col("tie").cast("string"), F.col("v"), F.lit(False))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("8", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = [(r["seq"], r["ord"]["us"], r["ord"]["tie"]) for r in oplog.with_seq(log).select("seq", "ord").orderBy("seq").collect()]
            assert [s for s, *_ in got] == list(range(1, n + 1)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gets_bring_keys_in():
    f = folds.LruFold(2)
    ops = [("a", "put"), ("b", "put"), ("c", "get"), ("a", "get"), ("c", "get"), ("b", "delete"), ("a", "delete"), ("d", "get")]
    assert [f.step(k, 0, op) for k, op in ops] == [(False, "a"), (False, "a,b"), (False, "b,c"), (False, "c,a"), (True, "a,c"), (False, "a,c"), (True, "c"), (False, "c,d")]


def test_settings(tmp_path):
    assert Config.load(tmp_path / "none") == Config()
    (tmp_path / "c").write_text("memtable_threshold: 7\nfalse_positive_rate: 0.1  # comment\n\n")
    assert Config.load(tmp_path / "c") == Config(memtable_threshold=7, false_positive_rate=0.1)
    (tmp_path / "c").write_text("unknown: 7\n")
    with pytest.raises(ValueError, match="no such setting"):
        Config.load(tmp_path / "c")


def test_input_lines(spark):
    df = spark.createDataFrame([("a\r\nb\nc\r",), ("plain",)], "t string")
    assert [r[0] for r in df.select(oplog.clean_input(F.col("t"))).collect()] == ["ab\nc\r", "plain"]
