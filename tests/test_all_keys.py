"""The lookups of every key, against plain Python on the smallest tables."""

import hashlib

import pytest

from siltstone.operators import runs as R
from siltstone.plans import registry


@pytest.fixture(scope="module")
def log(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_id", "user_id", "props", "event_type").collect()
    return [(str(r["user_id"]), r["props"], r["event_type"] == "error") for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"]))]


@pytest.fixture(scope="module")
def flushed(log):
    """Runs as dicts of key and value."""
    out = [{}]
    for key, value, _ in log:
        if key not in out[-1] and len(out[-1]) == 4:
            out.append({})
        out[-1][key] = value
    return out


@pytest.fixture(scope="module")
def keys(log):
    ids = {k for k, _, _ in log}
    return sorted(ids | {"x" + k for k in ids})


def rows(spark, sf, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, sf).collect())


def test_multi_get(spark, sf, log, keys):
    last = {k: (v, dead) for k, v, dead in log}
    live = {k: v for k, (v, dead) in last.items() if not dead}
    assert rows(spark, sf, "kv_multi_get", "key", "found", "value") == [(k, k in live, live.get(k)) for k in keys]


def test_prune(spark, sf, flushed, keys):
    kept = {k: sum(min(r) <= k <= max(r) for r in flushed) for k in keys}
    assert any(kept.values())
    assert rows(spark, sf, "summary_prune", "key", "kept", "pruned") == [(k, kept[k], len(flushed) - kept[k]) for k in keys]


def test_index_lookup(spark, sf, flushed):
    want = []
    for i, r in enumerate(flushed):
        offset = 0
        for k in sorted(r):
            want.append((k, i, offset))
            offset += 37 + len(k.encode()) + len(r[k].encode())
    assert rows(spark, sf, "index_lookup", "key", "sstable", "data_offset") == sorted(want)


def test_bloom(spark, sf, flushed, keys):
    at = {k: {int(hashlib.sha1(f"{i}:{k}".encode()).hexdigest()[:8], 16) % 8 for i in range(2)} for k in keys}
    filters = [set().union(*(at[k] for k in r)) for r in flushed]
    want = []
    for k in keys:
        said, true = [at[k] <= f for f in filters], [k in r for r in flushed]
        want.append((k, *(sum(s == a and t == b for s, t in zip(said, true)) for a, b in ((True, True), (True, False), (False, True), (False, False)))))
    got = rows(spark, sf, "bloom_probe", "key", "true_positive", "false_positive", "false_negative", "true_negative")
    assert got == want and any(w[2] for w in want)


def test_outcomes_equal_the_pairs(spark, sf):
    """Other filter sizes, against probes of each run."""
    r = registry._runs(spark, sf)
    probes = registry._probes(spark, sf)
    maybe = {(x["sstable"], x["key"]) for x in R.bloom_probe(r, probes, 14, 3).collect()}
    held = {(x["sstable"], x["key"]) for x in r.select("sstable", "key").collect()}
    for x in R.bloom_outcomes(r, probes, 14, 3).collect():
        m, t = ({s for s, k in pairs if k == x["key"]} for pairs in (maybe, held))
        assert (x["true_positive"], x["false_positive"], x["false_negative"]) == (len(m & t), len(m - t), len(t - m))
