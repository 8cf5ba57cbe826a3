"""Compaction through all levels, against plain Python on the smallest tables."""

from siltstone.config import DEFAULT
from siltstone.plans import registry


def compacted(log, most):
    """(level, run): key to (time, is a delete), of a log of (key, time, is a delete) in order."""
    runs = [{}]
    for key, ts, dead in log:
        if key not in runs[-1] and len(runs[-1]) == DEFAULT.memtable_threshold:
            runs.append({})
        runs[-1][key] = (ts, dead)
    out, here = {}, runs
    for level in range(1, most):
        if len(here) % 2:
            out[level, len(here) - 1] = here.pop()
        here = [older | newer for older, newer in zip(here[::2], here[1::2])]
        if level + 1 == most and here:
            here[0] = {k: v for k, v in here[0].items() if not v[1]}
    return out | {(most, i): r for i, r in enumerate(here)}


def test_all_levels(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("ts", "event_id", "user_id", "event_type = 'error' as dead", "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) as s").collect()
    log = [(str(r["user_id"]), r["s"], r["dead"]) for r in sorted(e, key=lambda r: (r["ts"], r["event_id"]))]
    want = sorted((level, i, k, ts, dead) for (level, i), run in compacted(log, DEFAULT.max_levels).items() for k, (ts, dead) in run.items())
    got = sorted(tuple(r[c] for c in ("level", "sstable", "key", "ts", "tombstone")) for r in registry.QUERIES["compaction_levels"](spark, sf).collect())
    assert got == want
    assert max(level for level, *_ in got) == DEFAULT.max_levels == 5
