"""Order-dependent folds: memtable flush boundaries, an LRU cache, and a fixed-window rate limiter.

Their state depends on all earlier operations of a store, so a store is folded in order. That doesn't need one task: the
log is cut into ranges, and what a range makes of any state it may be entered with fits a small summary. Summaries of all
ranges are chained in order, and then every range is folded from its own entry state, side by side. The driver holds a
state for each range: a number, or as many keys as the memtable or the cache takes. shards splits the log into independent
stores by a portable hash of the key; each is sorted and streamed through a fold.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..sources.scratch import ranges_of, written


class FlushFold:
    """The segment of each operation: a new key that finds the memtable full closes it and opens the next."""

    columns = {"segment": pa.int64()}

    def __init__(self, threshold: int) -> None:
        self.threshold, self.segment, self.keys = threshold, 0, set()

    def step(self, key: str, ts: int, op: str) -> tuple:
        if key not in self.keys and len(self.keys) >= self.threshold:
            self.segment += 1
            self.keys = set()
        self.keys.add(key)
        return (self.segment,)

    def state(self) -> tuple:
        return self.segment, frozenset(self.keys)

    def resume(self, state: tuple) -> None:
        self.segment, self.keys = state[0], set(state[1])

    def summarise(self, keys: list[str], ts: list[int], ops: list[str]) -> tuple:
        """The first keys of the range with, for each, what follows if a segment begins there: flushes, and the open keys.

        Whatever is open at the range's begin, the first boundary lies at one of the first threshold + 1 distinct keys.
        """
        first: dict[str, int] = {}
        for place, key in enumerate(keys):
            if key not in first:
                first[key] = place
                if len(first) > self.threshold:
                    break
        known: dict[int, tuple[int, frozenset]] = {}
        for begin in first.values():
            trail, place = [], begin
            while place not in known:
                memtable: set[str] = set()
                after = None
                for i in range(place, len(keys)):
                    if keys[i] not in memtable and len(memtable) >= self.threshold:
                        after = i
                        break
                    memtable.add(keys[i])
                if after is None:
                    known[place] = (0, frozenset(memtable))
                else:
                    trail.append(place)
                    place = after
            flushes, still = known[place]
            for k, at in enumerate(reversed(trail), 1):
                known[at] = (flushes + k, still)
        return [(key, *known[place]) for key, place in first.items()]

    def leave(self, state: tuple, summary: list) -> tuple:
        segment, still = state
        for key, flushes, after in summary:
            if key not in still:
                if len(still) >= self.threshold:
                    return segment + 1 + flushes, after
                still = still | {key}
        return segment, still


class LruFold:
    """hit: the key was cached before the operation. Puts and gets move it to the front, and bring it in if it isn't there
    (a get stands for one that a run answers; those of the memtable or of no key are for the caller to leave out); deletes remove it. state: cached keys, least recent
    first."""

    columns = {"hit": pa.bool_(), "state": pa.string()}

    def __init__(self, capacity: int) -> None:
        self.capacity, self.keys = capacity, OrderedDict()

    def step(self, key: str, ts: int, op: str) -> tuple:
        hit = key in self.keys
        if op == "delete":
            self.keys.pop(key, None)
        else:
            self.keys[key] = None
            self.keys.move_to_end(key)
            if len(self.keys) > self.capacity:
                self.keys.popitem(last=False)
        return hit, ",".join(self.keys)

    def state(self) -> tuple:
        return tuple(self.keys)

    def resume(self, state: tuple) -> None:
        self.keys = OrderedDict.fromkeys(state)

    def summarise(self, keys: list[str], ts: list[int], ops: list[str]) -> tuple:
        """What the range itself leaves in the cache, and what it does to keys that were there before.

        Keys from before are older than the range's, so they are the first to go: the range's own part of the cache is the
        same whatever was there, and of the rest as many of the latest stay as it leaves room for, less those that it
        touches. touched[n]: keys touched after the own part has grown to n keys for the first time, and before it has n + 1.
        Once it has capacity keys nothing of the rest is left, so no more is kept.
        """
        own, touched = LruFold(self.capacity), [set()]
        for key, t, op in zip(keys, ts, ops):
            if len(touched) <= self.capacity:
                touched[-1].add(key)
            own.step(key, t, op)
            if len(own.keys) == len(touched):
                touched.append(set())
        return own.state(), touched

    def leave(self, state: tuple, summary: tuple) -> tuple:
        own, touched = summary
        older = list(state)
        for n, keys in enumerate(touched):
            room = self.capacity - n
            older = [k for k in older[max(0, len(older) - room) :] if k not in keys]
        return (*older, *own)


class RateFold:
    """admitted and the begin of the window: a window opens with the first request after the last one has expired."""

    columns = {"admitted": pa.bool_(), "window_start": pa.int64()}

    def __init__(self, most: int, interval: int, cost: Callable[[str], int] | None = None) -> None:
        self.most, self.interval, self.cost = most, interval, cost or (lambda op: 1)
        self.start: int | None = None
        self.used = 0

    def step(self, key: str, ts: int, op: str) -> tuple:
        admitted = True
        for _ in range(self.cost(op)):  # each token is asked for on its own
            if self.start is None or ts - self.start >= self.interval:
                self.start, self.used = ts, 0
            elif self.used >= self.most:
                admitted = False
                break
            self.used += 1
        return admitted, self.start

    def state(self) -> tuple:
        return self.start, self.used

    def resume(self, state: tuple) -> None:
        self.start, self.used = state

    def summarise(self, keys: list[str], ts: list[int], ops: list[str]) -> tuple:
        """The times where the first window of the range may open, with the last window's begin and use for each; and what
        the range asks for. Windows open by times alone, and the first opens an interval after the range's begin at last."""
        asked = [0]
        for op in ops:
            asked.append(asked[-1] + self.cost(op))
        opens, place = [], 0
        while place < len(ts):
            begin = place
            while (after := bisect_left(ts, ts[begin] + self.interval)) < len(ts):
                begin = after
            opens.append((ts[place], ts[begin], min(self.most, asked[-1] - asked[begin])))
            if ts[place] >= ts[0] + self.interval:
                break
            place = bisect_left(ts, ts[place] + 1)
        return opens, asked[-1]

    def leave(self, state: tuple, summary: tuple) -> tuple:
        start, used = state
        opens, asked = summary
        for first, begin, since in opens:
            if start is None or first - start >= self.interval:
                return begin, since
        return start, min(self.most, used + asked)


def _each(batches: Iterator[pa.RecordBatch], column: str):
    """(value, rows) of each run of equal values of the column: key, ts and op as lists."""
    current, rows = None, ([], [], [])
    for batch in batches:
        at = batch.schema.get_field_index
        for part, *row in zip(*(batch.column(at(c)).to_pylist() for c in (column, "key", "ts", "op"))):
            if part != current:
                if current is not None:
                    yield current, rows
                current, rows = part, ([], [], [])
            for values, v in zip(rows, row):
                values.append(v)
    if current is not None:
        yield current, rows


def _run(rows: DataFrame, make: Callable[[], object], columns: dict[str, pa.DataType], by: str, states: dict | None = None) -> DataFrame:
    """rows, which are in order by the column by and then by the log, with the fold's columns. A fold begins anew with each
    value of by, or from its entry state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            at = batch.schema.get_field_index
            out: list[tuple] = []
            for s, key, ts, op in zip(*(batch.column(at(c)).to_pylist() for c in (by, "key", "ts", "op"))):
                if state is None or s != current:
                    state, current = make(), s
                    if states is not None:
                        state.resume(states[s])
                out.append(state.step(key, ts, op))
            cols = list(zip(*out)) if out else [[] for _ in columns]
            yield pa.record_batch([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, columns.values()))], [*batch.schema.names, *columns])

    names = {"int64": "long", "bool": "boolean", "string": "string"}
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"{c} {names[str(t)]}" for c, t in columns.items()])
    return rows.mapInArrow(run, schema)


def _chained(log: DataFrame, make: Callable[[], object], columns: dict[str, pa.DataType], ranges: int) -> DataFrame:
    """The fold of a log in ranges; a row for each range comes to the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _each(batches, "_part"):
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([pickle.dumps(make().summarise(*rows))])], ["_part", "summary"])

    ordered = log.repartitionByRange(ranges, "ord").sortWithinPartitions("ord").withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    rows = written(ordered, "ranges").repartition(ranges, "_part").sortWithinPartitions("_part", "_place")
    summaries = rows.select("_part", "key", "ts", "op").mapInArrow(summarise, "_part int, summary binary")
    state, states = make().state(), {}
    for r in sorted(summaries.toLocalIterator(), key=lambda r: r["_part"]):
        states[r["_part"]] = state
        state = make().leave(state, pickle.loads(r["summary"]))
    return _run(rows, make, columns, "_part", states).drop("_part", "_place")


def shard_of(shards: int) -> Column:
    """The store that a key belongs to."""
    return F.pmod(hash32(0, F.col("key")), F.lit(shards)).cast("int")


def fold(log: DataFrame, make: Callable[[], object], columns: dict[str, pa.DataType], shards: int = 1, ranges: int | None = None) -> DataFrame:
    """log's rows with shard and the fold's columns. ranges: of one store's log, in number that grows with it unless given."""
    if shards > 1:
        rows = log.withColumn("shard", shard_of(shards)).repartition(shards, "shard")
        return _run(rows.sortWithinPartitions("shard", "ord"), make, columns, "shard")
    rows = log.withColumn("shard", F.lit(0))
    ranges = ranges or ranges_of(log)
    if ranges > 1:
        return _chained(rows, make, columns, ranges)
    return _run(rows.coalesce(1).sortWithinPartitions("ord"), make, columns, "shard")


def flush_segments(log: DataFrame, threshold: int, shards: int = 1, ranges: int | None = None) -> DataFrame:
    return fold(log, lambda: FlushFold(threshold), FlushFold.columns, shards, ranges)


def lru(log: DataFrame, capacity: int, shards: int = 1, ranges: int | None = None) -> DataFrame:
    return fold(log, lambda: LruFold(capacity), LruFold.columns, shards, ranges)


def rate_limit(log: DataFrame, most: int, interval: int, costs: dict[str, int] | None = None, shards: int = 1, ranges: int | None = None) -> DataFrame:
    return fold(log, lambda: RateFold(most, interval, (lambda op: costs.get(op, 1)) if costs else None), RateFold.columns, shards, ranges)
