"""WARC archives with revisit records, and a capture index by external merge.

Of equal payloads of some size, one record holds the payload and the others revisit it. Each task writes one archive, a
gzip member for each record, and cuts what it writes into capture runs: index entries sorted by URL key and timestamp,
of bounded length. Splitters from a sample cut the key space into ranges of about RANGE_RECORDS; a range's slices of all
runs are merged by a loser tree. Ranges in order, and entries in order inside them, are the capture histories of all URLs.
Records are read back at the places that the merged index names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from itertools import repeat

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted, scratch_path, written
from .files import new_file, open_file

LEAST_BYTES = 100
RUN_RECORDS = 20_000
RANGE_RECORDS = 50_000
SAMPLES = 16  # drawn for each range, about
MOST_SECONDS = 1 << 32
FIRST_DATE = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Entry = tuple[bytes, int, int, bool, str, int, int]  # URL key, timestamp, page id (0 for none), whether it has one, file, offset, length


def url_key(url: str | None) -> bytes:
    """The host's labels in reverse, then path and query, in lower case: http://www.A.org:80/b?c#d is org,a)/b?c."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", (url or "").strip().lower(), re.S)
    host, path = m.groups() if m else ("", "")
    labels = re.sub(r"^www\d*\.", "", host).split(".")
    return (",".join(reversed(labels)) + ")" + (path if path.startswith("/") else "/" + path)).encode()


def _date(seconds: int) -> str:
    return (FIRST_DATE + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _header_value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, seconds: int) -> bytes:
    """One WARC record, compressed on its own. A revisit has the HTTP header of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_date(seconds)}",
        f"WARC-Target-URI: {_header_value(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of a compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("the record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:x-page:").removesuffix(">")) else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload isn't what its header says")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(refers) if refers else None, "payload": payload}


class LoserTree:
    """Merges k sorted iterators: inner nodes keep the loser of their match, so each entry costs one path of comparisons."""

    def __init__(self, runs: list[Iterable[Entry]]) -> None:
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads: list[Entry | None] = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[:4], a) <= (y[:4], b))

    def _play(self, leaf: int, filling: bool = False) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.tree[node]
            if other < 0:
                if filling:  # waits for the other side
                    self.tree[node] = winner
                    return
            elif self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (entry := self.heads[w := self.tree[0]]) is not None:
            yield entry
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


RUN = pa.schema([("url_key", pa.list_(pa.binary())), ("seconds", pa.list_(pa.int64())), ("page_id", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("file", pa.string()), ("offset", pa.list_(pa.int64())), ("length", pa.list_(pa.int64()))])
RUN_SQL = "url_key array<binary>, seconds array<long>, page_id array<long>, known array<boolean>, file string, offset array<long>, length array<long>"


def _run(entries: list[Entry]) -> pa.RecordBatch:
    entries.sort()
    key, seconds, page, known, file, offset, length = zip(*entries)
    return pa.record_batch([pa.array([x], t) for x, t in zip((key, seconds, page, known, file[0], offset, length), RUN.types)], schema=RUN)


def _write(directory: str):
    def run(batches):
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        opened = f = None
        offset, entries = 0, []
        for batch in batches:
            for page, url, payload, digest, refers, seconds in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if f is None:
                    opened = new_file(directory, name)
                    f = opened.__enter__()
                member = record(page, url, payload, digest, refers, seconds)
                f.write(member)
                entries.append((url_key(url), seconds, page or 0, page is not None, name, offset, len(member)))
                offset += len(member)
                if len(entries) >= RUN_RECORDS:
                    yield _run(entries)
                    entries = []
        if f is not None:
            opened.__exit__(None, None, None)
        if entries:
            yield _run(entries)

    return run


def _slices(splitters: list[tuple[bytes, int, int, bool]]):
    """Of each run, the slice for each range, as a row."""

    def run(batches):
        from bisect import bisect_left

        for batch in batches:
            for row in batch.to_pylist():
                keys = list(zip(row["url_key"], row["seconds"], row["page_id"], row["known"]))
                bounds = [0, *(bisect_left(keys, s) for s in splitters), len(keys)]
                full = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if lo < hi]
                for k, lo, hi in full:
                    part = [[row[c][lo:hi]] if c != "file" else [row[c]] for c in RUN.names]
                    yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array(x, t) for x, t in zip(part, RUN.types))], ["range", *RUN.names])

    return run


HISTORY = pa.schema([("url_key", pa.binary()), ("seconds", pa.int64()), ("page_id", pa.int64()), ("known", pa.bool_()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("range", pa.int32()), ("place", pa.int64())])


def _merge(t: pa.Table) -> pa.Table:
    """The entries of one range, of which there are about RANGE_RECORDS."""
    lists = [[t[c][k].values.to_pylist() if c != "file" else repeat(t[c][k].as_py()) for c in RUN.names] for k in range(len(t))]
    merged = list(LoserTree([zip(*columns) for columns in lists]))
    k = t["range"][0].as_py()
    return pa.table([pa.array(c, ty) for c, ty in zip([*zip(*merged), [k] * len(merged), range(len(merged))], HISTORY.types)], schema=HISTORY)


def _read(directory: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url_key", pa.string()), ("range", pa.int32()), ("place", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        rows = []
        with open_file(directory, t["file"][0].as_py()) as f:
            for e in t.sort_by("offset").to_pylist():
                f.seek(e["offset"])
                r = parse(f.read(e["length"]))
                if r["page_id"] != (e["page_id"] if e["known"] else None):
                    raise ValueError("the index names another record")
                rows.append([*(r[c] for c in schema.names[:5]), e["url_key"].decode(), e["range"], e["place"]])
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def write_archives(pages: DataFrame, directory: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, payload) to archives in the directory; a row for each capture run."""
    seen = written(pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)), "digests")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    refers = salted(seen, first, "digest", "page_id").filter("page_id > holder").select("page_id", F.col("holder").alias("refers_to")).distinct()
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)).cast("long"), F.lit(MOST_SECONDS))
    rows = pages.join(refers, "page_id", "left").select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), "refers_to", seconds.alias("seconds"))
    return written(rows.sortWithinPartitions("page_id", "url", "digest").mapInArrow(_write(directory), RUN_SQL), "runs")


def merge_index(runs: DataFrame) -> DataFrame:
    """The global capture index of runs: entries with range and place; (range, place) is the order of (key, time, id).

    The number of ranges grows with the records, so that a range stays a bounded piece of work; a key is drawn for every
    RANGE_RECORDS / SAMPLES records. No runs give no entries.
    """
    n = runs.agg(F.sum(F.size("page_id"))).first()[0] or 0
    ranges = n // RANGE_RECORDS + 1
    every = max(1, n // (ranges * SAMPLES))
    keys = runs.select("file", F.explode(F.arrays_zip("url_key", "seconds", "page_id", "known", "offset")).alias("e")).select("file", "e.*")
    sample = sorted((bytes(r["url_key"]), r["seconds"], r["page_id"], r["known"]) for r in keys.filter(F.pmod(F.xxhash64("file", "offset"), F.lit(every)) == 0).toLocalIterator())
    ranges = max(1, min(ranges, len(sample)))
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)})
    slices = runs.mapInArrow(_slices(splitters), "range int, " + RUN_SQL)
    return slices.groupBy("range").applyInArrow(_merge, "url_key binary, seconds long, page_id long, known boolean, file string, offset long, length long, range int, place long")


def archive(pages: DataFrame, directory: str | None = None, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC archives and read them back through the merged index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, range, place: one row for each row of pages.
    Ids are expected to be unique. The payload is the html in UTF-8, null as empty. Of equal payloads of at least
    least_bytes, the smallest id is the response and the others are revisits; shorter ones are all responses, as are rows
    with a null id, which nothing refers to. A null URL is an empty one. Ordered by (range, place), rows are the captures
    in order of URL key, then time, then id. Dates: FIRST_DATE and the id in seconds, modulo MOST_SECONDS (136 years), so
    that any id has one. An empty table writes nothing and gives no rows. Other columns are ignored.
    """
    where = directory or scratch_path(pages.sparkSession, "warc")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    index = merge_index(write_archives(p, where, least_bytes))
    return index.groupBy("file").applyInArrow(_read(where), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, range int, place long")
