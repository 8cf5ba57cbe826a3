"""Byte layouts as files in the shared folder: written by tasks in a given order, read back at places of them.

Any store that pyarrow knows serves. A task writes under a name of its own attempt and renames the file when it is whole,
so that retries and speculative copies leave one good file. Rows are cut into files of about equal size by ranges of their
order: many small runs share a file, and a large one goes over several; or each value of a column has its own file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HEADER_BYTES, little_endian
from .record_files import data_record, header, log_record, read_record_files
from .scratch import _store, ranges_of, written

_U64 = struct.Struct("<Q")


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *([extra] if extra else [])])


def write_files(rows: DataFrame, folder: str, order: list[str], piece: Column, file: Column | None = None, name: str = "part") -> DataFrame:
    """Write the piece (bytes) of each row in order; the rows with file, offset and length of their piece, as a table.

    file: names of files, each written by one task, which holds no more than a batch of it; left out, files are ranges of
    the order, in number that grows with the rows. An empty table writes nothing.
    """
    rows = rows.withColumn("_piece", piece)
    if file is None:
        rows = rows.repartitionByRange(ranges_of(rows), *order).sortWithinPartitions(*order)
        rows = rows.withColumn("file", F.format_string(f"{name}-%05d.db", F.spark_partition_id()))
    else:
        rows = rows.withColumn("file", file).repartition("file").sortWithinPartitions("file", *order)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        current, temporary, out, at = None, "", None, 0

        def close():
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/{current}")

        for batch in batches:
            offsets, lengths = [], []
            for f, p in zip(batch.column("file").to_pylist(), batch.column("_piece").to_pylist()):
                if f != current:
                    close()
                    current, temporary, at = f, f"{root}/.{f}.{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(temporary, compression=None)
                out.write(p)
                offsets.append(at)
                lengths.append(len(p))
                at += len(p)
            keep = batch.drop_columns(["_piece"])
            yield pa.record_batch([*keep.columns, pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], [*keep.schema.names, "offset", "length"])
        close()

    return written(rows.mapInArrow(put, _schema(rows.drop("_piece"), "offset long, length long")), name)


def _read(places: DataFrame, folder: str, take: Callable, columns: list[tuple[str, str]]) -> DataFrame:
    """places (file, offset, ...) with the columns of what take(handle, row) yields at each, read in order of place."""
    tasks = max(1, int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    schema = _schema(places, ", ".join(f"{c} {t}" for c, t in columns))
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        current = None
        with ExitStack() as stack:
            handle = None
            for batch in batches:
                which, found = [], []
                for i, row in enumerate(batch.select(["file", *[n for n in batch.schema.names if n in ("offset", "length", "key")]]).to_pylist()):
                    if row["file"] != current:
                        current = row["file"]
                        stack.close()
                        handle = stack.enter_context(store.open_input_file(f"{root}/{current}"))
                    for values in take(handle, row):
                        which.append(i)
                        found.append(values)
                kept = batch.take(pa.array(which, pa.int64()))
                read = [pa.array([v[k] for v in found], arrow[t]) for k, (_, t) in enumerate(columns)]
                yield pa.record_batch([*kept.columns, *read], [*kept.schema.names, *(c for c, _ in columns)])

    return ordered.mapInArrow(run, schema)


def spans(pieces: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Where each value of by lies: file, offset, length of its part in each file. Pieces are as write_files gives them."""
    return pieces.groupBy(*by, "file").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), *more)


def _entries(handle, row: dict):
    handle.seek(row["offset"])
    content, at = handle.read(row["length"]), 0
    while at < len(content):
        (n,) = _U64.unpack_from(content, at)
        (offset,) = _U64.unpack_from(content, at + 8 + n)
        yield content[at + 8 : at + 8 + n].decode(), offset
        at += 16 + n


def _record(handle, row: dict):
    handle.seek(row["offset"])
    head = handle.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES:
        raise ValueError(f"a record is cut off at byte {row['offset']} of {row['file']}")
    crc, ts, tombstone, n_key, n_value = header(head)
    body = handle.read(n_key + n_value)
    if len(body) < n_key + n_value:
        raise ValueError(f"a record is cut off at byte {row['offset']} of {row['file']}")
    if body[:n_key].decode() != row["key"]:
        raise ValueError(f"another key than {row['key']!r} at byte {row['offset']} of {row['file']}")
    yield body[n_key:], ts, bool(tombstone), zlib.crc32(body[n_key:]) == crc


def _lines(handle, row: dict):
    handle.seek(row["offset"])
    for line_no, line in enumerate(handle.read(row["length"]).decode().splitlines()):
        yield line_no, line


def _whole(record: Column) -> Column:
    return F.coalesce(record, F.raise_error(F.lit("a record has no key, time or tombstone")).cast("binary"))


def write_data(runs: DataFrame, folder: str) -> DataFrame:
    """Data files of runs in key order: level, sstable, key with file and offset of the record. A null value is stored as
    an empty one; null keys, times or tombstones are errors."""
    rec = _whole(data_record(F.col("ts"), F.col("tombstone"), F.col("key"), F.coalesce("value", F.lit(""))))
    return write_files(runs.select("level", "sstable", "key", "value", "ts", "tombstone"), folder, ["level", "sstable", "key"], rec, name="data").drop("value", "ts", "tombstone")


def write_index(data: DataFrame, folder: str) -> DataFrame:
    """Index files over what write_data gives: an entry is key size, key, offset of the record. What comes back is a row for
    each run, data file and index file: where its entries lie (the summary), its first and last key and their number."""
    entry = F.concat(little_endian(F.octet_length("key").cast("long"), 8), F.col("key").cast("binary"), little_endian(F.col("offset"), 8))
    rows = data.select("level", "sstable", "key", F.col("file").alias("data_file"), "offset")
    written_ = write_files(rows.withColumn("_entry", entry).drop("offset"), folder, ["level", "sstable", "key"], F.col("_entry"), name="index").drop("_entry")
    return written(spans(written_, ["level", "sstable", "data_file"], F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("n_keys")), "summary")


def read_index(summary: DataFrame, folder: str) -> DataFrame:
    """level, sstable, key, file, offset: the entries of the runs in the summary, which may be pruned before."""
    found = _read(summary.select("level", "sstable", "data_file", "file", "offset", "length"), folder, _entries, [("key", "string"), ("data_offset", "long")])
    return found.select("level", "sstable", "key", F.col("data_file").alias("file"), F.col("data_offset").alias("offset"))


def read_at(places: DataFrame, folder: str) -> DataFrame:
    """places (key, file, offset, ...) with value, ts, tombstone and ok (the checksum fits) of the record at the offset.
    It is an error if the record there has another key, or none is whole."""
    return _read(places, folder, _record, [("value", "binary"), ("ts", "long"), ("tombstone", "boolean"), ("ok", "boolean")])


def write_listing(preorder: DataFrame, folder: str) -> DataFrame:
    """Merkle nodes (level, sstable, place, hash), a line for each, in files; where each run's lines lie."""
    lines = write_files(preorder, folder, ["level", "sstable", "place"], F.concat("hash", F.lit("\n")).cast("binary"), name="metadata")
    return written(spans(lines, ["level", "sstable"], F.min("place").alias("first_place")), "listing")


def read_listing(listing: DataFrame, folder: str) -> DataFrame:
    found = _read(listing, folder, _lines, [("line_no", "long"), ("hash", "string")])
    return found.select("level", "sstable", (F.col("first_place") + F.col("line_no")).alias("place"), "hash")


def _log_name(number: Column) -> Column:
    return F.concat(F.lit("wal"), F.when(number > 0, number.cast("string")).otherwise(F.lit("")), F.lit(".db"))


def write_log(log: DataFrame, folder: str, size: int, per_file: int = 1) -> DataFrame:
    """Segments of size operations as log files, per_file segments in each; log needs seq. Operations of the open segment,
    which no later one has closed, aren't written. file, offset, length for each operation written. Nulls: as write_data."""
    last = log.agg(F.max("seq").alias("_last"))
    segment = F.expr(f"(seq - 1) div {size}")
    durable = log.crossJoin(F.broadcast(last)).filter((segment + 1) * size < F.col("_last")).drop("_last")  # one row
    rec = _whole(log_record(F.col("ts"), F.col("tombstone"), F.col("key"), F.coalesce("value", F.lit(""))))
    rows = durable.select("seq", "key", "value", "ts", "tombstone")
    return write_files(rows, folder, ["seq"], rec, _log_name(F.expr(f"(seq - 1) div {size * per_file}")), name="wal").select("seq", "file", "offset", "length")


def recovered_log(spark: SparkSession, folder: str, torn: bool = False) -> DataFrame:
    """The operations that log files hold, with ord (file's number, offset) in their order. A damaged record is an error;
    with torn, a file's records end before its first damaged or cut one."""
    read = read_record_files(spark, folder, log=True, strict=not torn, torn=torn)
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(path, 'wal([0-9]*)[.]db$', 1) as bigint)"), F.lit(0).cast("long"))
    return read.select(F.struct(number.alias("file"), "offset").alias("ord"), "key", F.col("value").cast("string").alias("value"), "ts", "tombstone", F.when(F.col("tombstone"), "delete").otherwise("put").alias("op"))


def clean_log(spark: SparkSession, folder: str, low_mark: int) -> int:
    """Delete all log files but the last low_mark ones; how many went. A name for each file comes to the driver."""
    store, path = _store(spark, folder)
    names = {s.getPath().getName() for s in store.listStatus(path)}
    numbered = sorted((int(n[3:-3] or 0), n) for n in names if n.startswith("wal") and n.endswith(".db"))
    old = numbered[: max(0, len(numbered) - low_mark)]
    for _, n in old:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, n), False)
    return len(old)

