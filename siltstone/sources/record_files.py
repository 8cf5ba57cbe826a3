"""The binary record layout as a source and a sink: data files of sorted runs, and write-ahead log segments.

Layout, little-endian: crc 4, timestamp 16 (8 used), tombstone 1, key size 8, value size 8, key, value. The checksum of
a data record covers the value; that of a log record all that follows it.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HEADER_BYTES, little_endian, log_crc, record_tail, value_crc

_HEADER = struct.Struct("<IQ8xBQQ")
RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("crc", pa.int64()), ("ts", pa.int64()), ("tombstone", pa.bool_()), ("key", pa.string()), ("value", pa.binary()), ("ok", pa.bool_())])
RECORDS_SQL = "path string, offset long, crc long, ts long, tombstone boolean, key string, value binary, ok boolean"


def data_record(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    return F.concat(little_endian(value_crc(value), 4), record_tail(ts, tombstone, key, value))


def log_record(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    return F.concat(little_endian(log_crc(ts, tombstone, key, value), 4), record_tail(ts, tombstone, key, value))


def header(head: bytes) -> tuple:
    """crc, ts, tombstone, key size, value size."""
    return _HEADER.unpack(head)


def decode(content: bytes, log: bool = False, torn: bool = False):
    """(offset, crc, ts, tombstone, key, value, ok) of each record; ValueError where the file ends inside one.

    torn: records end before the first that is cut off or whose checksum doesn't fit, as after a crash.
    """
    at = 0
    while at < len(content):
        end = at + HEADER_BYTES
        if end <= len(content):
            crc, ts, tombstone, n_key, n_value = _HEADER.unpack_from(content, at)
            end += n_key + n_value
        if end > len(content):
            if torn:
                return
            raise ValueError(f"a record is cut off at byte {at}")
        key, value = content[at + HEADER_BYTES : end - n_value], content[end - n_value : end]
        ok = zlib.crc32(content[at + 4 : end] if log else value) == crc
        if torn and not ok:
            return
        yield at, crc, ts, bool(tombstone), key.decode(), value, ok
        at = end


def read_record_files(spark: SparkSession, path: str, log: bool = False, strict: bool = False, torn: bool = False) -> DataFrame:
    """Records of all files below the path. ok: the checksum fits; strict: fail where one doesn't; torn: see decode."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(name, *r) for r in decode(content, log, torn)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, RECORDS.types)], schema=RECORDS)

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, RECORDS_SQL)
    return df.filter(F.when(F.col("ok"), True).otherwise(F.raise_error("a record's checksum doesn't fit").cast("boolean"))) if strict else df


def run_files(runs: DataFrame) -> DataFrame:
    """level, sstable, name, content: each run's data file as one value, records in key order.

    For exchange with the byte layout; a run's rows must fit one value, as they fit a memtable.
    """
    rec = data_record(F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("key", rec.alias("r")))), lambda x: F.hex(x["r"]))
    return runs.groupBy("level", "sstable").agg(F.unhex(F.array_join(parts, "")).alias("content")).withColumn("name", F.concat(F.lit("usertable-"), F.col("level"), F.lit("-Data.db")))
