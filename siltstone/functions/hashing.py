"""Column functions: portable hashes, bit tricks and byte layouts. All run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 37  # crc 4, timestamp 16, tombstone 1, key size 8, value size 8


def hash32(seed: Column | int, key: Column) -> Column:
    """A 32-bit hash that any engine can compute: the first 8 hex digits of sha1("seed:key")."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    text = F.concat(s.cast("string"), F.lit(":"), key)
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")


def trailing_zeros(h: Column, width: int = 32) -> Column:
    """Zero bits below the lowest set bit; width for 0."""
    return F.when(h == 0, F.lit(width)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("long")


def record_size(key: Column, value: Column) -> Column:
    return (F.lit(HEADER_BYTES) + F.octet_length(key) + F.octet_length(value)).cast("long")


def little_endian(x: Column, n: int) -> Column:
    """The n bytes of a non-negative number, lowest first."""
    digits = F.lpad(F.hex(x), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (n - k) - 1, 2) for k in range(n)]))


def from_little_endian(b: Column, at: Column, n: int) -> Column:
    """The number in the n bytes from place at (from 1) on, lowest first."""
    return F.conv(F.concat(*[F.lpad(F.hex(F.substring(b, at + k, 1)), 2, "0") for k in reversed(range(n))]), 16, 10).cast("long")


def record_tail(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    """A stored record without its checksum, little-endian: timestamp (16 bytes), tombstone, sizes (8 each), key, value."""
    k, v = key.cast("binary"), value.cast("binary")
    size = lambda c: little_endian(F.octet_length(c).cast("long"), 8)
    flag = F.when(tombstone, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(little_endian(ts, 8), F.unhex(F.lit("00" * 8)), flag, size(k), size(v), k, v)


def value_crc(value: Column) -> Column:
    return F.crc32(value.cast("binary"))


def log_crc(ts: Column, tombstone: Column, key: Column, value: Column) -> Column:
    """Checksum of a log record: all of it but the checksum itself."""
    return F.crc32(record_tail(ts, tombstone, key, value))
