"""Vectorised text kernels over Arrow string buffers: words, hashes and packed columns.

A column of texts is one UTF-8 buffer with offsets; words are spans of it. Hashes are polynomials modulo 2**64
taken from prefix sums, then mixed. Work goes in chunks of a few MB, so memory doesn't grow with the batch.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
CHUNK = 4 << 20
HASHED = 1 << 20  # bytes that are hashed at once
BASE = U(0x9E3779B97F4A7C15 | 1)
BASES = (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes that are no part of a word. White space: [\x20\x09-\x0D].
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
#: All of ASCII but digits and letters.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function of batches that trims when it is through."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


_GROUPS = [0]


def tidy_group(run):
    """A function of a group's table that trims now and then."""

    @wraps(run)
    def tidied(t):
        out = run(t)
        _GROUPS[0] += 1
        if _GROUPS[0] % 16 == 0:
            trim()
        return out

    return tidied


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i <= n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inv = U(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inv):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U))
        have = _POWERS[int(base)] = (out[0], out[1])
        if size > 4 * HASHED:  # for one huge word; not kept
            del _POWERS[int(base)]
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges [i, j) of texts with about limit bytes each, at least one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def texts(batch: pa.RecordBatch, column: str, limit: int = CHUNK):
    """(first row, bytes, offsets) of chunks of the batch's texts."""
    buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    for i, j in chunks(offsets, limit):
        yield i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends of the words, and first (of len(offsets)): text i has words first[i] to first[i + 1]."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    before = np.empty(len(buf) + 1, bool)
    before[1:] = inside
    before[0] = False
    before[offsets] = False  # a text's begin ends any word
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(buf) + 1, bool)
    after[:-1] = inside
    after[-1] = False
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit hash of each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + HASHED, "right")))
        hi = int(ends[j - 1])
        p, inv = powers(base, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((buf[lo:hi].astype(U) + U(1)) * p[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(U) * BASES[0])
        i = j
    return out


def windows(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Rabin-Karp: the hash of each width consecutive hashes, rolling over the whole array."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    step = 1 << 18
    p, inv = powers(base, min(n, step) + width)
    for i in range(0, n, step):
        part = h[i : min(n, i + step) + width - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * p[: len(part)], out=sums[1:])
        m = len(part) - width + 1
        out[i : i + m] = mix((sums[width:] - sums[:m]) * inv[:m])
    return out


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] of them, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - (ends - counts), counts)


def pack_ints(x: np.ndarray) -> bytes:
    """Integers as zstd of the byte planes of their zigzag deltas."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    z = ((d << 1) ^ (d >> 63)).view(U)
    return zstandard.ZstdCompressor(level=1).compress(z.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    z = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    z = np.ascontiguousarray(z.reshape(8, -1).T).view(U).ravel()
    return np.cumsum((z >> U(1)).astype(np.int64) ^ -(z & U(1)).astype(np.int64))


def pieces_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket (of 0 to n - 1); the buckets present; their bounds in that order."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    present, at = np.unique(bucket[order], return_index=True)
    return order, present, np.append(at, len(order))


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covering the given ones; starts ascend."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], reach[last]
