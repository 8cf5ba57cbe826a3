"""Exact dedup by a minimal perfect hash over historical distinct digests.

The digests of the history are dealt into buckets; each bucket holds a minimal perfect hash whose slots keep the full
digest, the locator of the row that wins so far, and the number of copies. New digests, one row for each distinct one,
are looked up in their bucket and compared byte for byte with the slot's; members join the historical class, all others
are grouped separately. Both sides hold a digest once, as they are aggregated before the shuffle, so a group of copies
of any size costs a bucket one row. Rows get their class back by a join on the digest; the few digests that more than a
thousandth of all rows have, of which there can't be more than a thousand, are broadcast to their rows instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, text_of, written

FREQUENT = 1_000  # digests that more rows than one in so many have are broadcast
LEVEL_LOAD = 1.5  # positions of a level for each key that is left
LEVELS = 64


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each 32-byte digest; digests are uniform, so no further hash is needed."""
    w = np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)
    return w[:, 1], w[:, 2]


def _position(keys: tuple[np.ndarray, np.ndarray], level: int, size: int) -> np.ndarray:
    h = keys[0] + np.uint64(level) * (keys[1] | np.uint64(1))
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(20)) % np.uint64(size)


class MinimalPerfectHash:
    """Levels of bits: a key sits in the first level where no other key shares its position; its rank there numbers it.

    Maps n keys to 0 .. n - 1. Other keys map to -1 or to some slot, so slots must hold the key. A level is a vector of
    bits in words, and the number of bits set before each word: three bits for each position.
    """

    def __init__(self, digests: np.ndarray) -> None:
        keys = _keys(digests)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        before = 0
        for level in range(LEVELS):
            n = len(keys[0])
            if not n:
                return
            size = int(n * LEVEL_LOAD) + 1
            at = _position(keys, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, before + np.cumsum(ones) - ones))
            before += int(ones.sum())
            stay = ~alone[at]
            keys = keys[0][stay], keys[1][stay]
        raise ValueError("digests repeat")

    def slot(self, digests: np.ndarray) -> np.ndarray:
        keys = _keys(digests)
        out = np.full(len(keys[0]), -1, np.int64)
        left = np.arange(len(out))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = _position((keys[0][left], keys[1][left]), level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            here = (words[word] & bit) > 0
            out[left[here]] = ranks[word[here]] + np.bitwise_count(words[word[here]] & (bit[here] - np.uint64(1)))
            left = left[~here]
        return out


def _digests(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)


def _winners(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Locators of the winners, and where there is one: rows without an id don't win."""
    col = t["winner"].combine_chunks()
    return col.fill_null(NO_ID).to_numpy().copy(), col.is_valid().to_numpy(zero_copy_only=False).copy()


CLASSES = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("historical", pa.bool_())])
NO_ID = -(1 << 63)


def _look_up(history: pa.Table, new: pa.Table) -> pa.Table:
    """The classes of a bucket's digests, historical ones and others."""
    digests, (winner, known), size = _digests(history["digest"]), _winners(history), history["size"].to_numpy()
    mph = MinimalPerfectHash(digests)
    at = mph.slot(digests)
    # the slots: full digests, winner locators, sizes
    order = np.argsort(at)
    held, winner, known, size = digests[order], winner[order], known[order], size[order]
    digests, (new_winner, new_known), new_size = _digests(new["digest"]), _winners(new), new["size"].to_numpy()
    at = mph.slot(digests)
    member = at >= 0
    member[member] = (held[at[member]] == digests[member]).all(axis=1)  # byte check
    np.maximum.at(winner, at[member], new_winner[member])
    np.logical_or.at(known, at[member], new_known[member])
    np.add.at(size, at[member], new_size[member])
    out = [*map(bytes, held), *map(bytes, digests[~member])]
    keep = pa.array(np.append(winner, new_winner[~member]), mask=~np.append(known, new_known[~member]))
    return pa.table([pa.array(out, pa.binary()), keep, np.append(size, new_size[~member]), np.arange(len(out)) < len(held)], schema=CLASSES)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the UTF-8 text, null as empty)."""
    d = text_of(docs, id_col, text_col)
    return d.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def distinct(rows: DataFrame) -> DataFrame:
    """digest, winner, size: of equal texts the row with the largest id wins."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))


def classes(history: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """digest, keep_id, group_size, historical of every distinct digest of the two frames of (digest, winner, size)."""
    by = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % buckets
    return (
        history.withColumn("bucket", by)
        .groupBy("bucket")
        .cogroup(new.withColumn("bucket", by).groupBy("bucket"))
        .applyInArrow(_look_up, "digest binary, keep_id long, group_size long, historical boolean")
    )


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, historical: one row for each row of docs.

    history: rows seen before, with the same columns; where it is None, the lower half of docs' id range is the history
    and is answered for too. Of equal texts, the row with the largest id stays (among rows with that id all are kept:
    ids are expected to be unique). A row with a null id goes if a row with an id has its text, and stays, with a null
    keep_id, if none has. Null is an empty text; empty texts are equal to each other. An empty table gives no rows.
    Columns other than the id and the text are ignored.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    lo, hi, n_rows = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if history is None:
        cut = ((lo or 0) + (hi or 0)) // 2
        old, new = rows.filter(F.col("doc_id") <= cut), rows.filter(F.coalesce(F.col("doc_id") > cut, F.lit(True)))
        buckets = buckets_for(docs, 4 << 20)
    else:
        old, new = digests(history, id_col, text_col), rows
        buckets = max(buckets_for(docs, 4 << 20), buckets_for(history, 4 << 20))
    found = written(classes(distinct(old), distinct(new), buckets), "classes")
    least = n_rows // FREQUENT
    kept = found.withColumnsRenamed({"digest": "of"})
    few, many = (kept.filter(f"group_size {sign} {least}") for sign in (">", "<="))
    if history is not None:  # a class may be large by its history alone
        few = few.join(rows.groupBy("digest").agg(F.count("*").alias("n")).filter(f"n > {least}"), F.col("of") == F.col("digest"), "left_semi")
        many = kept.join(few.select("of"), "of", "left_anti").select(kept.columns)
    few = F.broadcast(few)  # less than FREQUENT rows
    same = F.col("digest") == F.col("of")
    out = rows.join(few, same).unionByName(rows.join(few, same, "left_anti").join(many, same))
    stays = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical")
