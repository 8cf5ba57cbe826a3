"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, met in Spark's groups.

Each batch of documents hashes all its windows with a rolling hash and settles repeats among its own documents at once;
of each window hash it ships one occurrence set, that of the smallest document that has it. Packed blocks of (hash,
document, position) go to buckets drawn from a second, independent rolling hash, so the bucket number adds to the 64
bits compared. Spark groups the blocks by bucket, and a bucket finds the windows that a smaller document holds too, by
one sort of its hashes in numpy: a row of Spark's for each window would be many times the input in shuffle. The repeated windows of a document merge
into maximal removal intervals. A window that a third of all documents share is one row for each batch in its bucket.

Hash equality stands for equality of windows: 64 bits and the bucket's (8 to 20). Rows read: the text goes through one
shuffle, to meet its intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import buckets_for, text_of

BLOCK = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("starts", pa.binary())])


def _first_holder(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by (hash, document), and where, in that order, a smaller document has the same hash."""
    order = np.lexsort((doc, h)) if len(h) < 2 or (np.diff(doc) < 0).any() else np.argsort(h, kind="stable")
    hs, h2s, ds = h[order], h2[order], doc[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (h2s[1:] != h2s[:-1]))[: len(hs)]
    first = ds[np.maximum.accumulate(np.where(new, np.arange(len(hs)), 0))] if len(hs) else ds
    return order, ds != first


def _by_doc(doc: np.ndarray, start: np.ndarray) -> pa.Table:
    """A row for each document, with its window starts."""
    if not len(doc):
        return SPANS.empty_table()
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    blobs = [K.pack_ints(x) for x in np.split(start, at[1:])]
    return pa.table([pa.array(doc[at], pa.int64()), pa.array(blobs, pa.binary())], schema=SPANS)


def _hash_windows(buckets: int, width: int):
    @K.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, buf, offsets in K.texts(batch, "text", 8 << 20):
                starts, ends, first = K.words(buf, offsets, K.SPACES)
                if len(starts) < width:
                    continue
                w = K.hash_spans(buf, starts, ends)
                del starts, ends
                n = np.maximum(np.diff(first) - width + 1, 0)
                at = K.ragged(first[:-1], n)
                if not len(at):
                    continue
                start = (at - np.repeat(first[:-1], n)).astype(np.int32)
                doc = np.repeat(ids[i : i + len(n)], n)
                h, h2 = (K.windows(x, width, b)[at] for x, b in ((w, K.BASES[0]), (w ^ (w >> K.U(31)), K.BASES[1])))
                bucket = (h2 >> K.U(40)).astype(np.int64) & (buckets - 1)
                order, repeat = _first_holder(h, bucket, doc)
                hit = order[repeat]
                for x in _by_doc(doc[hit], start[hit]).to_batches():
                    k = len(x)
                    yield pa.record_batch([pa.array((x["doc_id"].to_numpy() * 2654435761 >> 7) & (buckets - 1), pa.int32()), x["doc_id"], pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), x["starts"]], schema=BLOCK)
                keep = np.sort(order[~repeat])
                h, bucket, doc, start = h[keep], bucket[keep], doc[keep], start[keep]
                order, present, bound = K.pieces_by(bucket, buckets)
                h, doc, start = h[order], doc[order], start[order]
                for a in range(0, len(present), 256):
                    part = range(a, min(len(present), a + 256))
                    cut = [slice(bound[k], bound[k + 1]) for k in part]
                    yield pa.record_batch(
                        [pa.array(present[a : a + 256], pa.int32()), pa.nulls(len(cut), pa.int64()), pa.array([h[c].tobytes() for c in cut], pa.binary()), pa.array([K.pack_ints(doc[c]) for c in cut], pa.binary()), pa.array([K.pack_ints(start[c]) for c in cut], pa.binary())],
                        schema=BLOCK,
                    )

    return run


def _repeats(block: pa.Table) -> pa.Table:
    """Of a bucket: the windows that a document with a smaller id has too, and what batches settled before."""
    settled = block["hashes"].combine_chunks().is_null()
    done = block.filter(settled).select(["doc_id", "starts"]).cast(SPANS)
    block = block.filter(pa.compute.invert(settled))
    if not len(block):
        return done
    h = np.frombuffer(b"".join(block["hashes"].to_pylist()), K.U)
    doc, start = (np.concatenate([K.unpack_ints(b) for b in block[c].to_pylist()]) for c in ("docs", "starts"))
    order, repeat = _first_holder(h, np.zeros(len(h), bool), doc)
    hit = order[repeat]
    return pa.concat_tables([done, _by_doc(doc[hit], start[hit])])


def window_starts(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, starts (packed): windows of docs (doc_id, text) whose words a smaller document has in one run too, in as
    many rows for a document as it has buckets with such windows.

    Rows without an id, null texts and texts of fewer than width words have no windows; an empty table gives no rows.
    """
    buckets = buckets_for(docs, 2 << 20, least=256)
    blocks = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_hash_windows(buckets, width), "bucket int, doc_id long, hashes binary, docs binary, starts binary")
    return blocks.groupBy("bucket").applyInArrow(K.tidy_group(_repeats), "doc_id long, starts binary")


def _cut(width: int, with_text: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * with_text])

    @K.tidy
    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names]
            parts = batch.column(batch.schema.get_field_index("parts"))
            ids = batch.column(0)
            for i, buf, offsets in K.texts(batch, "text"):
                starts, ends, first = K.words(buf, offsets, K.SPACES)
                for k in range(len(offsets) - 1):
                    s, e = starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]
                    spans = np.zeros((0, 2), np.int64)
                    blobs = parts[i + k].as_py()
                    stay = np.ones(len(s), bool)
                    if blobs:
                        at = np.sort(np.concatenate([K.unpack_ints(b) for b in blobs]))
                        lo, hi = K.merge_spans(at, at + width)
                        spans = np.stack([lo, hi], axis=1)
                        edge = np.zeros(len(s) + 1, np.int64)
                        np.add.at(edge, lo, 1)
                        np.add.at(edge, hi, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                    s, e = s[stay], e[stay]
                    # each word and the one byte after it, that byte made a space
                    at = K.ragged(s, e - s + 1)
                    kept = np.full(len(at), 32, np.uint8)
                    inner = np.ones(len(at), bool)
                    if len(at):
                        inner[np.cumsum(e - s + 1) - 1] = False
                    kept[inner] = buf[at[inner]]
                    kept = kept[:-1].tobytes()
                    for c, v in zip(rows, (ids[i + k].as_py(), len(stay), int((~stay).sum()), spans.ravel().tolist(), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, schema.types)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, width: int = 50, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (begin and end words of the maximal intervals, flat), kept_sha256 (, kept_text).

    Words are the runs of other characters than space and \\x09 to \\x0D. A word goes if it lies in a window of width
    words that also starts in a document with a smaller id; what is judged is the input, not what is left, and repeats
    inside one document stay. A null or empty text has no words; so has one with fewer words than a window nothing to
    remove. Rows with a null id are returned whole and matched with nothing. Ids are expected to be unique; equal ids
    are one document to the rule. Columns other than the id and the text are ignored; an empty table gives no rows.
    """
    d = text_of(docs, id_col, text_col)
    found = window_starts(d, width).groupBy("doc_id").agg(F.collect_list("starts").alias("parts"))
    out = "doc_id long, n_words long, n_removed long, spans array<long>, kept_sha256 string" + ", kept_text string" * with_text
    return d.join(found, "doc_id", "left").select("doc_id", "text", "parts").mapInArrow(_cut(width, with_text), out)
