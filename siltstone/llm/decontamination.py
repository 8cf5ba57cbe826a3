"""Benchmark decontamination by a distributed positional inverted index.

Index: documents are dealt into shards of bounded size; a shard stores, for each of its terms, the ascending positions
(postings) in the shard's run of words, and where its documents begin. Shards are written to the shared folder.
Search: phrases (windows of benchmark items) are cut in tasks and visit every shard, a bounded block of phrases at a
time; what a block finds is written before the next one begins. Phrases with a term that the shard lacks drop out at once;
for the others, the postings of the rarest term, moved to the phrase's begin, are intersected with the moved lists of the
other terms, rarest first. What is left are the occurrences, where terms are words by 64-bit hashes. With slop, a term
may stand so many places off: proximity matches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of, written

WINDOW = 13
#: Phrases of a block: a block is what a task gets at once, whatever the benchmark's size.
BLOCK_PHRASES = 1 << 17
#: Phrases of a row of the table of phrases.
ROW_PHRASES = 1 << 14
#: Candidate begins that are intersected at once.
STEP = 1 << 20
INDEX_SQL = "docs array<long>, firsts binary, terms binary, counts binary, postings binary"
#: Rows of documents (n_words) and of their hits; a document is its place in its shard, so ids may be null or repeat.
HITS = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.int64()), ("begins", pa.binary()), ("ends", pa.binary())])
HITS_SQL = "shard long, place long, doc_id long, n_words long, item_id long, begins binary, ends binary"
GAP = 64  # places between documents, so that no match reaches from one into the next


@K.tidy
def _index(batches):
    schema = pa.schema([("docs", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("firsts", "terms", "counts", "postings"))])
    zip_ = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        ids = batch.column(0)
        for i, buf, offsets in K.texts(batch, "text"):
            buf = K.LOWER[buf]
            starts, ends, first = K.words(buf, offsets, K.NOT_ALNUM)
            h = K.hash_spans(buf, starts, ends)
            n = len(first) - 1
            own = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.slice(i, n))
            position = np.arange(len(h)) + GAP * np.repeat(np.arange(n), np.diff(first))
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)
            yield pa.record_batch([own, [K.pack_ints(first)], [zip_(terms.tobytes())], [K.pack_ints(counts)], [K.pack_ints(position[order])]], schema=schema)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): a row for each shard of a few MB of text, none for an empty table."""
    return written(docs.mapInArrow(_index, INDEX_SQL).withColumn("shard", F.monotonically_increasing_id()), "index")


class Phrases:
    """Phrases as rows of term hashes; shorter ones are padded and know their length."""

    def __init__(self, item: np.ndarray, terms: np.ndarray, length: np.ndarray) -> None:
        self.item, self.terms, self.length = item, terms, length


PHRASES_SQL = "n long, items binary, terms binary, lengths binary"


def _cut_phrases(width: int):
    """The phrases of items (item_id, text), in rows of a bounded number."""
    schema = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("items", "terms", "lengths"))])

    @K.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, buf, offsets in K.texts(batch, "text"):
                buf = K.LOWER[buf]
                starts, ends, first = K.words(buf, offsets, K.NOT_ALNUM)
                h = np.append(K.hash_spans(buf, starts, ends), np.zeros(width, K.U))
                words = np.diff(first)
                many = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
                item, length = np.repeat(ids[i : i + len(words)], many), np.repeat(np.minimum(words, width), many)
                at = K.ragged(first[:-1], many)
                for k in range(0, len(at), ROW_PHRASES):
                    own = slice(k, k + ROW_PHRASES)
                    terms = np.lib.stride_tricks.sliding_window_view(h, width)[at[own]]
                    terms = np.where(np.arange(width) < length[own][:, None], terms, K.U(0))
                    yield pa.record_batch([[len(terms)], [K.pack_ints(item[own])], [terms.tobytes()], [K.pack_ints(length[own])]], schema=schema)

    return run


def phrase_blocks(items: DataFrame, width: int):
    """Blocks of the phrases of items (item_id, text), each of about BLOCK_PHRASES at most; none of an empty table."""
    block, n = [], 0
    for row in written(items.mapInArrow(_cut_phrases(width), PHRASES_SQL), "phrases").toLocalIterator():
        block.append(row)
        n += row["n"]
        if n >= BLOCK_PHRASES:
            yield _block(block, width)
            block, n = [], 0
    if block:
        yield _block(block, width)


def _block(rows: list, width: int) -> Phrases:
    item, length = (np.concatenate([K.unpack_ints(r[c]) for r in rows]) for c in ("items", "lengths"))
    return Phrases(item, np.frombuffer(b"".join(r["terms"] for r in rows), K.U).reshape(-1, width), length)


def _match(terms, counts, postings, phrases: Phrases, slop: int):
    """(phrase number, begin) of the matches in a shard."""
    if not len(terms) or not len(phrases.item):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = phrases.terms.shape[1]
    real = np.arange(width) < phrases.length[:, None]
    at = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    there = (terms[at] == phrases.terms) | ~real
    alive = np.flatnonzero(there.all(axis=1))
    frequency = np.where(real[alive], counts[at[alive]], np.iinfo(np.int64).max)
    by_rarity = np.argsort(frequency, axis=1, kind="stable")
    begin = np.append(0, np.cumsum(counts))
    # postings of all terms as one ascending list: term number, then position
    reach = int(postings.max(initial=0)) + 4 * GAP
    keyed = np.repeat(np.arange(len(terms)), counts) * reach + postings
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rarest = by_rarity[:, 0]
    lists = counts[at[alive, rarest]]
    bounds = np.append(0, np.cumsum(lists))
    lo = 0
    while lo < len(alive):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, "right")) - 1)
        which = np.repeat(np.arange(lo, hi), lists[lo:hi])
        start = postings[K.ragged(begin[at[alive[lo:hi], rarest[lo:hi]]], lists[lo:hi])] - rarest[which]
        keep = start >= 0
        which, start = which[keep], start[keep]
        for rank in range(1, width):
            if not len(which):
                break
            j = by_rarity[which, rank]
            due = real[alive[which], j]
            key = at[alive[which], j] * reach + start + j
            near = np.searchsorted(keyed, key - slop)
            ok = ~due | ((near < len(keyed)) & (keyed[np.minimum(near, len(keyed) - 1)] <= key + slop))
            which, start = which[ok], start[ok]
        found.append((alive[which], start))
        lo = hi
    return np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64), np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)


def _unpacked(batch: pa.RecordBatch):
    """shard, ids (which may be null), firsts, and the rest of each row of the index."""
    for k in range(len(batch)):
        docs, firsts, terms, counts, postings, shard = (batch.column(c)[k] for c in range(6))
        yield shard.as_py(), docs.values, K.unpack_ints(firsts.as_py()), (terms, counts, postings)


@K.tidy
def _documents(batches):
    """A row for each document, with its number of words."""
    for batch in batches:
        for shard, docs, firsts, _ in _unpacked(batch):
            n = len(docs)
            none = pa.nulls(n, pa.binary())
            yield pa.record_batch([np.full(n, shard), np.arange(n), docs, np.diff(firsts), pa.nulls(n, pa.int64()), none, none], schema=HITS)


def _search(shared, slop: int):
    """A row for each document and item that meet, with the intervals of the hits. shared: a broadcast block of phrases."""

    @K.tidy
    def run(batches):
        phrases: Phrases = shared.value
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, docs, firsts, (terms, counts, postings) in _unpacked(batch):
                terms, counts, postings = np.frombuffer(unzip(terms.as_py()), K.U), K.unpack_ints(counts.as_py()), K.unpack_ints(postings.as_py())
                which, start = _match(terms, counts, postings, phrases, slop)
                if not len(which):
                    continue
                shifted = firsts[:-1] + GAP * np.arange(len(docs))
                doc = np.searchsorted(shifted, start, "right") - 1
                begin, end = start - shifted[doc], start - shifted[doc] + phrases.length[which]
                if slop:  # a match may begin before its document or end after it
                    begin, end = np.maximum(begin - slop, 0), np.minimum(end + slop, np.diff(firsts)[doc])
                order = np.lexsort((begin, phrases.item[which], doc))
                doc, item, begin, end = doc[order], phrases.item[which][order], begin[order], end[order]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
                lo, hi = np.split(begin, new[1:]), np.split(end, new[1:])
                merged = [K.merge_spans(a, b) for a, b in zip(lo, hi)]
                place, n = doc[new], len(new)
                yield pa.record_batch([np.full(n, shard), place, docs.take(pa.array(place)), pa.nulls(n, pa.int64()), item[new], [K.pack_ints(a) for a, _ in merged], [K.pack_ints(b) for _, b in merged]], schema=HITS)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.int64())), ("items_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _sum_up(t: pa.Table) -> pa.Table:
    """Of one document: hit words and items, over all blocks of phrases."""
    own = t["item_id"].is_null().to_numpy()
    n_words = t["n_words"][int(np.flatnonzero(own)[0])].as_py()
    hits = t.filter(pa.array(~own))
    items = sorted(set(hits["item_id"].to_pylist()))
    lo, hi = (np.concatenate([K.unpack_ints(b) for b in hits[c].to_pylist()]) for c in ("begins", "ends"))
    order = np.argsort(lo)
    lo, hi = K.merge_spans(lo[order], hi[order])
    digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    return pa.Table.from_arrays([pa.array([x], k) for x, k in zip((t["doc_id"][0].as_py(), n_words, int((hi - lo).sum()), len(items), items, digest, np.stack([lo, hi], 1).ravel().tolist()), RESULT.types)], schema=RESULT)


def _finish(batches):
    """The same for documents in order: rows of a document are neighbours."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        shard, place = t["shard"].to_numpy(), t["place"].to_numpy()
        begin = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (place[1:] != place[:-1]))) if len(t) else np.zeros(0, np.int64)
        if not len(begin):
            continue
        yield from _rows_of(t, begin[:-1], np.diff(begin))
        rest = t.slice(begin[-1])
    if rest is not None and len(rest):
        yield from _rows_of(rest, np.zeros(1, np.int64), np.array([len(rest)]))


NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _rows_of(t: pa.Table, begin: np.ndarray, sizes: np.ndarray):
    plain = begin[sizes == 1]  # no hits
    if len(plain):
        p = t.take(pa.array(plain))
        n = len(p)
        zero = np.zeros(n, np.int64)
        empty = pa.array([[]] * n, pa.list_(pa.int64()))
        yield pa.record_batch([p["doc_id"].combine_chunks(), p["n_words"].combine_chunks(), zero, zero, empty, [NO_ITEMS] * n, empty], schema=RESULT)
    hit = [_sum_up(t.slice(b, s)) for b, s in zip(begin, sizes) if s > 1]
    if hit:
        yield from pa.concat_tables(hit).to_batches()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, spans, contaminated: one row for each row of docs.

    A-Z is lowered; words are runs of ASCII digits and letters and of other characters beyond ASCII. A phrase: width
    consecutive words of an item; an item of fewer words, but not none, is one phrase. Words inside an occurrence are
    hit; contaminated: share * n_hit >= n_words > 0 with a hit. spans: begin and end words of the hit intervals, flat.
    Null is an empty text; a document without words has no hits. Ids may be null or repeat: each row is judged on its own.
    Items with a null id or text are passed over; items that repeat are counted once for each id. Other columns are
    ignored; an empty table gives no rows, an empty benchmark no hits. With slop, a phrase's words may each stand that
    many places off, and spans are that much wider. Words are compared by 64-bit hashes.
    The driver passes blocks of phrases on, each of bounded size.
    """
    index = build_index(text_of(docs, id_col, text_col))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null and text is not null")
    rows = index.mapInArrow(_documents, HITS_SQL)
    for block in phrase_blocks(items, width):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.union(written(index.mapInArrow(_search(shared, slop), HITS_SQL), "hits"))
        shared.unpersist()
    out = rows.repartition("shard", "place").sortWithinPartitions("shard", "place").mapInArrow(_finish, "doc_id long, n_words long, n_hit long, n_items long, items array<long>, items_sha256 string, spans array<long>")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, with their columns; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    bad = decontaminate(docs, benchmark, **options).filter("contaminated").select(F.col("doc_id").alias("__bad_id"))
    return docs.join(bad, docs[id_col].cast("long") == bad["__bad_id"], "left_anti").select(*docs.columns)
