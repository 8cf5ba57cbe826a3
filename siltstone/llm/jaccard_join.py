"""N-gram Jaccard join by vertical partitioning.

Every document is the set of its word n-grams. The global n-gram order is cut into fragments; each fragment counts
partial overlaps on its own, and a pair's counts are summed over fragments. The steps:

1. Batches hash their n-grams and collapse documents with equal sets. Packed entries (n-gram, document) go to buckets
   of n-grams, which tell the n-grams that more than one set has. An n-gram that a batch has in several sets is settled
   there, and goes on as one entry: a frequent n-gram is one entry for each batch.
2. Documents with equal sets (two 64-bit sums and the size) are one class, whose smallest id represents it.
3. A set can only reach the threshold if enough of its n-grams are shared at all; most sets end here. The document
   frequencies among those left give the global order, rarest first, and each set's prefix: two sets that reach the
   threshold share an n-gram in both prefixes.
4. Prefix n-grams of few sets give pairs, at most HEAVY / 2 for each entry, that pass the size and position filters. Sets
   connected over n-grams that stand in more prefixes form groups; three quarters of such a set or more are frequent
   n-grams, as its prefix begins with its rarest. A group isn't spelt out in pairs: its sets are dealt into classes of
   size, classes into blocks, and blocks of classes that can link meet once.
5. Each fragment has its segment of every set and counts partial overlaps: of the pairs, and of all pairs of two blocks as
   one matrix. Counts are summed over fragments and compared with the threshold, in integers. All links are found; of a
   pair of blocks only as many are told as connect its sets, and how many each set has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import buckets_for, drop, salted, text_of, written

FRAGMENTS = 4
HEAVY = 32  # prefixes that an n-gram may stand in and still give pairs
BLOCK_SETS, BLOCK_GRAMS = 1 << 10, 1 << 19  # of a group's block, about
CELLS = 1 << 22  # of a matrix of sets and n-grams
ROW = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
ROW_SQL = "bucket int, kind string, a binary, b binary, c binary, d binary"


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of size n can reach the threshold with."""
    return -(-percent * n // 100)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(doc.astype(np.int64).view(K.U) + K.U(1)) >> K.U(20)).astype(np.int64) & (buckets - 1)


def _gram_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> K.U(44)).astype(np.int64) & (buckets - 1)


def _without_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes of one bucket without the bits that number it: fewer bits, in the same order."""
    return (((h >> K.U(43 + buckets.bit_length())) << K.U(44)) | (h & K.U((1 << 44) - 1))).view(np.int64)


def _with_bucket(x: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    x = x.view(K.U)
    return ((x >> K.U(44)) << K.U(43 + buckets.bit_length())) | K.U(bucket << 44) | (x & K.U((1 << 44) - 1))


def _rows(kind: str, bucket: np.ndarray, buckets: int, **columns):
    """Record batches of packed rows, one for each bucket. Columns of uint64 (hashes) are kept raw, others packed."""
    if not len(bucket):
        return
    order, present, bound = K.pieces_by(bucket, buckets)
    columns = {c: x[order] for c, x in columns.items()}
    for i in range(0, len(present), 256):
        cut = [slice(bound[k], bound[k + 1]) for k in range(i, min(i + 256, len(present)))]
        blobs = [pa.array([x[s].tobytes() if x.dtype == K.U else K.pack_ints(x[s]) for s in cut], pa.binary()) if (x := columns.get(c)) is not None else pa.nulls(len(cut), pa.binary()) for c in "abcd"]
        yield pa.record_batch([pa.array(present[i : i + 256], pa.int32()), pa.array([kind] * len(cut)), *blobs], schema=ROW)


def _table(batches) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=ROW)


def _read(t: pa.Table, kinds: tuple[str, ...], raw: str = "", packed: str = "") -> list[np.ndarray]:
    t = t.filter(pc.is_in(t["kind"], pa.array(kinds)))
    if not len(t):
        return [*(np.zeros(0, K.U) for _ in raw), *(np.zeros(0, np.int64) for _ in packed)]
    return [*(np.frombuffer(b"".join(t[c].to_pylist()), K.U) for c in raw), *(np.concatenate([K.unpack_ints(b) for b in t[c].to_pylist()]) for c in packed)]


def grams(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of each text, in order; a text of fewer words has one, all of them."""
    buf = K.LOWER[buf]
    starts, ends, first = K.words(buf, offsets, K.SPACES)
    w = K.hash_spans(buf, starts, ends)
    count = np.diff(first)
    n = np.maximum(count - width + 1, 0)
    text, h = np.repeat(np.arange(len(n)), n), K.windows(w, width, K.BASES[0])[K.ragged(first[:-1], n)] if n.any() else np.zeros(0, K.U)
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            text = np.append(text, short)
            h = np.append(h, K.mix(K.windows(w, k, K.BASES[1])[first[short]] + K.U(k)))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
    return text[new], h[new]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the first decides; the last is the order inside groups of all others), and where groups begin."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[:-1]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _shingle(width: int, buckets: int):
    @K.tidy
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, buf, offsets in K.texts(batch, "text"):
                doc = ids[i : i + len(offsets) - 1]
                text, h = grams(buf, offsets, width)
                n = np.bincount(text, minlength=len(doc))
                at = np.append(0, np.cumsum(n))
                s1, s2 = (np.append(K.U(0), np.cumsum(K.mix(h ^ b), dtype=K.U)) for b in K.BASES)
                s1, s2 = s1[at[1:]] - s1[at[:-1]], s2[at[1:]] - s2[at[:-1]]
                yield from _rows("member", _doc_bucket(doc[n == 0], buckets), buckets, b=doc[n == 0], c=n[n == 0], d=doc[n == 0])
                full = np.flatnonzero(n)
                order, begin = _groups(s1[full], s2[full], n[full], doc[full])
                order = full[order]
                head = np.repeat(order[begin], np.diff(np.append(begin, len(order))))
                copy = order != head
                yield from _rows("member", _doc_bucket(doc[order[copy]], buckets), buckets, b=doc[order[copy]], c=n[order[copy]], d=doc[head[copy]])
                rep = order[begin]
                yield from _rows("set", (s1[rep] >> K.U(40)).astype(np.int64) & (buckets - 1), buckets, a=s1[rep], b=doc[rep], c=n[rep], d=s2[rep])
                is_rep = np.zeros(len(doc), bool)
                is_rep[rep] = True
                keep = is_rep[text]
                h, owner = h[keep], doc[text[keep]]
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
                new = np.append(True, h[1:] != h[:-1])[: len(h)]
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(h)))
                shared = np.repeat(size > 1, size)
                yield from _rows("shared", _doc_bucket(owner[shared], buckets), buckets, a=h[shared], b=owner[shared])
                one, many = begin[size == 1], begin[size > 1]
                yield from _rows("gram", _gram_bucket(h[one], buckets), buckets, c=_without_bucket(h[one], buckets), b=owner[one])
                yield from _rows("settled", _gram_bucket(h[many], buckets), buckets, c=_without_bucket(h[many], buckets))

    return run


def _resolve(buckets: int):
    """Of a bucket: which n-grams several sets have; which sets are equal."""

    def run(t: pa.Table) -> pa.Table:
        out = [b for b in t.filter(pc.is_in(t["kind"], pa.array(["member", "shared"]))).cast(ROW).to_batches() if len(b)]
        bucket = t["bucket"][0].as_py()
        doc, h = _read(t, ("gram",), "", "bc")
        (settled,) = _read(t, ("settled",), "", "c")
        h, settled = _with_bucket(h, bucket, buckets), _with_bucket(settled, bucket, buckets)
        every, owner = np.append(h, settled), np.append(doc, np.zeros(len(settled), np.int64))
        mine = np.arange(len(every)) < len(h)
        order = np.argsort(every, kind="stable")
        s = every[order]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        size = np.diff(np.append(begin, len(s)))
        several = np.repeat(size, size) > 1
        # a settled n-gram is shared anyway; if only one batch settled it, its entries have gone on already
        pick = order[several]
        pick = pick[mine[pick]]
        out += _rows("shared", _doc_bucket(owner[pick], buckets), buckets, a=every[pick], b=owner[pick])
        s1, s2, doc, n = _read(t, ("set",), "ad", "bc")
        if len(doc):
            order, begin = _groups(s1, s2, n, doc)
            rep = doc[order][np.repeat(begin, np.diff(np.append(begin, len(order))))]
            doc, n = doc[order], n[order]
            out += _rows("rep", _doc_bucket(rep, buckets), buckets, b=doc, c=n, d=rep)
        return _table(out)

    return run


def _alive(percent: int):
    """Of a bucket of documents: the shared n-grams of class representatives that have enough of them.

    Rows on members and representatives go on as they are.
    """

    def run(t: pa.Table) -> pa.Table:
        through = [b for b in t.filter(pc.is_in(t["kind"], pa.array(["member", "rep"]))).cast(ROW).to_batches() if len(b)]
        doc, n, rep = _read(t, ("rep",), "", "bcd")
        own = doc == rep
        order = np.argsort(doc[own])
        doc, n = doc[own][order], n[own][order]
        h, owner = _read(t, ("shared",), "a", "b")
        at = np.minimum(np.searchsorted(doc, owner), max(len(doc) - 1, 0))
        if not len(doc) or not len(h):
            return _table(through)
        ok = doc[at] == owner
        h, at = h[ok], at[ok]
        good = np.bincount(at, minlength=len(doc)) >= _need(n, percent)
        keep = good[at]
        h, at = h[keep], at[keep]
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))[: len(h)]
        h, at = h[new], at[new]
        bucket = np.full(len(h), t["bucket"][0].as_py(), np.int64)
        return _table([*through, *_rows("alive", bucket, int(bucket.max(initial=0)) + 1, a=h, b=doc[at], c=n[at])])

    return run


def _local_counts(buckets: int):
    """Of each row of a bucket of documents: its n-grams with the number of its documents that have them."""

    def run(batches):
        for batch in batches:
            for bucket, a in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                h, size = np.unique(np.frombuffer(a, K.U), return_counts=True)
                yield from _rows("count", _gram_bucket(h, buckets), buckets, a=h, b=size, c=np.full(len(h), bucket))

    return run


def _frequencies(buckets: int):
    """Of a bucket of n-grams: the document frequencies over 1, sent back to the buckets of documents that have them."""

    def run(t: pa.Table) -> pa.Table:
        h, size, origin = _read(t, ("count",), "a", "bc")
        u, at = np.unique(h, return_inverse=True)
        df = np.bincount(at, size, minlength=len(u)).astype(np.int64)[at]
        keep = df > 1
        return _table(_rows("df", origin[keep], buckets, a=h[keep], b=df[keep]))

    return run


SETS_SQL = "doc long, n long, c long, grams array<long>, orders array<long>, prefix int"


def _sets(percent: int):
    """Of a bucket of documents: a row for each that still has enough shared n-grams, in the global order."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("grams", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())), ("prefix", pa.int32())])

    def run(t: pa.Table) -> pa.Table:
        h, doc, n = _read(t, ("alive",), "a", "bc")
        u, df = _read(t, ("df",), "a", "b")
        if not len(h) or not len(u):
            return schema.empty_table()
        order = np.argsort(u)
        u, df = u[order], df[order]
        at = np.minimum(np.searchsorted(u, h), len(u) - 1)
        ok = u[at] == h
        h, doc, n, df = h[ok], doc[ok], n[ok], df[at[ok]]
        order = np.lexsort((h, df, doc))
        h, doc, n, df = h[order], doc[order], n[order], df[order]
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)])
        if not len(begin):
            return schema.empty_table()
        c = np.diff(np.append(begin, len(doc)))
        good = c >= _need(n[begin], percent)
        # the place in the global order: frequency, then hash
        place = (np.minimum(df, (1 << 20) - 1) << 43) | (h >> K.U(21)).astype(np.int64)
        keep = np.repeat(good, c)
        bounds = pa.array(np.append(0, np.cumsum(c[good])), pa.int32())
        n, c, first = n[begin][good], c[good], doc[begin][good]
        return pa.table(
            [first, n, c, pa.ListArray.from_arrays(bounds, pa.array(h[keep].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(place[keep])), pa.array(c - _need(n, percent) + 1, pa.int32())],
            schema=schema,
        )

    return run


def _unpack(batches):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("parent", pa.int64())])
    for batch in batches:
        for b, c, d in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
            yield pa.record_batch([pa.array(K.unpack_ints(x)) for x in (b, c, d)], schema=schema)


def components(links: DataFrame) -> DataFrame:
    """doc, component: the smallest id reachable over links (a, b); documents without links are left out, so no links give
    no rows. Rows that repeat don't matter.

    Alternating large-star and small-star steps; each is an aggregate and a salted join, written out. Nothing is collected
    but two sums that tell whether anything has changed.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        edges = salted(both, least, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()  # large star
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        edges = salted(edges, least, "a", "b")
        edges = written(edges.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct(), "edges")  # small star
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None:
            drop(before)
        if now == seen or not now[0]:
            return edges.select(F.col("a").alias("doc"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen, before = now, edges


def _valid(percent: int):
    """The size and position filters for prefix entries of x and y."""
    alpha = F.expr(f"-((-{percent} * (x.n + y.n)) div {100 + percent})")
    alpha = F.when(alpha * (100 + percent) < (F.col("x.n") + F.col("y.n")) * percent, alpha + 1).otherwise(alpha)
    at = [F.col(f"{s}.n") - F.col(f"{s}.c") + F.col(f"{s}.pos") + alpha <= F.col(f"{s}.n") for s in "xy"]
    return (F.col("x.c") >= alpha) & (F.col("y.c") >= alpha) & at[0] & at[1]


def _prefixes(sets: DataFrame) -> DataFrame:
    """doc, n, c, pos, gram, held: the n-grams of the prefixes that stand in more than one, with the number of them."""
    entries = sets.select("doc", "n", "c", F.posexplode(F.expr("slice(grams, 1, prefix)")).alias("pos", "gram"))
    held = entries.groupBy("gram").agg(F.count("*").alias("held"), F.min("doc").alias("least")).filter("held > 1")
    return salted(entries, held, "gram", "doc")


def _groups_of(prefixes: DataFrame) -> DataFrame:
    """doc, component: sets connected over n-grams that stand in many prefixes."""
    return components(prefixes.filter(f"held > {HEAVY}").select(F.col("doc").alias("a"), F.col("least").alias("b")))


def _candidates(prefixes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that share an n-gram of few prefixes and pass the filters, but those of one group."""
    q = prefixes.filter(f"held <= {HEAVY}").join(groups, "doc", "left")
    near = q.alias("x").join(q.alias("y"), "gram").filter("x.doc < y.doc and not coalesce(x.component = y.component, false)").filter(_valid(percent))
    return near.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct()


def _segments(sets: DataFrame, fragments: int) -> DataFrame:
    """A row of sets for each fragment of the n-gram order, with the segment of the set's n-grams that lies in it."""
    sample = sets.filter(F.pmod(F.xxhash64("doc"), F.lit(8)) == 0).select(F.explode("orders").alias("o"))
    pivots = sample.agg(F.percentile_approx("o", [k / fragments for k in range(1, fragments)], 100)).first()[0] if fragments > 1 else []
    bounds = [None, *(pivots or [0] * (fragments - 1)), None]
    pairs = F.arrays_zip(F.col("grams").alias("g"), F.col("orders").alias("o"))

    def cut(lo, hi):
        inside = lambda x: (F.lit(True) if lo is None else x["o"] >= lo) & (F.lit(True) if hi is None else x["o"] < hi)
        return F.transform(F.filter(pairs, inside), lambda x: x["g"])

    return sets.withColumns({"segments": F.array(*[cut(lo, hi) for lo, hi in zip(bounds, bounds[1:])])}).drop("grams", "orders", "prefix").select("*", F.posexplode("segments").alias("fragment", "segment")).drop("segments")


def _count_pairs(sets: DataFrame, candidates: DataFrame, percent: int, fragments: int) -> DataFrame:
    """a, b, overlap of the candidates that link: partial counts of each fragment, summed."""
    segments = _segments(sets, fragments).filter(F.size("segment") > 0)
    a = segments.select(F.col("doc").alias("a"), F.col("n").alias("na"), "fragment", F.col("segment").alias("sa"))
    b = segments.select(F.col("doc").alias("b"), F.col("n").alias("nb"), "fragment", F.col("segment").alias("sb"))
    parts = candidates.join(a, "a").join(b, ["b", "fragment"])
    partial = parts.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("partial"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    return total.filter(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b", "overlap")


def _overlaps(flat: np.ndarray, size: np.ndarray, left: slice, right: slice) -> np.ndarray:
    """Common n-grams of each set of left with each of right; sets are runs of flat, of the given sizes."""
    owner = np.repeat(np.arange(len(size)), size)
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    several = count > 1
    keep = several[gram]
    owner, gram = owner[keep], (np.cumsum(several) - 1)[gram[keep]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    kind = np.float32 if size.max(initial=0) < 1 << 24 else np.float64
    sums = np.zeros((len(size[left]), len(size[right])), kind)
    width = max(64, CELLS // max(1, len(size)))
    for lo in range(0, int(several.sum()), width):
        at = slice(*np.searchsorted(gram, [lo, lo + width]))
        has = np.zeros((len(size), int(gram[at][-1]) - lo + 1), kind)
        has[owner[at], gram[at] - lo] = 1
        sums += has[left] @ has[right].T
    return sums.astype(np.int64)


PARTIAL = pa.schema([("bucket", pa.int64()), ("component", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("docs", pa.binary()), ("ns", pa.binary()), ("weights", pa.binary()), ("left", pa.int64()), ("counts", pa.binary())])
PARTIAL_SQL = "bucket long, component long, i long, j long, docs binary, ns binary, weights binary, left long, counts binary"


def _runs(*keys: np.ndarray):
    """Ranges of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    begin = np.flatnonzero(new)
    return zip(begin.tolist(), np.append(begin[1:], len(new)).tolist())


def _count_blocks(t: pa.Table) -> pa.Table:
    """Of one fragment, and a bucket of pairs of blocks: the partial overlaps of each pair of blocks as a matrix."""
    t = t.sort_by([(c, "ascending") for c in ("component", "i", "j", "block", "doc")])
    component, i, j, block, doc, n, weight = (t[c].to_numpy() for c in ("component", "i", "j", "block", "doc", "n", "weight"))
    segment = t["segment"].combine_chunks()
    flat, size = segment.flatten().to_numpy(), segment.value_lengths().to_numpy().astype(np.int64)
    place = np.append(0, np.cumsum(size))
    zip_ = zstandard.ZstdCompressor(level=1).compress
    rows: list[list] = [[] for _ in PARTIAL]
    for s, e in _runs(component, i, j):
        left = e - s if i[s] == j[s] else int(np.searchsorted(block[s:e], i[s], "right"))
        if not left or i[s] != j[s] and left == e - s:
            continue  # one of the blocks is empty
        x, y = slice(0, left), slice(0 if i[s] == j[s] else left, e - s)
        sums = _overlaps(flat[place[s] : place[e]], size[s:e], x, y).astype(np.uint32)
        blobs = *(K.pack_ints(c[s:e]) for c in (doc, n, weight)), zip_(sums.ravel().view(np.uint8).reshape(-1, 4).T.tobytes())
        for c, v in zip(rows, (t["bucket"][0].as_py(), component[s], i[s], j[s], *blobs[:3], left, blobs[3])):
            c.append(v)
    return pa.table([pa.array(c, f.type) for c, f in zip(rows, PARTIAL)], schema=PARTIAL)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of links (a, b) of 0 to n - 1 that connect what all of them connect: the smallest of a tree is its root."""
    root = np.arange(n)
    taken = np.zeros(len(a), bool)
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return np.flatnonzero(taken)
        hi, lo = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        order = np.lexsort((lo, hi))
        first = order[np.append(True, hi[order][1:] != hi[order][:-1])]
        taken[apart[first]] = True  # each tree but those with the smallest roots joins one with a smaller root
        root[hi[first]] = lo[first]
        while (up := root[root]).tolist() != root.tolist():
            root = up


def _sum_blocks(percent: int, pairs: bool):
    """Of a bucket of pairs of blocks: the sums over fragments, and what links. As pairs (a, b, overlap); or links that
    connect the same sets (a, b), and the weights that each set links with (a, null, weight)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("overlap", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("component", "i", "j")])
        unzip = zstandard.ZstdDecompressor().decompress
        out: list[tuple] = []
        none: list[np.ndarray] = []
        for s, e in _runs(*(t[c].to_numpy() for c in ("component", "i", "j"))):
            doc, n, weight = (K.unpack_ints(t[c][s].as_py()) for c in ("docs", "ns", "weights"))
            left, same = t["left"][s].as_py(), t["i"][s].as_py() == t["j"][s].as_py()
            x, y = np.arange(left), np.arange(0 if same else left, len(doc))
            sums = np.zeros(len(x) * len(y), np.int64)
            for k in range(s, e):
                sums += np.ascontiguousarray(np.frombuffer(unzip(t["counts"][k].as_py()), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            sums = sums.reshape(len(x), len(y))
            links = 100 * sums >= percent * (n[x][:, None] + n[y][None, :] - sums)
            if same:
                links = np.triu(links, 1)
            a, b = np.nonzero(links)
            if pairs:
                out.append((np.minimum(doc[x[a]], doc[y[b]]), np.maximum(doc[x[a]], doc[y[b]]), sums[a, b]))
                none.append(np.zeros(len(a), bool))
                continue
            few = _forest(x[a], y[b], len(doc))
            total = np.zeros(len(doc), np.int64)
            np.add.at(total, x, links @ weight[y])
            np.add.at(total, y, weight[x] @ links)
            some = np.flatnonzero(total)
            out.append((np.append(doc[x[a[few]]], doc[some]), np.append(doc[y[b[few]]], np.zeros(len(some), np.int64)), np.append(sums[a[few], b[few]], total[some])))
            none.append(np.append(np.zeros(len(few), bool), np.ones(len(some), bool)))
        a, b, value = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))
        return pa.table([pa.array(a), pa.array(b, mask=np.concatenate(none or [np.zeros(0, bool)])), pa.array(value)], schema=schema)

    return run


def _within(sets: DataFrame, groups: DataFrame, weights: DataFrame | None, percent: int, fragments: int, pairs: bool = False) -> DataFrame:
    """What links inside groups (doc, component); see _sum_blocks. Without weights each set weighs 1.

    Two sets only link if their sizes are in the same class of size or in neighbouring ones, so a group is dealt into
    classes, and a class into blocks by a hash. Pairs of blocks go to buckets, for each fragment on its own.
    """
    if groups.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long, overlap long")
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    kind = F.floor(F.log("n") / step).cast("long") if percent < 100 else F.col("n")
    own = sets.drop("prefix").join(groups, "doc").withColumn("kind", kind)
    own = own.join(weights, "doc") if weights is not None else own.withColumn("weight", F.lit(1).cast("long"))
    span = written(own.groupBy("component", "kind").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("c") / BLOCK_GRAMS)).cast("long").alias("blocks"), F.sum("c").alias("grams_of")), "span")
    beside = [span.select("component", (F.col("kind") + k).alias("kind"), F.col("blocks").alias(f"blocks_{k + 1}")) for k in (-1, 1)]
    near = span.join(beside[0], ["component", "kind"], "left").join(beside[1], ["component", "kind"], "left")  # a row for each class of a group
    buckets = max(64, int(span.agg(F.sum(F.col("grams_of") * F.col("blocks"))).first()[0] or 0) // BLOCK_GRAMS + 1)
    own = salted(own.withColumn("cell", F.struct("component", "kind")), near.select(F.struct("component", "kind").alias("cell"), "blocks", "blocks_0", "blocks_2"), "cell", "doc").drop("cell")
    of = lambda shift, count: F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.shiftleft(F.col("kind") + shift, 20) + k)).otherwise(F.array().cast("array<bigint>"))
    own = own.withColumn("block", F.shiftleft("kind", 20) + F.pmod(F.xxhash64("doc", F.lit(7)), "blocks"))
    # blocks_0: of the class above, whose rows were moved down by one; blocks_2: of the class below
    own = own.withColumn("other", F.explode(F.concat(of(0, F.col("blocks")), of(1, F.col("blocks_0")), of(-1, F.col("blocks_2")))))
    own = own.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    own = own.withColumn("bucket", F.pmod(F.xxhash64("component", "i", "j"), F.lit(buckets))).drop("other", "blocks", "blocks_0", "blocks_2", "kind", "c")
    parts = _segments(own, fragments).groupBy("bucket", "fragment").applyInArrow(K.tidy_group(_count_blocks), PARTIAL_SQL)
    return parts.groupBy("bucket").applyInArrow(K.tidy_group(_sum_blocks(percent, pairs)), "a long, b long, overlap long")


def _alone(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """n of each row without an id."""

    @K.tidy
    def run(batches):
        for batch in batches:
            for _, buf, offsets in K.texts(batch, "text"):
                text, _ = grams(buf, offsets, width)
                yield pa.record_batch([np.bincount(text, minlength=len(offsets) - 1).astype(np.int64)], ["n"])

    return text_of(docs.filter(F.col(id_col).isNull()), id_col, text_col).select("text").mapInArrow(run, "n long")


def similar_sets(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS, with_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, n_links: one row for each row of docs.

    A-Z is lowered; words are runs of other characters than space and \\x09 to \\x0D. The set of a document: its distinct
    n-grams of width words, or all its words as one if it has fewer. Documents without words (null, empty or blank text)
    have an empty set and link with nothing. Two sets link when 100 * |intersection| >= percent * |union|. class_id: the
    smallest id with an equal set; component_id: the smallest id reachable by links; n_links: the number of other ids it
    links with, equal sets among them (not there without with_links). Rows that repeat an id are expected to have the same
    text. Rows with a null id link with nothing, and their class and component are null. Other columns are ignored; an
    empty table gives no rows.
    """
    every, sets = _classes(docs, width, percent, id_col, text_col)
    weights = _weights(every) if with_links else None
    links, linked = _links(sets, weights, percent, fragments)
    labels = written(components(links), "labels")
    found = labels if weights is None else weights.join(linked, "doc", "left").join(labels, "doc", "left")  # a row for each class
    out = salted(every, found.withColumnRenamed("doc", "class_id"), "class_id", "doc", "left").withColumn("component", F.coalesce("component", "class_id"))
    columns = [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id")]
    none = F.lit(None).cast("long")
    alone = _alone(docs, width, id_col, text_col).select(none.alias("doc_id"), F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component_id"))
    if not with_links:
        return out.select(*columns).union(alone)
    out = out.select(*columns, (F.coalesce("linked", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).alias("n_links"))
    return out.union(alone.withColumn("n_links", F.lit(0).cast("long")))


def similar_pairs(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", fragments: int = FRAGMENTS) -> DataFrame:
    """a, b, overlap: all links of class representatives (see similar_sets), a < b, with their number of common n-grams.
    An empty table, or one without links, gives no rows."""
    _, sets = _classes(docs, width, percent, id_col, text_col)
    prefixes = written(_prefixes(sets), "prefixes")
    groups = written(_groups_of(prefixes), "groups")
    apart = _count_pairs(sets, written(_candidates(prefixes, groups, percent), "candidates"), percent, fragments)
    return apart.union(_within(sets, groups, None, percent, fragments, pairs=True))


def _links(sets: DataFrame, weights: DataFrame | None, percent: int, fragments: int) -> tuple[DataFrame, DataFrame | None]:
    """a, b of links that connect what all links connect; and doc, linked: the weights that each set links with."""
    prefixes = written(_prefixes(sets), "prefixes")
    groups = written(_groups_of(prefixes), "groups")
    candidates = written(_candidates(prefixes, groups, percent), "candidates")
    drop(prefixes)
    apart = written(_count_pairs(sets, candidates, percent, fragments), "links")
    drop(candidates)
    inside = written(_within(sets, groups, weights, percent, fragments), "inside")
    drop(sets, groups)
    links = apart.select("a", "b").union(inside.filter("b is not null").select("a", "b"))
    if weights is None:
        return links, None
    ways = apart.select("a", "b").union(apart.select("b", "a")).join(weights.withColumnRenamed("doc", "b"), "b").select(F.col("a").alias("doc"), F.col("weight").alias("linked"))
    linked = ways.union(inside.filter("b is null").select("a", "overlap")).groupBy("doc").agg(F.sum("linked").alias("linked"))
    return links, written(linked, "linked")


def _weights(every: DataFrame) -> DataFrame:
    """doc, weight: the number of ids in the class of a representative; empty sets are in none."""
    return every.filter("n > 0").groupBy(F.col("class_id").alias("doc")).agg(F.count_distinct("doc").alias("weight"))


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc, n, class_id of each row; and the sets of representatives that may link."""
    d = text_of(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    buckets = buckets_for(d, 2 << 20, least=64)
    rows = d.mapInArrow(_shingle(width, buckets), ROW_SQL)
    shared = rows.groupBy("bucket").applyInArrow(K.tidy_group(_resolve(buckets)), ROW_SQL)
    found = written(shared.groupBy("bucket").applyInArrow(K.tidy_group(_alive(percent)), ROW_SQL), "alive")
    alive = found.filter("kind = 'alive'")
    frequencies = alive.mapInArrow(_local_counts(buckets), ROW_SQL).groupBy("bucket").applyInArrow(K.tidy_group(_frequencies(buckets)), ROW_SQL)
    sets = written(alive.union(frequencies).groupBy("bucket").applyInArrow(K.tidy_group(_sets(percent)), SETS_SQL), "sets")
    unpacked = lambda kind: found.filter(F.col("kind") == kind).mapInArrow(_unpack, "doc long, n long, parent long")
    reps, members = unpacked("rep"), unpacked("member")
    empty = members.filter("n = 0").select("doc", "n", F.col("doc").alias("class_id"))
    copies = members.filter("n > 0").join(reps.select(F.col("doc").alias("parent"), F.col("parent").alias("class_id")).distinct(), "parent").select("doc", "n", "class_id")
    every = written(empty.union(copies).union(reps.select("doc", "n", F.col("parent").alias("class_id"))), "classes")
    drop(found)
    return every, sets


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of linked sets, the one with the smallest id; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    found = similar_sets(docs, **options, with_links=False).filter("doc_id != component_id").select(F.col("doc_id").alias("__copy_id"))
    return docs.join(found, docs[id_col].cast("long") == found["__copy_id"], "left_anti").select(*docs.columns)
