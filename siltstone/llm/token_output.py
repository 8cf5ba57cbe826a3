"""Token-ID output: documents as ids of a public tokenizer, in Simple-8b files.

Documents are range-sorted by id; each partition writes one file. A file: words of the blocks, then the table of
documents (id and number of ids), the table of blocks (words and escapes of each), and a footer with their sizes, all
little-endian. So blocks stream to the file, and the offset of any block is a sum over its table. Ids of a file are one
run: a block ends where it is full, not where a document ends.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import kernels as K
from . import simple8b
from .common import scratch_path, size_in_bytes, text_of, written
from .files import new_file, open_file

MAGIC = b"S8BTOKS2"
FOOTER = struct.Struct("<qqqqq8s")  # words, documents, those of them without an id, ids, blocks, magic
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
FILE_BYTES = 16 << 20
CACHED_PIECES = 1_200_000
SLOTS = 1 << 21
_LETTER, _DIGIT = K.byte_set((0x41, 0x5A), (0x61, 0x7A)), K.byte_set((0x30, 0x39))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], K.U)  # of the lowest k bytes
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where any text may be cut without changing its ids: the pre-tokenizer's pieces end there by its pattern.

    Before a space that a visible character follows, behind a single line feed between visible characters, and between a
    letter and a mark of ASCII. Visible: printable ASCII, or a letter of the Latin-1 block. No cut near "<" behind white
    space, where a special token begins, nor before "|", which ends the name of one.
    """
    n = len(buf)
    printable = (buf > 0x20) & (buf < 0x7F)
    latin = buf == 0xC3
    ahead = np.zeros(n, bool)
    ahead[:-1] = printable[1:]
    ahead_latin = np.zeros(n, bool)
    ahead_latin[:-1] = latin[1:]
    behind = np.zeros(n, bool)
    behind[1:] = printable[:-1]
    behind_any = behind.copy()
    behind_any[2:] |= latin[:-2]
    angle = np.zeros(n, bool)
    angle[:-1] = buf[1:] == 0x3C
    letter = _LETTER[buf]
    mark = printable & ~letter & ~_DIGIT[buf] & (buf != 0x7C)
    letter[1:] |= latin[:-1] & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
    cut = np.zeros(n + 1, bool)
    cut[:-1] = (buf == 0x20) & ((ahead & (~angle | behind)) | (ahead_latin & behind_any))
    cut[1:] |= (buf == 0x0A) & behind & ((ahead & ~angle) | ahead_latin)
    cut[1:-1] |= letter[:-1] & mark[1:]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by the tokenizer; each distinct piece is encoded once and kept, up to a number of pieces.

    Pieces of up to 16 bytes are kept in an open table under their own bytes, as two words and a length, so a piece that
    is found is the same piece. Longer ones are kept in a dictionary.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.held, self.n_ids = 0, 0
        self.number = np.full(SLOTS, -1, np.int32)  # of the piece that sits in a slot
        self.low, self.high, self.size = (np.zeros(CACHED_PIECES, k) for k in (K.U, K.U, np.uint8))
        self.at, self.counts = np.zeros(CACHED_PIECES, np.int64), np.zeros(CACHED_PIECES, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.long: dict[bytes, int] = {}

    def _encode_pieces(self, pieces: list[str]) -> np.ndarray:
        """Encode and keep new pieces; their numbers."""
        flat: list[int] = []
        counts: list[int] = []
        for i in range(0, len(pieces), 4096):
            for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                flat += ids
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        mine = np.arange(self.held, self.held + len(pieces))
        self.counts[mine] = counts
        self.at[mine] = self.n_ids + np.cumsum(counts) - counts
        self.n_ids += len(flat)
        self.held += len(pieces)
        return mine

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces that are kept (others -1), and the slots where the search ended."""
        slot = (K.mix(low ^ (high * K.BASES[0]) ^ (size.astype(K.U) * K.BASES[1])) & K.U(SLOTS - 1)).astype(np.int64)
        out = self.number[slot]
        left = np.flatnonzero((out >= 0) & ~((self.low[out] == low) & (self.high[out] == high) & (self.size[out] == size)))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            k = self.number[slot[left]]
            out[left] = k
            left = left[(k >= 0) & ~((self.low[k] == low[left]) & (self.high[k] == high[left]) & (self.size[k] == size[left]))]
        return out, slot

    def _put(self, numbers: np.ndarray, slot: np.ndarray) -> None:
        """Let new pieces into the table, from the slots on where their search ended."""
        while len(numbers):
            free = self.number[slot] < 0
            self.number[slot[free]] = numbers[free]  # of several, the last one stays
            rest = np.flatnonzero(self.number[slot] != numbers)
            numbers, slot = numbers[rest], (slot[rest] + 1) & (SLOTS - 1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        bounds = _cuts(buf, offsets)
        bounds = bounds[(bounds >= offsets[0]) & (bounds <= offsets[-1])]
        starts, size = bounds[:-1], np.diff(bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        raw = buf.tobytes() + bytes(16)
        number = np.empty(len(starts), np.int64)
        for s in range(0, len(starts), CACHED_PIECES // 2):  # so many fit at least
            part = slice(s, s + CACHED_PIECES // 2)
            if self.held + len(starts[part]) > CACHED_PIECES:
                new = len(self._numbers(raw, starts[part], size[part], number[part], count_only=True))
                if self.held + new > CACHED_PIECES:
                    ids, counts = self._taken(number[:s])
                    self._forget()
                    rest = self.encode(buf[bounds[s] :], np.maximum(offsets - bounds[s], 0))
                    per_text = self._per_text(bounds[: s + 1], counts, np.minimum(offsets, bounds[s]))
                    return np.append(ids, rest[0]), per_text + rest[1]
            self._numbers(raw, starts[part], size[part], number[part])
        ids, counts = self._taken(number)
        return ids, self._per_text(bounds, counts, offsets)

    def _taken(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[number].astype(np.int64)
        return self.ids[K.ragged(self.at[number], counts)], counts

    def _per_text(self, bounds: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(counts))[np.searchsorted(bounds, offsets)])

    def _numbers(self, raw: bytes, starts: np.ndarray, size: np.ndarray, out: np.ndarray, count_only: bool = False) -> np.ndarray:
        """Fill in the numbers of pieces, encoding new ones; the first places of the new ones."""
        word = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        short = np.flatnonzero(size <= 16)
        s, n = starts[short], size[short]
        low, high = word[s] & _MASKS[np.minimum(n, 8)], word[s + 8] & _MASKS[np.maximum(n - 8, 0)]
        found, slot = self._find(low, high, n)
        new = np.flatnonzero(found < 0)
        order = np.lexsort((n[new], high[new], low[new]))
        key = [c[new][order] for c in (low, high, n)]
        begin = np.ones(len(new), bool)
        begin[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        one = new[order[begin]]
        long = np.flatnonzero(size > 16)
        long_pieces = [raw[a:b] for a, b in zip(starts[long].tolist(), (starts[long] + size[long]).tolist())]
        long_new = [p for p in dict.fromkeys(long_pieces) if p not in self.long]
        if count_only:
            return np.zeros(len(one) + len(long_new), np.int8)
        mine = self._encode_pieces([raw[a:b].decode() for a, b in zip(s[one].tolist(), (s[one] + n[one]).tolist())])
        self.low[mine], self.high[mine], self.size[mine] = low[one], high[one], n[one]
        self._put(mine, slot[one])
        found[new[order]] = mine[np.cumsum(begin) - 1]
        out[short] = found
        if len(long):
            self.long.update(zip(long_new, self._encode_pieces([p.decode() for p in long_new]).tolist()))
            out[long] = [self.long[p] for p in long_pieces]
        return one


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


MANIFEST_SQL = "part int, name string, n_docs long, n_ids long"


class _Writer:
    """Streams ids to a file, a number of whole blocks at a time."""

    def __init__(self, file) -> None:
        self.file, self.rest, self.n_words, self.n_null = file, np.zeros(0, np.uint32), 0, 0
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []

    def add(self, doc: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents in order; those without an id come first."""
        self.docs.append(doc.fill_null(0).to_numpy(zero_copy_only=False))
        self.n_null += doc.null_count
        self.sizes.append(sizes)
        self.rest = np.append(self.rest, ids)
        whole = len(self.rest) // simple8b.BLOCK * simple8b.BLOCK
        self._put(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        step = 1024 * simple8b.BLOCK
        for i in range(0, len(ids), step):
            words, n_words, n_escapes = simple8b.encode(ids[i : i + step])
            self.file.write(words.astype("<u8").tobytes())
            self.n_words += len(words)
            self.blocks.append(np.stack([n_words, n_escapes], 1))

    def close(self) -> tuple[int, int]:
        self._put(self.rest)
        docs, sizes = np.concatenate([*self.docs, np.zeros(0, np.int64)]), np.concatenate([*self.sizes, np.zeros(0, np.int64)])
        blocks = np.concatenate([*self.blocks, np.zeros((0, 2), np.int64)])
        for x in (docs, sizes, blocks):
            self.file.write(x.astype("<i8").tobytes())
        self.file.write(FOOTER.pack(self.n_words, len(docs), self.n_null, int(sizes.sum()), len(blocks), MAGIC))
        return len(docs), int(sizes.sum())


def _write(directory: str, tokenizer: str):
    @K.tidy
    def run(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.s8b"
        writer = opened = None
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                opened = new_file(directory, name)
                writer = _Writer(opened.__enter__())
            ids = batch.column(0)
            for i, buf, offsets in K.texts(batch, "text", 2 << 20):
                tokens, n = encoder(tokenizer).encode(buf, offsets)
                ends = np.cumsum(n)
                writer.add(ids.slice(i, len(n)), np.insert(tokens, ends, END_ID), n + 1)
        if writer is not None:
            n_docs, n_ids = writer.close()
            opened.__exit__(None, None, None)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_ids])], ["part", "name", "n_docs", "n_ids"])

    return run


def write_files(docs: DataFrame, directory: str, tokenizer: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write docs (doc_id, text) as files in the directory, in ascending id order; part, name, n_docs, n_ids of each."""
    files = max(1, min(1 << 16, size_in_bytes(docs) // file_bytes))
    rows = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(_write(directory, tokenizer), MANIFEST_SQL), "manifest")


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_tables(file) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Documents, their numbers of ids, and the table of blocks."""
    size = file.size()
    file.seek(size - FOOTER.size)
    n_words, n_docs, n_null, n_ids, n_blocks, magic = FOOTER.unpack(file.read(FOOTER.size))
    if magic != MAGIC or size != 8 * (n_words + 2 * n_docs + 2 * n_blocks) + FOOTER.size:
        raise ValueError("not a whole token file")
    file.seek(8 * n_words)
    x = np.frombuffer(file.read(8 * (2 * n_docs + 2 * n_blocks)), "<i8")
    if int(x[n_docs : 2 * n_docs].sum()) != n_ids:
        raise ValueError("the numbers of ids differ")
    return pa.array(x[:n_docs], mask=np.arange(n_docs) < n_null), x[n_docs : 2 * n_docs], x[2 * n_docs :].reshape(-1, 2)


def read_ids(file, first: int = 0, count: int | None = None):
    """Arrays of ids of blocks from the block number first on, a number of blocks at a time."""
    _, sizes, blocks = read_tables(file)
    total = int(sizes.sum())
    last = len(blocks) if count is None else min(len(blocks), first + count)
    file.seek(8 * int(blocks[:first, 0].sum()))
    for i in range(first, last, 256):
        own = blocks[i : min(i + 256, last)]
        words = np.frombuffer(file.read(8 * int(own[:, 0].sum())), "<u8")
        lengths = np.minimum(simple8b.BLOCK, total - simple8b.BLOCK * np.arange(i, i + len(own)))
        yield simple8b.decode(words, own[:, 0], own[:, 1], lengths)


def _read(directory: str):
    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(directory, name) as f:
                    docs, sizes, _ = read_tables(f)
                    crc = np.zeros(len(docs), np.int64)
                    ends = np.cumsum(sizes)
                    k, at = 0, 0
                    for ids in read_ids(f):
                        raw = ids.astype("<u4").tobytes()
                        lo = 0
                        while lo < len(ids):
                            n = min(len(ids) - lo, int(ends[k]) - at - lo)
                            crc[k] = zlib.crc32(raw[4 * lo : 4 * (lo + n)], int(crc[k]))
                            lo += n
                            if at + lo == ends[k]:
                                k += 1
                        at += len(ids)
                    yield pa.record_batch([docs, start + ends - sizes, sizes, crc], schema=OUT)

    return run


def read_files(manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files. A row for each file comes to the driver."""
    files = sorted(manifest.select("part", "name", "n_ids").toLocalIterator())
    spark, rows, start = manifest.sparkSession, [], 0
    for f in files:
        rows.append((f["name"], start))
        start += f["n_ids"]
    return spark.createDataFrame(rows, "name string, start long").repartition(max(1, len(rows))).mapInArrow(_read(directory), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, directory: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to token files and read them back: doc_id, start, n_tokens, ids_crc32, one row for each row of docs.

    Files hold documents in ascending id order, those without an id first and rows that repeat an id side by side. Null is an empty text, of which only the end id remains. Strings of special tokens in a text become
    their ids, as the tokenizers library does unless told otherwise. An empty table writes no file and gives no rows.
    Other columns are ignored. tokenizer: the path of a tokenizer file; directory: where the files go, the shared folder
    unless given.
    """
    d = text_of(docs, id_col, text_col)
    where = directory or scratch_path(docs.sparkSession, "tokens")
    manifest = write_files(d, where, tokenizer or tokenizer_path())
    return read_files(manifest, where)
