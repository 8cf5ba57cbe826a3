"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; training gives each language its piece probabilities (expectation
maximisation over all segmentations of a bounded sample's words). A word's probability in a language is the sum over
all its segmentations, by the forward algorithm; a text's is the product over its words. Words are scored once for each
batch of text, for all languages at once, in blocks of words in order of length; long words, of any length, by logarithms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, text_of

VOCABULARY = "piece_bpe_32k.model"
SHORT_BYTES = 32  # of a word that needs no logarithms, as FLOOR to that power is no underflow
CELLS = 1 << 18  # of a block of longer words: words times the longest's bytes
SAMPLE_TEXTS = 600  # of each language, about
ROUNDS = 4
FLOOR = 1e-9  # probability of a byte that no piece has
TABLE_BITS = 20
#: Bytes that are no part of a word: ASCII but letters.
NOT_LETTER = K.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
UNDEFINED = "und"


def vocabulary(path: str | None = None) -> list[bytes]:
    """Lower-case pieces of letters, a space for the begin of a word; all single bytes among them."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i).lower().replace("▁", " ")
        b = p.encode()
        if p.strip(" ").isalpha() and " " not in p[1:]:
            pieces.add(b)
    return sorted(pieces)


class Pieces:
    """Piece numbers by hash: an open table of hashes, with what doesn't fit at its place in a small sorted rest."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.n, self.longest = len(pieces), max(map(len, pieces))
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        h = K.hash_spans(buf, ends - [len(p) for p in pieces], ends)
        self.size = 1 << TABLE_BITS
        self.table, self.number = np.zeros(self.size, K.U), np.full(self.size, self.n)
        at = (h & K.U(self.size - 1)).astype(np.int64)
        _, first = np.unique(at, return_index=True)
        self.table[at[first]], self.number[at[first]] = h[first], first
        rest = np.setdiff1d(np.arange(self.n), first)
        order = rest[np.argsort(h[rest])]
        self.rest, self.rest_number = np.append(h[order], K.U((1 << 64) - 1)), np.append(order, self.n)
        self.crowded = np.zeros(self.size, bool)
        self.crowded[at[rest]] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece number, or n where there is none."""
        at = (h & K.U(self.size - 1)).astype(np.int64)
        out = np.where(self.table[at] == h, self.number[at], self.n)
        odd = np.flatnonzero(self.crowded[at] & (out == self.n))
        if len(odd):
            place = np.searchsorted(self.rest, h[odd])
            out[odd] = np.where(self.rest[place] == h[odd], self.rest_number[place], self.n)
        return out

    def lattice(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """[length - 1, place]: the piece that begins at the place with the length (n: none), for bytes of all words."""
        total = len(buf)
        most = min(self.longest, int((ends - starts).max(initial=1)))
        p, inv = K.powers(K.BASE, total + most)
        sums = np.zeros(total + 1, K.U)
        np.cumsum((buf.astype(K.U) + K.U(1)) * p[:total], out=sums[1:])
        left = np.repeat(ends, ends - starts) - np.arange(total)  # bytes from the place to the end of its word
        out = np.full((most, total), self.n, np.int32)
        for k in range(1, most + 1):
            at = np.flatnonzero(left >= k)
            out[k - 1, at] = self.find(K.mix((sums[at + k] - sums[at]) * inv[at] + np.full(1, k, K.U) * K.BASES[0]))
        return out


def forward(lattice: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[j, word, language]: probability of the word's first j bytes. Words in descending order of length."""
    top = int(lengths.max(initial=0))
    alpha = np.zeros((top + 1, len(starts), prob.shape[1]))
    alpha[0] = 1
    for j in range(1, top + 1):
        n = int(np.searchsorted(-lengths, -j, "right"))  # words of at least j bytes
        for k in range(1, min(j, len(lattice)) + 1):
            alpha[j, :n] += alpha[j - k, :n] * prob[lattice[k - 1, starts[:n] + j - k]]
    return alpha


def expected_counts(lattice: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of words that occur weight times, for one language."""
    p = prob[:, None]
    alpha = forward(lattice, starts, lengths, p)[:, :, 0]
    top = int(lengths.max(initial=0))
    beta = np.zeros_like(alpha)
    beta[lengths, np.arange(len(starts))] = 1
    out = np.zeros(len(prob))
    total = np.maximum(alpha[lengths, np.arange(len(starts))], 1e-300)
    for j in range(top - 1, -1, -1):
        for k in range(1, min(top - j, len(lattice)) + 1):
            m = int(np.searchsorted(-lengths, -(j + k), "right"))
            piece = lattice[k - 1, starts[:m] + j]
            tail = prob[piece] * beta[j + k, :m]
            beta[j, :m] += tail
            out += np.bincount(piece, alpha[j, :m] * tail / total[:m] * weight[:m], minlength=len(prob))
    return out


def _log_sum(logs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the sum of exp(logs) * p over the first axis."""
    peak = logs.max(axis=0)
    return peak + np.log(np.maximum((np.exp(logs - peak) * p).sum(axis=0), 1e-300))


def log_forward(lattice: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logarithms of forward's result, for words of any length."""
    top = int(lengths.max(initial=0))
    alpha = np.full((top + 1, len(starts), prob.shape[1]), -np.inf)
    alpha[0] = 0
    for j in range(1, top + 1):
        n = int(np.searchsorted(-lengths, -j, "right"))
        k = np.arange(1, min(j, len(lattice)) + 1)[:, None]
        alpha[j, :n] = _log_sum(alpha[j - k[:, 0], :n], prob[lattice[k - 1, starts[:n] + j - k]])
    return alpha


def log_expected_counts(lattice: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """expected_counts for words of any length."""
    alpha = log_forward(lattice, starts, lengths, prob[:, None])[:, :, 0]
    top = int(lengths.max(initial=0))
    beta = np.full_like(alpha, -np.inf)
    beta[lengths, np.arange(len(starts))] = 0
    out = np.zeros(len(prob))
    total = alpha[lengths, np.arange(len(starts))]
    for j in range(top - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -(j + 1), "right"))
        k = np.arange(1, min(top - j, len(lattice)) + 1)[:, None]
        piece = lattice[k - 1, starts[:n] + j]  # none where the word ends before
        tail = beta[j + k[:, 0], :n]
        beta[j, :n] = _log_sum(tail, prob[piece])
        uses = np.exp(np.minimum(alpha[j, :n] + tail - total[:n] + np.log(np.maximum(prob[piece], 1e-300)), 0)) * (prob[piece] > 0)
        out += np.bincount(piece.ravel(), (uses * weight[:n]).ravel(), minlength=len(prob))
    return out


def _blocks(sizes: np.ndarray):
    """(numbers of words, whether they are long) in descending order of size; sizes include the begin's space."""
    order = np.argsort(-sizes, kind="stable")
    i = 0
    while i < len(order):
        top = int(sizes[order[i]])
        long = top > SHORT_BYTES
        part = order[i : i + (max(1, min(20_000, CELLS // top)) if long else 20_000)]
        if long:
            part = part[sizes[part] > SHORT_BYTES]
        yield part, long
        i += len(part)


def _marked(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, a space before each: bytes, starts, ends."""
    size = ends - starts + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    stop = np.cumsum(size)
    inside = np.ones(len(out), bool)
    inside[stop - size] = False
    out[inside] = buf[K.ragged(starts, ends - starts)]
    return out, stop - size, stop


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    prob: np.ndarray  # [piece, language], the last row 0
    pieces: Pieces

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(starts), len(self.languages)))
        for own, long in _blocks(ends - starts + 1):
            text, s, e = _marked(buf, starts[own], ends[own])
            alpha = (log_forward if long else forward)(self.pieces.lattice(text, s, e), s, e - s, self.prob)[e - s, np.arange(len(own))]
            out[own] = alpha if long else np.log(np.maximum(alpha, 1e-300))
        return out

    def score(self, col) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability, of each text of a string column."""
        n = len(col)
        if not self.languages:
            return [UNDEFINED] * n, np.zeros(n)
        buf, offsets = K.text_buffer(pc.utf8_lower(col))
        starts, ends, first = K.words(buf, offsets, NOT_LETTER)
        total = np.tile(np.log(self.prior), (n, 1))
        if len(starts):
            text = np.repeat(np.arange(n), np.diff(first))
            _, one, which = np.unique(K.hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
            scores = self.word_scores(buf, starts[one], ends[one])
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(text, scores[which, k], minlength=n)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        ascii_letter = np.append(0, np.cumsum(((buf | 32) >= 97) & ((buf | 32) <= 122)))
        lettered = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(first) > 0)):  # only other characters than ASCII: letters or not
            lettered[i] = any(c.isalpha() for c in col[i].as_py())
        return [self.languages[b] if ok else UNDEFINED for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def fit(words: dict[str, tuple[list[bytes], np.ndarray]], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its words (bytes, lower case) and how often they occur."""
    table = Pieces(pieces)
    languages = sorted(words)
    length = np.array([len(p) for p in pieces] + [1])
    prob = np.zeros((len(pieces) + 1, len(languages)))
    for k, language in enumerate(languages):
        own, weight = words[language]
        flat = np.frombuffer(b"".join(own), np.uint8)
        stop = np.cumsum([len(w) for w in own])
        begin = stop - [len(w) for w in own]
        p = 0.05 ** length.astype(float)
        p[-1] = 0
        blocks = []
        for part, long in _blocks(stop - begin + 1):
            text, s, e = _marked(flat, begin[part], stop[part])
            blocks.append((log_expected_counts if long else expected_counts, (table.lattice(text, s, e), s, e - s, np.asarray(weight, float)[part])))
        for _ in range(rounds):
            counts = sum((count(*b, p) for count, b in blocks), np.zeros(len(p)))
            counts[:-1] += np.where(length[:-1] == 1, FLOOR * counts.sum() + 1e-12, 0)
            counts[-1] = 0
            p = np.maximum(counts / counts.sum(), np.where(length == 1, FLOOR, 1e-12))
            p[-1] = 0
        prob[:, k] = p
    return Model(languages, np.full(len(languages), 1 / max(1, len(languages))), prob, table)


def train(docs: DataFrame, fold: tuple[int, int] = (4, 2), seed: int = 3, sample: int = SAMPLE_TEXTS, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from text and non-null language of rows outside the fold.

    About sample texts of each language, drawn by a hash of the id, are cut into words and counted in Spark; the counts
    come to the driver. All languages have the same prior.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id"), *fold))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return fit({}, vocabulary(vocabulary_path))
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, sample / n) * (1 << 30)))])
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.element_at(limit, F.col("lang")))
    word = F.explode(F.split("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"))
    counts = drawn.select("lang", word.alias("word")).filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()
    words = {}
    for lang in sorted(sizes):
        t = counts.filter(pc.equal(counts["lang"], lang)).sort_by("word")
        words[lang] = ([w.encode() for w in t["word"].to_pylist()], t["n"].to_numpy())
    return fit({k: v for k, v in words.items() if len(v[0])}, vocabulary(vocabulary_path))


def _predict(model: Model):
    @K.tidy
    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            _, offsets = K.text_buffer(col)
            lang, score = [], []
            for i, j in K.chunks(offsets, 2 << 20):
                names, s = model.score(col.slice(i, j - i).fill_null(""))
                lang += names
                score.append(s)
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)]))], ["doc_id", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, model: Model | None = None, fold: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    lang_pred is a learned language, or und with score 0 if the text is null or has no letter, or if there was nothing
    to learn from. score: the posterior probability. Ties go to the first language in order. Only the text has a part in
    a prediction. An empty table gives no rows.
    """
    model = model or train(docs, fold, id_col=id_col, text_col=text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the vocabulary's size, whatever the input's

    def run(batches):
        yield from _predict(shared.value)(batches)

    out = text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "lang_pred", "score")
