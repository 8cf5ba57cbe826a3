"""Simple-8b word-aligned coding of unsigned integers, in blocks.

A 64-bit word has a selector in its 4 high bits, which tells how many values of how many bits share the other 60. Each
word takes as many values as fit. A value of over 60 bits is an escape: a word of selector 0, and the value itself
behind the words of its block. Blocks are coded side by side: each step writes one word of every block.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1024
# Fixed values of the coding: values in a word and bits of each, by selector from 1; selector 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // c for c in COUNTS)
_COUNT = np.array((1, *COUNTS), np.int64)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs: the exponent of its floating-point form, which is exact up to 53 bits; over that the
    high half has it."""
    out = np.frexp(x.astype(np.float64))[1].astype(np.uint8)
    large = x >> U(53) > 0
    if large.any():
        out[large] = 32 + np.frexp((x[large] >> U(32)).astype(np.float64))[1].astype(np.uint8)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, and for each block of BLOCK values the number of its words and of its escapes (among its words)."""
    values = np.ascontiguousarray(values, U)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.zeros((blocks, BLOCK + max(COUNTS)), U)
    flat = np.zeros(blocks * BLOCK, U)
    flat[:n] = values
    x[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _widths(x)
    best = np.zeros((blocks, BLOCK), np.uint8)
    most, have = {1: width}, [1]
    for c in sorted(COUNTS):  # the widest of c values from each place, of two shorter runs that overlap
        if c > 1:
            part = next(h for h in reversed(have) if h <= c and 2 * h >= c)
            shifted = np.zeros_like(width)
            shifted[:, : width.shape[1] - (c - part)] = most[part][:, c - part :]
            most[c] = np.maximum(most[part], shifted)
            have.append(c)
        s = COUNTS.index(c) + 1
        best[most[c][:, :BLOCK] <= BITS[s - 1]] = s
    del most
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    at = np.zeros(blocks, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.arange(blocks)
    while len(live):
        s = best[live, at[live]]
        steps.append((live, at[live], s))
        at[live] += _COUNT[s]
        live = live[at[live] < length[live]]
    block, place, s = (np.concatenate(c) for c in zip(*steps))
    step = np.repeat(np.arange(len(steps)), [len(b) for b, _, _ in steps])
    word = np.zeros(len(block), U)
    for k, (c, b) in enumerate(zip(COUNTS, BITS), 1):
        own = np.flatnonzero(s == k)
        if len(own):
            v = x[block[own][:, None], place[own][:, None] + np.arange(c)]
            word[own] = np.bitwise_or.reduce(v << (U(b) * np.arange(c).astype(U)), axis=1) | U(k << 60)
    order = np.lexsort((step, block))
    n_words = np.bincount(block, minlength=blocks)
    escape = s == 0
    n_escapes = np.bincount(block[escape], minlength=blocks)
    if not escape.any():
        return word[order], n_words, n_escapes
    raw = np.flatnonzero(escape)
    key_block, key = np.append(block, block[raw]), np.append(step, step[raw] + len(steps))
    order = np.lexsort((key, key_block))
    return np.append(word, x[block[raw], place[raw]])[order], n_words + n_escapes, n_escapes


def decode(words: np.ndarray, n_words: np.ndarray, n_escapes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The values of whole blocks: their words in a row, and lengths[i] values in block i."""
    n_words, n_escapes, lengths = (np.asarray(v, np.int64) for v in (n_words, n_escapes, lengths))
    block = np.repeat(np.arange(len(n_words)), n_words)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    is_raw = inside >= np.repeat(n_words - n_escapes, n_words)
    raw = words[is_raw]
    words, block = words[~is_raw], block[~is_raw]
    s = (words >> U(60)).astype(np.int64)
    count = _COUNT[s]
    ends = np.cumsum(count)
    begin_of_block = np.zeros(len(n_words), np.int64)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
    begin_of_block[block[first]] = (ends - count)[first]
    at = ends - count - begin_of_block[block]
    base = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), U)
    for k, (c, b) in enumerate(zip(COUNTS, BITS), 1):
        own = np.flatnonzero(s == k)
        if len(own):
            v = (words[own][:, None] >> (U(b) * np.arange(c).astype(U))) & U((1 << b) - 1)
            place = at[own][:, None] + np.arange(c)
            there = place < lengths[block[own]][:, None]
            out[(base[block[own]][:, None] + place)[there]] = v[there]
    esc = np.flatnonzero(s == 0)
    out[base[block[esc]] + at[esc]] = raw
    return out
