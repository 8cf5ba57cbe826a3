"""The cache of pieces: ids are those of whole texts, however small the cache."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siltstone.llm import kernels as K
from siltstone.llm import token_output

from .helpers import corpus

PARTS = ["a", "Be", "don't", "we'll", "x's", "é", "ñu", "×", "÷", "…", "日本", ".", ",", "...", "!?", "|", "<|", "|>", "<|endoftext|>", "endoftext", "<", ">", "'", "''", "12", "3.5", "_", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x00", "a" * 20, "." * 17, "é," * 9]


def odd_texts():
    r = random.Random(8)
    return [t or "" for _, t in corpus()] + ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(3000)]


@pytest.mark.parametrize("kept", [40, 3000, token_output.CACHED_PIECES])
def test_ids_of_whole_texts(monkeypatch, kept):
    monkeypatch.setattr(token_output, "CACHED_PIECES", kept)
    monkeypatch.setattr(token_output, "SLOTS", 1 << max(7, (2 * kept).bit_length()))
    path = token_output.tokenizer_path()
    plain, cached, texts = Tokenizer.from_file(path), token_output.Encoder(path), odd_texts()
    if kept == 40:
        texts = texts[-300:]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    for _ in range(2):
        for i, buf, offsets in K.texts(batch, "text", 1 << 16):
            ids, n = cached.encode(buf, offsets)
            want = [plain.encode(t, add_special_tokens=False).ids for t in texts[i : i + len(n)]]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert len(np.unique(cached.number[cached.number >= 0])) + len(cached.long) == cached.held <= kept
