import math

import numpy as np
import pyarrow as pa

from siltstone.llm import language_id

from .helpers import corpus, frame


def brute(word, pieces, prob):
    """Log of the sum over all segmentations, byte by byte."""
    longest = max(map(len, pieces))
    log = [0.0]
    for j in range(1, len(word) + 1):
        terms = [log[j - k] + math.log(prob[pieces[word[j - k : j]]]) for k in range(1, min(j, longest) + 1) if word[j - k : j] in pieces]
        peak = max(terms)
        log.append(peak + math.log(sum(math.exp(t - peak) for t in terms)))
    return log[-1]


def spans(words):
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends


def test_vocabulary_has_its_long_pieces():
    pieces = language_id.vocabulary()
    assert {b" continue", b" whenever", b" overview"} <= set(pieces)
    assert max(map(len, pieces)) > 8


def test_words_of_any_length_are_scored_whole():
    pieces = language_id.vocabulary()
    prob = np.random.default_rng(1).random((len(pieces) + 1, 2)) * 1e-4 + 1e-9
    prob[-1] = 0
    model = language_id.Model(["a", "b"], np.full(2, 0.5), prob, language_id.Pieces(pieces))
    words = [b"continue", b"x", b"whenever" * 5, "предприятие".encode() * 4, b"overview" * 300, "文章".encode() * 40, b"a" * 31, b"a" * 32, b"donaudampfschiff" * 3]
    at = {p: i for i, p in enumerate(pieces)}
    got = model.word_scores(*spans(words))
    for w, score in zip(words, got):
        assert np.allclose(score, [brute(b" " + w, at, prob[:, k]) for k in range(2)]), w
    names, score = model.score(pa.array([b"overview".decode() * 300, "x"]))
    want = [brute(b" " + words[4], at, prob[:, k]) for k in range(2)]
    assert names[0] == "ab"[int(np.argmax(want))] and 0.5 <= score[0] <= 1


def test_expected_counts_of_long_words():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"bc", b" ab", b"abc", b"abcabcabcabc"})
    table = language_id.Pieces(pieces)
    prob = np.random.default_rng(0).random(len(pieces) + 1) * 0.1
    prob[-1] = 0
    words = [b" " + b"abc" * 9, b" abcab", b" x"]
    buf, starts, ends = spans(words)
    args = table.lattice(buf, starts, ends), starts, ends - starts, np.array([1.0, 2.0, 3.0]), prob
    assert np.allclose(language_id.expected_counts(*args), language_id.log_expected_counts(*args))
    buf, starts, ends = spans([b" " + b"abc" * 500, b" x"])
    counts = language_id.log_expected_counts(table.lattice(buf, starts, ends), starts, ends - starts, np.ones(2), prob)
    assert np.isclose(sum(c * len(p) for c, p in zip(counts, pieces)), len(buf))


def test_training_on_long_words():
    words = {"a": ([b"continue" * 8, b"go"], np.array([5, 1])), "b": ([b"whenever" * 8, b"no"], np.array([5, 1]))}
    model = language_id.fit(words, language_id.vocabulary())
    names, _ = model.score(pa.array(["continue" * 20, "whenever" * 20]))
    assert names == ["a", "b"]


def test_the_query_equals_a_plain_forward_pass(spark):
    """Predictions of whole texts against a recursion byte by byte over all their words, some of hundreds of bytes."""
    pieces = language_id.vocabulary()
    words = {"a": ([b"continue" * 8, b"go", "über".encode()], np.array([5, 1, 2])), "b": ([b"whenever" * 8, b"no", b"overview"], np.array([5, 1, 3]))}
    model = language_id.fit(words, pieces)
    at = {p: i for i, p in enumerate(pieces)}
    rows = [(i, t) for i, t in corpus() if t is None or len(t) < 4000] + [(900, "whenever" * 60 + " go 12 Über"), (901, "CONTINUE" * 40 + ", no"), (902, "文章" * 90 + " no")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(frame(spark, rows), model).collect()}
    for i, t in rows:
        parts = [w for w in "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (t or "").lower()).split(" ") if w]
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        total = [sum(brute(b" " + w.encode(), at, model.prob[:, k]) for w in parts) for k in range(2)]
        best = int(np.argmax(total))
        assert got[i][0] == "ab"[best] or abs(total[0] - total[1]) < 1e-6
        assert np.isclose(got[i][1], 1 / (1 + math.exp(min(700, total[1 - best] - total[best]))), atol=1e-6)
