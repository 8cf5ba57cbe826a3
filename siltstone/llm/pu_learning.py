"""Non-negative positive-unlabelled learning of linear classifiers over whole texts.

The risk of a classifier f from positives P and unlabelled rows U with class prior p is estimated as
p * E_P[loss(f)] + max(0, E_U[loss(-f)] - p * E_P[loss(-f)]), with the logistic loss. Where the second part would fall
below zero the step goes against it, so that training can't fit U as negative. The class prior is given, or the share of
positives among labelled rows, or estimated from P and U alone: P is told from U by plain logistic regression, each fold of the sample by a classifier of the others, and over these
scores the least ratio of the share of U above a threshold to that of P bounds the prior. Rows are drawn by a hash of the id and bounded in number;
features are computed where the rows are, and only the sample's features reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, text_of

BITS = 18
CHUNK = 1 << 20
MOST_POSITIVES = 4_000
MOST_UNLABELLED = 8_000
STEPS = 600
PRIOR_FOLDS, PRIOR_STEPS, PRIOR_PENALTY = 5, 60, 1e-3  # of the classifiers that the prior is estimated with: few steps, as P may be few
UNKNOWN_PRIOR = 0.5  # where there are too few rows to estimate it
MOST_TERMS = 2_000
PUNCTUATION = np.flatnonzero(np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(128)]))
N_DENSE = 10 + len(PUNCTUATION)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(flags))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, value) of the distinct values of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]))[: len(h)]
    return text[new], h[new]


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: style figures; (text number, term) of its distinct lower-case words, terms hashed to BITS bits."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, first = K.words(buf, offsets, K.SPACES)
    n_words = np.diff(first)
    some = np.maximum(n_words, 1)
    dense = np.zeros((n, N_DENSE))
    letters = _per_text(((buf | 32) >= 97) & ((buf | 32) <= 122), offsets)
    dense[:, 0] = np.log1p(n_words)
    dense[:, 1] = np.diff(offsets) / some
    dense[:, 2] = _per_text((buf >= 65) & (buf <= 90), offsets) / np.maximum(letters, 1)
    dense[:, 3] = _per_text((buf >= 48) & (buf <= 57), offsets) / size
    dense[:, 4] = _per_text(buf >= 128, offsets) / size
    dense[:, 5] = letters / size
    dense[:, 6] = _per_text(buf == 10, offsets) / some
    owner, _ = _distinct(K.hash_spans(buf, starts, ends), first)
    dense[:, 7] = np.bincount(owner, minlength=n) / some
    line_starts, line_ends, line_first = K.words(buf, offsets, K.byte_set((10, 10), (13, 13)))
    owner, _ = _distinct(K.hash_spans(buf, line_starts, line_ends), line_first)
    n_lines = np.diff(line_first)
    dense[:, 8] = np.bincount(owner, minlength=n) / np.maximum(n_lines, 1)
    dense[:, 9] = np.log1p(n_lines)
    kinds = np.full(256, -1)
    kinds[PUNCTUATION] = np.arange(len(PUNCTUATION))
    at = np.flatnonzero(kinds[buf] >= 0)
    text = np.searchsorted(offsets, at, "right") - 1
    counts = np.bincount(text * len(PUNCTUATION) + kinds[buf[at]], minlength=n * len(PUNCTUATION))
    dense[:, 10:] = np.sqrt(counts.reshape(n, -1) / some[:, None])
    lower = K.LOWER[buf]
    starts, ends, first = K.words(lower, offsets, K.NOT_ALNUM)
    owner, term = _distinct(K.hash_spans(lower, starts, ends) >> K.U(64 - BITS), first)
    return dense, owner, term.astype(np.int64)


@K.tidy
def _sample_features(batches):
    for batch in batches:
        for i, buf, offsets in K.texts(batch, "text", CHUNK):
            dense, owner, term = features(buf, offsets)
            n = len(dense)
            bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.ListArray.from_arrays(pa.array(np.arange(0, n * N_DENSE + 1, N_DENSE, dtype=np.int32)), pa.array(dense.ravel().astype(np.float32))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))],
                ["positive", "doc_id", "dense", "terms"],
            )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """score = sigmoid(bias + dense part + sum of the weights of the text's terms)."""

    bias: float
    dense: np.ndarray
    terms: np.ndarray
    prior: float

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.zeros(len(offsets) - 1)
        dense, owner, term = features(buf, offsets)
        z = self.bias + dense @ self.dense + np.bincount(owner, self.terms[term], minlength=len(dense))
        return _sigmoid(z)


def nothing_known() -> Model:
    """The model where there is no positive row: every score is 0."""
    return Model(-np.inf, np.zeros(N_DENSE), np.zeros(1 << BITS, np.float32), 0.0)


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores z (before the sigmoid), and the step's gradient to z."""
    p, u = positive, ~positive
    soft = lambda x: np.logaddexp(0, x)
    n_p, n_u = p.sum(), u.sum()
    loss_p = prior * soft(-z[p]).mean()
    rest = soft(z[u]).mean() - prior * soft(z[p]).mean()
    grad = np.zeros_like(z)
    s = _sigmoid(z)
    if rest >= 0:
        grad[p] = prior / n_p * ((s[p] - 1) - s[p])
        grad[u] = s[u] / n_u
    else:  # only bring the negative part back up
        grad[p] = prior / n_p * s[p]
        grad[u] = -s[u] / n_u
    return loss_p + max(0.0, rest), grad


def contrast(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The logistic risk of telling P from U, each weighing half, and its gradient to z."""
    p, u = positive, ~positive
    s = _sigmoid(z)
    grad = np.where(p, (s - 1) / (2 * p.sum()), s / (2 * u.sum()))
    return (np.logaddexp(0, -z[p]).mean() + np.logaddexp(0, z[u]).mean()) / 2, grad


def fit(positive: np.ndarray, dense: np.ndarray, row: np.ndarray, term: np.ndarray, prior: float, steps: int = STEPS, penalty: float = 1e-4, loss=risk) -> Model:
    """Full-batch Adam on the loss, by default the non-negative risk. row, term: the terms of each row, rows ascending."""
    n = len(positive)
    if not positive.any() or positive.all():
        return nothing_known()
    # terms by how far their share among positives is from that among unlabelled rows
    df_p = np.bincount(term[positive[row]], minlength=1 << BITS)
    df_u = np.bincount(term[~positive[row]], minlength=1 << BITS)
    share = (df_p + df_u) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / positive.sum() + 1 / (~positive).sum()))
    z = np.where(df_p + df_u >= 5, np.abs(df_p / positive.sum() - df_u / (~positive).sum()) / spread, 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:MOST_TERMS])
    chosen = chosen[z[chosen] >= 3]
    number = np.full(1 << BITS, -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[term] >= 0
    row, term = row[keep], number[term[keep]]
    mean, std = dense.mean(axis=0), dense.std(axis=0)
    std[std < 1e-9] = np.inf
    x = (dense - mean) / std
    w = np.zeros(1 + N_DENSE + len(chosen))
    w[0] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score = w[0] + x @ w[1 : 1 + N_DENSE] + np.bincount(row, w[1 + N_DENSE :][term], minlength=n)
        _, g = loss(score, positive, prior)
        grad = np.concatenate([[g.sum()], x.T @ g, np.bincount(term, g[row], minlength=len(chosen))])
        grad[1:] += penalty * w[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    d = w[1 : 1 + N_DENSE] / std
    terms = np.zeros(1 << BITS, np.float32)
    terms[chosen] = w[1 + N_DENSE :]
    return Model(float(w[0] - d @ mean), d, terms, prior)


def least_ratio(p: np.ndarray, u: np.ndarray, doubt: float = 0.1) -> float:
    """The prior by scores of positives and of unlabelled rows: with a share q_p of P and q_u of U above a threshold, no
    more than q_u / q_p of U can be positive. The threshold is that where the ratio and its error, at a probability of
    doubt, are least; without rows of either kind, UNKNOWN_PRIOR."""
    if not len(p) or not len(u):
        return UNKNOWN_PRIOR
    at = np.unique(p)
    q_p = 1 - np.searchsorted(np.sort(p), at, "left") / len(p)
    q_u = 1 - np.searchsorted(np.sort(u), at, "left") / len(u)
    error = np.sqrt(np.log(4 / doubt) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)
    best = np.argmin((q_u + error) / q_p)
    return float(min(1.0, q_u[best] / q_p[best]))


def estimate_prior(positive: np.ndarray, dense: np.ndarray, row: np.ndarray, term: np.ndarray) -> float:
    """The class prior of a sample (see fit), without a look at any row that is known to be negative."""
    n = len(positive)
    fold = np.zeros(n, int)
    for kind in (True, False):
        at = np.flatnonzero(positive == kind)
        if len(at) < PRIOR_FOLDS:
            return UNKNOWN_PRIOR
        fold[at] = np.arange(len(at)) % PRIOR_FOLDS
    z = np.zeros(n)
    for k in range(PRIOR_FOLDS):
        own = fold != k
        number, mine = np.cumsum(own) - 1, own[row]
        model = fit(positive[own], dense[own], number[row[mine]], term[mine], 0.5, PRIOR_STEPS, PRIOR_PENALTY, contrast)
        z[~own] = (model.bias + dense @ model.dense + np.bincount(row, model.terms[term], minlength=n))[~own]
    return least_ratio(z[positive], z[~positive])


def train(docs: DataFrame, labels: DataFrame, label: str, prior: float | str = "unlabelled", fold: tuple[int, int] = (5, 0), seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of P(label = 1) from rows outside the held-out fold.

    At most about MOST_POSITIVES rows labelled 1 and MOST_UNLABELLED rows, whatever their label, drawn by a hash of the
    id. prior: the share of positives among all rows; "unlabelled" estimates it from the sample of positives and unlabelled
    rows (estimate_prior), "labels" takes the share among the labelled rows outside the fold. Labels of 0 have no other
    part. Null labels and ids are passed over; an id counts once in the sample, however often it is labelled or rows repeat it (with
    the least of its texts). Without a positive row, or without rows, the model scores 0.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).alias("label")).filter("label is not null and doc_id is not null")
    known = known.filter(~held_out(F.col("doc_id"), *fold))
    n_known, known = known.count(), known.filter("label = 1").select("doc_id").distinct()
    d = text_of(docs, id_col, text_col).filter("doc_id is not null").filter(~held_out(F.col("doc_id"), *fold))
    n_pos, n_all = known.count(), d.select("doc_id").count()
    if not n_pos or not n_all:
        return nothing_known()
    drawn = lambda n, most, salt: F.pmod(F.xxhash64("doc_id", F.lit(seed + salt)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))
    ids = known.filter(drawn(n_pos, MOST_POSITIVES, 0)).select("doc_id", F.lit(True).alias("positive"))
    ids = ids.union(d.filter(drawn(n_all, MOST_UNLABELLED, 1)).select("doc_id", F.lit(False)))
    # distinct ids, drawn to a bounded number: small enough to broadcast, so only the sample's texts are shuffled
    rows = d.join(F.broadcast(ids.distinct()), "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text")).sortWithinPartitions("doc_id", "positive")
    t = rows.select("positive", "doc_id", "text").mapInArrow(_sample_features, "positive boolean, doc_id long, dense array<float>, terms array<int>").toArrow()
    if not len(t):
        return nothing_known()
    t = t.sort_by([("doc_id", "ascending"), ("positive", "ascending")])
    positive = t["positive"].to_numpy().astype(bool)
    terms = t["terms"].combine_chunks()
    row = np.repeat(np.arange(len(t)), terms.value_lengths().to_numpy())
    sample = positive, t["dense"].combine_chunks().flatten().to_numpy().reshape(-1, N_DENSE).astype(float), row, terms.flatten().to_numpy().astype(np.int64)
    if isinstance(prior, str):
        prior = {"labels": lambda: n_pos / n_known, "unlabelled": lambda: estimate_prior(*sample)}[prior]()
    return fit(*sample, min(max(prior, 0.005), 0.995), STEPS)


def _score(model: Model):
    @K.tidy
    def run(batches):
        for batch in batches:
            out = [model.score(buf, offsets) for _, buf, offsets in K.texts(batch, "text", CHUNK)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([*out, np.zeros(0)]))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float, fold: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold): one row for each row of docs.

    Only the text has a part in a score; null is an empty text, which is scored too. Other columns are ignored.
    """
    out = text_of(docs, id_col, text_col).mapInArrow(_score(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), *fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
