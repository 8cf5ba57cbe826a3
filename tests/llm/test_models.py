import zlib

import numpy as np
import pytest

from siltstone.llm import language_id, pu_learning, quality, toxicity

from .helpers import corpus, frame

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity.toxicity, "toxic", 0.85), (quality.quality, "quality", 0.95)])
def test_held_out_rows_are_told_apart(tables, operator, label, least):
    docs, labels = tables
    got = operator(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    t = got.merge(labels.toPandas(), on="doc_id")
    t = t[t["held_out"]]
    assert auc(t["score"].to_numpy(), t[label].to_numpy()) > least
    assert ((t["predicted"] == 1) == (t["score"] >= (0.5 if label == "toxic" else 0.3))).all()


def test_labels_of_the_held_out_fold_have_no_part(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (pu_learning.train(docs, x, "toxic") for x in (labels, turned))
    assert a.bias == b.bias and (a.terms == b.terms).all()


def test_odd_inputs(spark):
    docs = frame(spark, corpus())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.0} and {r["predicted"] for r in got} == {0}
    some = spark.createDataFrame([(r["doc_id"], None if k % 5 == 0 else k % 2, k % 2) for k, r in enumerate(docs.collect())] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, some).count() == docs.count()
    assert quality.keep_good(docs, some).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), some).collect() == []


def test_the_risk_is_never_fitted_below_zero():
    z = np.array([3.0, 3.0, -9.0, -9.0])
    positive = np.array([True, True, False, False])
    value, grad = pu_learning.risk(z, positive, 0.9)
    assert value >= 0 and (grad[:2] > 0).all() and (grad[2:] < 0).all()  # the negative part is brought up
    near = 1e-6
    z = np.array([0.3, -0.2, 0.5, 0.1])
    value, grad = pu_learning.risk(z, positive, 0.2)
    for k in range(4):
        step = np.eye(4)[k] * near
        assert np.isclose((pu_learning.risk(z + step, positive, 0.2)[0] - value) / near, grad[k], atol=1e-4)


@pytest.mark.parametrize(("label", "share"), [("quality", 0.2), ("quality", 0.5), ("quality", 0.8)])
def test_the_prior_is_that_of_the_unlabelled_rows(spark, tables, label, share):
    """Positives are half of the labelled rows, whatever their share of the corpus."""
    r = np.random.default_rng(5)
    good, bad = [f"good{k}" for k in range(60)], [f"bad{k}" for k in range(60)]
    rows, marks = [], []
    for i in range(3000):
        own = r.random() < share
        rows.append((i, " ".join(r.choice(good if own else bad, 12)) + " " + " ".join(r.choice(good + bad, 6))))
        marks.append(own)
    pos, neg = (np.flatnonzero(np.array(marks) == kind)[:300] for kind in (True, False))
    labels = spark.createDataFrame([(int(i), 1) for i in pos] + [(int(i), 0) for i in neg], f"doc_id long, {label} int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert abs(pu_learning.train(docs, labels, label).prior - np.mean(marks)) < 0.05
    assert abs(pu_learning.train(docs, labels, label, "labels").prior - 0.5) < 0.05
    assert pu_learning.train(docs, labels, label, 0.3).prior == 0.3


def plain_features(text):
    """A dense row and the set of terms, of one text on its own."""
    from siltstone.llm import kernels as K

    buf = np.frombuffer(text.encode(), np.uint8)
    dense, _, term = pu_learning.features(buf, np.array([0, len(buf)]))
    return dense[0], sorted(set(term.tolist()))


@pytest.mark.parametrize(("operator", "label", "threshold"), [(toxicity.toxicity, "toxic", 0.5), (quality.quality, "quality", 0.3)])
def test_the_query_equals_a_plain_trainer(tables, operator, label, threshold, monkeypatch):
    """Scores of the whole table against a loop over dense matrices, trained on the same rows."""
    monkeypatch.setattr(pu_learning, "STEPS", 40)
    docs, labels = tables
    prior = 0.3
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in operator(docs, labels, prior=prior).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    mine = sorted(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    rows = sorted([(i, True) for i in mine if known.get(i) == 1] + [(i, False) for i in mine])
    every = {i: plain_features(t) for i, t in texts.items()}
    positive = np.array([p for _, p in rows])
    df = {True: {}, False: {}}
    for i, p in rows:
        for term in every[i][1]:
            df[p][term] = df[p].get(term, 0) + 1
    n_p, n_u, n = positive.sum(), (~positive).sum(), len(rows)
    z = {}
    for term in sorted(df[True].keys() | df[False].keys()):
        a, b = df[True].get(term, 0), df[False].get(term, 0)
        share = (a + b) / n
        if a + b >= 5:
            z[term] = abs(a / n_p - b / n_u) / np.sqrt(max(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
    chosen = sorted(t for t in sorted(z, key=lambda t: (-z[t], t))[: pu_learning.MOST_TERMS] if z[t] >= 3)
    dense = np.array([every[i][0].astype(np.float32).astype(float) for i, _ in rows])
    mean, std = dense.mean(axis=0), dense.std(axis=0)
    std[std < 1e-9] = np.inf
    place = {t: k for k, t in enumerate(chosen)}
    one_hot = lambda terms: np.array([t in terms for t in chosen], float)
    x = np.hstack([np.ones((n, 1)), (dense - mean) / std, np.array([one_hot(set(every[i][1])) for i, _ in rows])])
    assert len(place) == len(chosen)
    w = np.zeros(x.shape[1])
    w[0] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, pu_learning.STEPS + 1):
        s = x @ w
        sig = 1 / (1 + np.exp(-s))
        p, u = x[positive], x[~positive]
        kept = np.log1p(np.exp(s[~positive])).mean() - prior * np.log1p(np.exp(s[positive])).mean()
        up = (sig[~positive][:, None] * u).mean(axis=0) - prior * (sig[positive][:, None] * p).mean(axis=0)
        grad = prior * ((sig[positive] - 1)[:, None] * p).mean(axis=0) + up if kept >= 0 else -up
        grad[1:] += 1e-4 * w[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    for i, (d, terms) in every.items():
        s = 1 / (1 + np.exp(-(w @ np.concatenate([[1.0], (d - mean) / std, one_hot(set(terms))]))))
        assert abs(got[i][0] - s) < 1e-3 and (got[i][1] == (s >= threshold) or abs(s - threshold) < 1e-3)


def test_language_id(tables):
    docs, _ = tables
    got = language_id.language_id(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    t = got[got["held_out"]]
    assert (t["lang"] == t["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_id_of_odd_texts(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert (got[i][0] == "und") == (not any(c.isalpha() for c in t or "")), t
    assert language_id.language_id(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(docs, language_id.fit({}, language_id.vocabulary())).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"bc", b" ab", b"abc"})
    table = language_id.Pieces(pieces)
    prob = np.random.default_rng(0).random((len(pieces) + 1, 2))
    prob[-1] = 0

    def brute(word, k):
        if not word:
            return 1.0
        return sum(prob[pieces.index(word[:n]), k] * brute(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in pieces)

    words = [b" abcabc", b" abab", b" ab", b" x"]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    alpha = language_id.forward(table.lattice(buf, starts, ends), starts, ends - starts, prob)
    for i, w in enumerate(words):
        assert np.allclose(alpha[len(w), i], [brute(w, 0), brute(w, 1)])
    counts = language_id.expected_counts(table.lattice(buf, starts, ends), starts, ends - starts, np.ones(4), prob[:, 0])
    total = sum(c * len(p) for c, p in zip(counts, pieces))
    assert np.isclose(total, len(buf))  # every byte is in one piece
