import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import jaccard_join

from ..conftest import ROOT
from .helpers import corpus, frame, words


def sets_of(rows, width=5):
    out = {}
    for i, t in rows:
        w = words(t, lower=True)
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute_links(sets, percent=75):
    return {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)}


def near_copies(n=70):
    r = np.random.default_rng(11)
    rows = []
    for i in range(n):
        w = [f"w{k}" for k in range(80)]
        for k in r.integers(0, 80, int(r.integers(0, 4))):
            w[k] = f"v{r.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(120)]
    return rows + [(200 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(12)] + [(300, None), (301, "one"), (302, "One"), (303, rows[0][1])]


@pytest.mark.parametrize(("block", "heavy"), [(1 << 10, 32), (7, 2), (7, 1000)])
def test_every_link_is_counted(spark, monkeypatch, block, heavy):
    """With groups in one block, in many blocks, and without groups."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard_join, "HEAVY", heavy)
    rows = near_copies()
    sets = sets_of(rows)
    links = brute_links(sets)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.similar_sets(frame(spark, rows)).collect()}
    rep = {i: min(j for j, s in sets.items() if s == x) if x else i for i, x in sets.items()}
    assert got == {i: (rep[i], sum(i in pair for pair in links)) for i in sets}
    assert len(links) > 5 * len(rows)  # far more than a spanning tree has
    pairs = jaccard_join.similar_pairs(frame(spark, rows)).collect()
    want = {p: n for p, n in links.items() if rep[p[0]] == p[0] and rep[p[1]] == p[1]}
    assert len(pairs) == len(want) and {(r["a"], r["b"]): r["overlap"] for r in pairs} == want


def test_links_of_odd_documents(spark):
    rows = corpus()
    links = brute_links(sets_of(rows))
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.similar_sets(frame(spark, rows)).collect()}
    assert got == {i: sum(i in pair for pair in links) for i, _ in rows}
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (3, "")]
    assert sorted((r["doc_id"], r["n_links"]) for r in jaccard_join.similar_sets(frame(spark, twice)).collect()) == [(1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    assert jaccard_join.similar_pairs(frame(spark, [])).collect() == []


def test_a_template_below_the_threshold(spark):
    """Sets that share four fifths of their sentences with all others, but link with none: no pairs are spelt out."""
    r = np.random.default_rng(5)
    sentence = lambda tag, k: " ".join(f"{tag}{k}x{j}" for j in range(6))
    rows = []
    for i in range(600):
        own = [sentence("own", k) for k in r.choice(900, 10, replace=False)]
        rows.append((i, " ".join([sentence("all", k) for k in range(26)] + own)))
    _, sets = jaccard_join._classes(frame(spark, rows), 5, 75, "doc_id", "text")
    prefixes = jaccard_join._prefixes(sets)
    groups = jaccard_join._groups_of(prefixes)
    candidates = jaccard_join._candidates(prefixes, groups, 75).count()
    assert candidates <= jaccard_join.HEAVY * len(rows)  # of 179,700 pairs
    links = brute_links(sets_of(rows))
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.similar_sets(frame(spark, rows)).collect()}
    assert got == {i: sum(i in pair for pair in links) for i in range(600)}


def test_a_forest_connects_what_links_connect():
    r = np.random.default_rng(4)
    for n in (2, 10, 60):
        a, b = r.integers(0, n, (2, n))
        a, b = a[a != b], b[a != b]
        few = jaccard_join._forest(a, b, n)
        root = {i: {i} for i in range(n)}
        for x, y in zip(a, b):
            both = root[x] | root[y]
            root |= dict.fromkeys(both, both)
        again = {i: {i} for i in range(n)}
        for x, y in zip(a[few], b[few]):
            assert again[x] is not again[y] and y not in again[x]
            both = again[x] | again[y]
            again |= dict.fromkeys(both, both)
        assert root == again


def test_hashes_without_their_bucket():
    h = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    for buckets in (64, 1 << 12, 1 << 20):
        for k in np.unique(at := jaccard_join._gram_bucket(h, buckets))[:5]:
            own = h[at == k]
            short = jaccard_join._without_bucket(own, buckets)
            assert (np.diff(short) >= 0).all() and (jaccard_join._with_bucket(short, int(k), buckets) == own).all()


def test_overlaps_in_pieces(monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELLS", 1)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, 150)) for _ in range(9)]
    got = jaccard_join._overlaps(np.concatenate(sets), np.array([len(s) for s in sets]), slice(0, 4), slice(4, 9))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[4:]] for x in sets[:4]]


@pytest.mark.parametrize("run", ["_resolve(64)", "_alive(75)", "_frequencies(64)", "_sets(75)"])
def test_a_bucket_in_a_new_process(run):
    """A Python worker in which no other step has run yet: it has only what the module itself imports. Tables come as in Spark."""
    sink = pa.BufferOutputStream()
    row = [pa.array([5], pa.int32()), pa.array(["none"]), *[pa.array([b""], pa.binary())] * 4]
    with pa.ipc.new_stream(sink, jaccard_join.ROW) as stream:
        stream.write_batch(pa.record_batch(row, schema=jaccard_join.ROW))
    code = f"import sys, pyarrow as pa, siltstone.llm.jaccard_join as J; print(len(J.{run}(pa.ipc.open_stream(sys.stdin.buffer).read_all())))"
    done = subprocess.run([sys.executable, "-c", code], input=sink.getvalue().to_pybytes(), env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True)
    assert (done.stdout, done.returncode) == (b"0\n", 0), done.stderr.decode()
