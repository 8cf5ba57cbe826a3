import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import decontamination, jaccard_join, mixing, simple8b, warc
from siltstone.llm import kernels as K
from siltstone.llm.exact_dedup import MinimalPerfectHash, exact_dedup
from siltstone.llm.substring_dedup import substring_dedup, window_starts
from siltstone.llm.token_output import open_file, read_ids, token_output, tokenizer_path

from .helpers import ALNUM_WORD, corpus, frame, words

ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS for g in [groups[t or ""]]}
    assert rows_of(exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup(empty).collect() == []


def test_exact_dedup_against_history(spark):
    old, new = frame(spark, [(1, "a"), (2, "a"), (9, "z")]), frame(spark, [(3, "a"), (4, "b"), (5, "b"), (6, None)])
    got = rows_of(exact_dedup(new, old), "keep_id", "group_size", "historical")
    assert got == {3: (3, 3, True), 4: (5, 2, False), 5: (5, 2, False), 6: (6, 1, False)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_minimal_perfect_hash(n):
    d = np.random.default_rng(n).integers(0, 256, (n, 32), dtype=np.uint8)
    h = MinimalPerfectHash(d)
    assert sorted(h.slot(d)) == list(range(n))
    other = np.random.default_rng(n + 1).integers(0, 256, (50, 32), dtype=np.uint8)
    assert ((h.slot(other) >= -1) & (h.slot(other) < max(n, 1))).all()


def brute_substring(rows, width=50):
    first, out = {}, {}
    by_id = {i: words(t) for i, t in rows}
    for i in sorted(by_id):
        for k in range(len(by_id[i]) - width + 1):
            first.setdefault(tuple(by_id[i][k : k + width]), i)
    for i, w in by_id.items():
        stay = [True] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                stay[k : k + width] = [False] * width
        kept = " ".join(x for x, s in zip(w, stay) if s)
        out[i] = (len(w), stay.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substring_dedup(docs, empty):
    got = rows_of(substring_dedup(docs, with_text=True), "n_words", "n_removed", "kept_sha256", "kept_text")
    assert got == brute_substring(ROWS)
    assert any(v[1] for v in got.values())
    assert substring_dedup(empty).collect() == []
    assert rows_of(substring_dedup(docs, width=7), "n_words", "n_removed", "kept_sha256") == {i: v[:3] for i, v in brute_substring(ROWS, 7).items()}


def brute_components(rows, width=5, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_join(docs, empty):
    want = brute_components(ROWS)
    assert rows_of(jaccard_join.similar_sets(docs), "n_shingles", "component_id") == want
    assert len({c for _, c in want.values()}) < len(want) - 3
    assert jaccard_join.similar_sets(empty).collect() == []
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_join_of_a_chain_and_many_near_copies(spark):
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(60):
        w = base[:]
        for k in r.integers(0, 60, int(r.integers(0, 5))):
            w[k] = f"v{r.integers(0, 4)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(100 + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(30)]
    assert rows_of(jaccard_join.similar_sets(frame(spark, rows)), "n_shingles", "component_id") == brute_components(rows)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (40, 50), (7, 7), (99, 60), (99, 61)], "a long, b long")
    got = {r["doc"]: r["component"] for r in jaccard_join.components(links).collect()}
    assert got == {**{k: 0 for k in range(21)}, 40: 40, 50: 40, 60: 60, 61: 60, 99: 60}


def test_decontamination(spark, docs, empty):
    base = next(t for i, t in ROWS if t and len(t.split()) == 120)
    long = next(t for i, t in ROWS if t and len(t.split()) == 20_000).split()
    items = [(1, " ".join(base.split()[10:40])), (2, "One"), (3, None), (4, ""), (10, " ".join(long[5000:5013]) + " no"), (11, " ".join(long[:12])), (12, "not there at all"), (10, "THREE")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    got = rows_of(decontamination.decontaminate(docs, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM_WORD, True)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    want = {}
    for i, t in ROWS:
        w, found = words(t, ALNUM_WORD, True), set()
        hit = [0] * len(w)
        for p, who in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit[k : k + len(p)] = [1] * len(p)
                    found |= who
        h = sum(hit)
        want[i] = (len(w), h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0 and 20 * h >= len(w))
    assert got == want
    assert decontamination.decontaminate(empty, bench).collect() == []
    assert all(v[1] == 0 for v in rows_of(decontamination.decontaminate(docs, bench.limit(0)), "n_words", "n_hit").values())
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_in_blocks_and_with_slop(spark, monkeypatch):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b x c d"), (3, "d c b a"), (4, "q a b")])
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c d", "c d e", "q a", "b x"])], "item_id long, text string")
    whole = sorted(decontamination.decontaminate(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BLOCK_PHRASES", 1)
    monkeypatch.setattr(decontamination, "ROW_PHRASES", 1)
    assert sorted(decontamination.decontaminate(docs, bench).collect()) == whole
    near = rows_of(decontamination.decontaminate(docs, bench.filter("item_id = 0"), slop=1), "n_items")
    assert near == {1: (1,), 2: (1,), 3: (0,), 4: (0,)}


def test_mixing(docs, empty):
    m = [r.asDict() for r in mixing.mix(docs).collect()]
    assert {r["doc_id"]: r["size"] for r in m} == {i: len(words(t)) for i, t in ROWS}
    total, per = sum(r["size"] for r in m), Counter()
    for r in m:
        per[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    goal = {r["source"]: r["target"] for r in m}
    assert math.isclose(sum(goal.values()), 1.5 * total)
    assert all(abs(per[s] - goal[s]) <= 1 for s in goal)
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).collect() == []
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    taken = Counter()
    for r in rows.collect():
        taken[r["doc_id"]] += len(words(r["text"]))
    assert {r["doc_id"]: r["taken"] for r in m if r["taken"]} == dict(taken)


def brute_targets(sizes):
    weight = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    budget, full = 1.5 * sum(sizes), set()
    while True:
        left = budget - sum(2 * sizes[k] for k in full)
        w = sum(x for k, x in enumerate(weight) if k not in full)
        out = [2 * s if k in full else left * weight[k] / w for k, s in enumerate(sizes)]
        above = {k for k, x in enumerate(out) if x > 2 * sizes[k] and k not in full}
        if not above:
            return out
        full |= above


@pytest.mark.parametrize("sizes", [[10], [5, 5], [1, 1000, 1], [0, 7, 0], [100, 1, 50, 2, 90], [3, 3, 3, 3000, 3, 3, 3]])
def test_targets(spark, sizes):
    names = [chr(97 + k) for k in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert np.allclose([got[n] for n in names], brute_targets(sizes))


def test_token_output(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    where = f"file://{tmp_path}/tokens"
    got = rows_of(token_output(docs, where), "start", "n_tokens", "ids_crc32")
    start, want, every = 0, {}, []
    for i, text in sorted(ROWS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        every.append(ids)
    assert got == want
    names = sorted(p.name for p in (tmp_path / "tokens").glob("*.s8b"))
    read = []
    for n in names:
        with open_file(where, n) as f:
            read += list(read_ids(f))
    assert (np.concatenate(read) == np.concatenate(every)).all()
    with open_file(where, names[0]) as f:
        assert (next(read_ids(f, 1, 1)) == np.concatenate(every)[simple8b.BLOCK : 2 * simple8b.BLOCK]).all()
    assert token_output(empty).collect() == []


@pytest.mark.parametrize("text", ["a  b", "a  b", "a   b", "x\n\ny", "x \n y", "é été  ñ", "it's 's 'S\n's", "  <|endoftext|>  a <|endoftext|>", "\x1c \x1d a", "tab\t b", "end  ", "é  é ́", "\x85 a\x85 b"])
def test_cut_pieces_have_the_ids_of_the_whole(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from siltstone.llm.token_output import encoder

    t = Tokenizer.from_file(tokenizer_path())
    ids, n = encoder(tokenizer_path()).encode(*K.text_buffer(pa.array([text, None, text])))
    assert ids.tolist() == 2 * t.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids) // 2, 0, len(ids) // 2]


def test_simple8b():
    r = np.random.default_rng(1)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for top in (1, 2, 50_257, 1 << 40, (1 << 64) - 1):
            v = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
            w, a, b = simple8b.encode(v)
            assert (simple8b.decode(w, a, b, np.minimum(1024, n - 1024 * np.arange(len(a)))) == v).all()
    assert len(simple8b.encode(np.zeros(1024, np.uint64))[0]) == 18


def test_warc(spark, tmp_path):
    big, small = "é" * 60, "short"
    pages = [(5, "http://www.A.org:80/b?q#f", big), (3, "https://a.org/b?q", big), (9, None, big), (1, "http://x.net", small), (2, "http://x.net/", small), (7, "http://x.net/\r\nX: y", None), (8, "", "")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, file string")
    got = {r["page_id"]: r.asDict() for r in warc.archive(df, f"file://{tmp_path}/w").collect()}
    assert {i: (r["payload_bytes"], r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        5: (120, "revisit", 3), 3: (120, "response", None), 9: (120, "revisit", 3), 1: (5, "response", None), 2: (5, "response", None), 7: (0, "response", None), 8: (0, "response", None)
    }
    assert all(got[i]["payload_digest"] == hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in pages)
    order = [i for i, _ in sorted(got.items(), key=lambda x: (x[1]["range"], x[1]["place"]))]
    assert order == [i for _, i in sorted((warc.url_key(u), i) for i, u, _ in pages)]
    assert warc.archive(df.limit(0)).collect() == []


def test_url_key():
    assert warc.url_key("http://www.A.org:80/b?c#d") == b"org,a)/b?c"
    assert warc.url_key(None) == b")/" and warc.url_key("https://x.net") == b"net,x)/"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    r = np.random.default_rng(k)
    runs = [sorted((b"k%d" % r.integers(0, 5), int(r.integers(0, 3)), int(r.integers(0, 99)), True, "f", 0, 0) for _ in range(r.integers(0, 20))) for _ in range(k)]
    assert [e[:4] for e in warc.LoserTree(runs)] == sorted(e[:4] for x in runs for e in x)


def test_rolling_windows_and_packing():
    h = np.random.default_rng(2).integers(0, 1 << 63, 3_000_000, dtype=np.uint64)
    h[2_000_000:2_000_100] = h[5:105]
    w = K.windows(h, 50, K.BASES[0])
    assert len(w) == len(h) - 49 and (w[5:56] == w[2_000_000:2_000_051]).all() and len(np.unique(w)) == len(w) - 51
    x = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 1000)
    assert (K.unpack_ints(K.pack_ints(x)) == x).all()


def test_parts_on_empty_input(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert window_starts(docs).collect() == []
    assert decontamination.build_index(docs).collect() == []
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).collect() == []
    some = mixing.targets(spark.createDataFrame([("a", 0), ("b", 10), (None, 0)], "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in some} == {"a": 0, "b": 15, None: 0}


def test_windows_of_odd_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (3, None), (4, "w0 w1"), (5, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in window_starts(docs).collect()} == {2}
