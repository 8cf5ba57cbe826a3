import inspect
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import common
from siltstone.llm.quality import quality
from siltstone.llm.queries import ORACLE_SQL
from siltstone.llm.token_output import END_ID, tokenizer_path

from .helpers import ALNUM_WORD, words
from .test_operators import brute_components


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def plain_clean(rows, items):
    """Rows of which less than a twentieth of the words are in windows of 13 words of an item."""
    windows = set()
    for t in items:
        w = words(t, ALNUM_WORD, True)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    out = []
    for i, t in rows:
        w = words(t, ALNUM_WORD, True)
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        if not any(hit) or 20 * sum(hit) < len(w):
            out.append((i, t))
    return out


def plain_mix(docs):
    """Rows by what the SQL of the mix takes from each document."""
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    taken = db.execute(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op8_mixing']})").fetchall()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = Counter()
    for i, size, n in taken:
        if n:
            out[i, texts[i]] += n // size
            if n % size:
                out[i, " ".join(words(texts[i])[: n % size])] += 1
    return +out


def plain_tokens(docs):
    tokenizer, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t in sorted((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_every_stage_against_plain_python(spark, sf):
    import corpus_pipeline

    docs, stages = spark.read.parquet(f"{sf}/documents.parquet"), dict(corpus_pipeline.STAGES)
    run = lambda name, docs: common.written(stages[name](spark, docs, sf), name)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    good = run("quality", docs)
    kept = {r["doc_id"] for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert pairs(good) == Counter((i, t) for i, t in rows(docs) if i in kept) and 0 < len(kept) < docs.count()
    one = run("near_duplicates", good)
    component = brute_components(rows(good))
    assert pairs(one) == Counter((i, t) for i, t in rows(good) if component[i][1] == i) and one.count() < good.count()
    clean = run("decontamination", one)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert pairs(clean) == Counter(plain_clean(rows(one), items))
    mix = run("mixing", clean)
    assert pairs(mix) == plain_mix(clean)
    tokens = run("tokens", mix)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.collect())
    assert [(i, s, n, c) for s, i, n, c in got] == plain_tokens(mix)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, tokens.collect()))


LONG = " ".join(f"w{k}" for k in range(200))


def test_stages_on_odd_rows(spark, sf):
    """Null ids, texts and sources, rows that repeat, and columns with names that the operators use."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    odd = [(None, "a b c"), (None, None), (1, LONG), (1, LONG), (2, LONG + " x"), (3, None), (3, None), (4, ""), (5, "a b c"), (6, "  \n ")]
    docs = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") > 2, "s")})
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(["n_chars", "doc", "n", "component", "digest", "size", "taken", "score", "shard", "place", "__bad_id"][:-1])}).repartition(3)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and not pairs(good) - pairs(docs) and sum(n for (i, _), n in pairs(good).items() if i is None) == 2
    one = stages["near_duplicates"](spark, docs, sf)
    assert one.columns == docs.columns and pairs(one) == Counter(x for x in odd if x[0] != 2)
    clean = stages["decontamination"](spark, docs, sf)
    assert clean.columns == docs.columns and pairs(clean) == Counter(odd)
    mix = stages["mixing"](spark, docs, sf)
    assert mix.columns == docs.columns and {i for i, _ in pairs(mix)} <= {None, 1, 2, 5} and pairs(mix)[1, LONG] >= 2
    tokens = stages["tokens"](spark, docs, sf).collect()
    assert Counter(r["doc_id"] for r in tokens) == Counter(i for i, _ in odd) and [r["n_tokens"] for r in tokens if r["doc_id"] == 4] == [1]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = common.written(out, name)
        n.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert n[0] >= n[1] >= n[2] >= n[3] > 0 and n[4] == n[5] > 0
    assert corpus_pipeline.run(spark, sf).count() == n[5]


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names
    for k in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{k}_")]) == 1
    assert set(e.oracle_sql()) <= set(names)
    assert list(inspect.signature(e.entry).parameters) == ["spark"]


def test_stages_on_empty_documents(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.count() == 0
