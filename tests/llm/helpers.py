"""Small documents with the odd cases every operator must stand, and brute-force forms of the contracts."""

import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, hash string, kind string"


def corpus(seed=1):
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, a very long text and short ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base, passage = words(120), words(70)
    texts = [None, "", "   \n\t ", "One", "One", "one two THREE", "a b c d", "!!! 123", "  lead and trail  \n"]
    texts += [" ".join(base)] * 3
    for edits in (1, 3, 6, 12, 25):
        w = base[:]
        for _ in range(edits):
            w[r.randrange(len(w))] = r.choice(vocabulary) + "x"
        texts.append(" ".join(w).upper() if edits == 3 else " ".join(w))
    for _ in range(8):
        texts.append(" ".join(words(r.randint(0, 60)) + passage[: r.choice([13, 49, 50, 70])] + words(r.randint(0, 60))))
    texts += [" ".join(words(20_000)), "x" * 100_000, " odd spaces  two\r\nlines\x0btabs", "日本語 の 文章", "<|endoftext|> a  <|endoftext|>b"]
    texts += [" ".join(words(r.randint(1, 200))) for _ in range(25)]
    ids = list(range(10, 10 + len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def frame(spark, rows, parts=3):
    """documents of (doc_id, text), with columns whose names operators use inside."""
    full = [(i, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], None if t is None else len(t), k, "h", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text, pattern=SPACE_WORD, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)
