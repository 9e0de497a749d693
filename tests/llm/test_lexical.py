from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skysift.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in asked.items():
        scores = []
        for (d, _), w, c in zip(docs, words, counts):
            if not w:
                continue
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["The", "of", "AND", "in"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 900}"
    text = lambda: rng.choice([" ", ", ", "\n", "-"]).join(word() for _ in range(rng.choice([1, 5, 30, 200])))
    docs = [(i, text()) for i in range(n)]
    docs += [(docs[i][0], docs[i][1]) for i in range(20)] + [(1000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (2000, None), (2001, ""), (2002, " .,"), (2003, "Ünïcode É 3.5 x" * 3), (2004, "of " * 20000 + "w7")]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 25])))) for i in range(30)] + [(3, "w7 w8"), (None, "the"), (77, None), (78, "?"), (79, "absent"), (80, "É x 5 of"), (81, docs[3][1])]
    return docs, items


@pytest.mark.parametrize(("k", "window"), [(5, 2048), (50, 64), (1000, 16)])
def test_same_as_brute_force(spark, monkeypatch, k, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    docs, items = corpus(k)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n int, score int").repartition(3)
    got = lexical.search(df, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"), k).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, k)


def test_query_set_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 500)
    docs, items = corpus(3, 100)
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(str(i), t) for i, t in items if i is not None], "item_id string, text string"), 7).collect()
    assert sorted(((int(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items, 7)


def test_long_lists_are_skipped_and_short_ones_summed():
    rng = np.random.default_rng(1)
    n, weight = 8192, np.array([50, 60, 5000, 6000], "int64")
    doc = np.concatenate([np.sort(rng.choice(n, size, replace=False)) for size in (8000, 7000, 100, 60)])
    term = np.repeat(np.arange(4), (8000, 7000, 100, 60))
    block = lexical.Block(doc, term, np.ones(len(doc), "int64"), np.full(n, 100), weight)
    best, none, ids = lexical.Best(10, 1), np.zeros(n, bool), np.arange(n)
    assert len(block.accumulated(np.array([2, 3]))[0]) < 161
    entered = block.search(np.arange(4), best, none, ids)
    scores = np.bincount(doc, block_impacts(doc, term, weight), n)
    assert best.scores.tolist() == sorted(scores.astype("int64").tolist(), reverse=True)[:10]
    # only the first window reads the long lists
    assert entered < 8000


def block_impacts(doc, term, weight):
    return weight[term] * (1_000_000_000 // (1000 + 20 * 100))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).count() == 0
