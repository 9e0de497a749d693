from __future__ import annotations

import math
import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from skysift.llm import decontaminate, topk


def test_top_k_same_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(0, 0.3, 16).tolist(), 0) for i in range(300)] + [(400 + i, [0.5] * 16, 0) for i in range(30)]
    vectors += [(500, None, 0), (520, [1.0, None] * 8, 0), (540, [math.nan] * 16, 0), (560, [math.inf] * 16, 0), (580, [], 0), (601, [0.25] * 4, 0), (602, [1e308], 0), (None, [9.0] * 16, 0)]
    extreme = [(603, [1e15, 1.0], 0), (640, [-3e15, 2.0], 0), (620, [1e300] * 16, 0), (621, [2e300, -1e299], 0), (622, [-1e300], 0), (600, [1e-300, -1e15], 0)]
    for rows, blocks in ((vectors, (8192, 2048)), (vectors, (60, 5)), (vectors + extreme, (60, 5))):
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
        monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
        got = {}
        for r in topk.top_k(topk.quantized(df), F.col("vec_id") % 20 == 0, 7).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        usable = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(64 * x) for x in v)}
        for q in (i for i in usable if i % 20 == 0):
            scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:7]
            assert sorted(got[q]) == [(n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(scores)]
        assert set(got) == {i for i in usable if i % 20 == 0}


def test_reading_stops_when_outsiders_cannot_qualify():
    rng = np.random.default_rng(2)
    x = rng.integers(-5, 5, (2000, 4))
    x[:40] += 60
    lists = topk.SortedLists(np.arange(2000), x.astype(float))
    for query, most in (([3, 2, 1, 4], 0.2), ([-1, -2, 0, -3], 1.0), ([0, 0, 0, 0], 0.0), ([1000, 1, 1, 1], 0.9)):
        q = np.array(query, float)
        found, share = lists.top_k(-1, q, 5)
        s = x @ q
        assert found == [(int(i), int(s[i])) for i in np.lexsort((np.arange(2000), -s))[:5]] and share <= most


def test_repeated_ids_meet_no_own_rows(spark):
    df = spark.createDataFrame([(20, [1.0]), (20, [2.0]), (3, [5.0]), (3, [5.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(topk.quantized(df), F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 3, 64 * 320), (20, 2, 3, 64 * 320)]


def test_top_k_of_empty_and_few(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantized(empty), F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.quantized(two), F.col("vec_id") % 20 == 0).count() == 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window):
    out = []
    for d, text in docs:
        w, hit, names = WORD.findall(low(text)), set(), set()
        for item, body in items:
            b = WORD.findall(low(body))
            n = min(window, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    names.add(item)
        text_ids = ",".join(sorted(map(str, names)))
        out.append((d, len(w), len(hit), len(names), sha256(text_ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_same_as_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["the", "of", "É", "é", "İx", "Σ", "w1", "W2", "w3", "a'b", "x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(20, None), (21, "..."), (2, "again the x")]
    docs = []
    for i in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.5:
            parts += [rng.choice(items)[1] or "", "tail , the"]
        docs.append((i, "; ".join(parts)))
    docs += [(90, None), (91, ""), (92, "..."), (5, docs[5][1]), (93, "the of x " * 4000)]
    for size in (1 << 25, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", size)
        d = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, items string")
        got = sorted(tuple(r) for r in decontaminate.report(d, spark.createDataFrame(items, "item_id int, text string"), 10).collect())
        merged = {}
        for k, t in items:
            merged.setdefault(k, []).append(t)
        want = brute(docs, [(k, t) for k, ts in merged.items() for t in ts], 10)
        assert got == want


def test_decontamination_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.report(docs, none).first().n_hit == 0
    assert decontaminate.report(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id int, text string")).count() == 0


def test_rows_without_or_with_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "the big x of it"), (None, "nothing"), (4, "big x of"), (4, "other"), (4, "big x of")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "big x of"), (None, "other")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.report(docs, items).collect()), key=str)
    assert got == sorted([(None, 5, 3, True), (None, 1, 0, False), (4, 3, 3, True), (4, 3, 3, True), (4, 1, 0, False)], key=str)


def test_words_that_python_would_escape(spark):
    import duckdb
    import pandas as pd

    from skysift.llm.queries import ORACLE_SQL

    odd = ["5\u00a0km", "soft\u00adhyphen", "next\u0085line", "c1\u009f", "zero\u200bwidth", "\ufeffmark", "\U000e0001tag", "\ue000private", "\uffff"]
    items = [(i, f"one two {w} four five six seven eight nine ten eleven") for i, w in enumerate(odd)] + [(50, "plain words only"), (51, odd[0])]
    docs = [(i, f"here {text} there") for i, text in items] + [(60, "one two four five six seven eight nine ten eleven"), (61, "5 km")]
    got = sorted(tuple(r) for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10).collect())
    assert got == brute(docs, items, 10) and sum(r[5] for r in got) == len(items)
    with duckdb.connect() as con:
        con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
        con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
        assert got == sorted(con.execute(ORACLE_SQL["op6_decontamination"]).fetchall())
