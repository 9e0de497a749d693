from __future__ import annotations

import random
from itertools import permutations

import pytest

from skysift.llm import filter_audit as A
from skysift.llm.queries import AUDITED

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(rows, labels):
    """rows: (doc_id, text, part)."""
    import re

    texts = {}
    for d, t, _ in rows:
        if d is not None:
            texts.setdefault(t or "", []).append(d)

    def fails(d, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        if len(w) < 100:
            out.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            out.add("C")
        if re.search(r"[#$%&*|]", t):
            out.add("D")
        if d is not None and any(x < d for x in texts[t]):
            out.add("E")
        return out

    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    out = {}
    for part in {p or "" for *_, p in rows}:
        mine = [(d, fails(d, t)) for d, t, p in rows if (p or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        table = {}
        for order in permutations("ABCDE"):
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in mine[i][1]]
                went = [i for i in range(len(mine)) if i not in left and f in mine[i][1]]
                left = [i for i in left if f not in mine[i][1]]
                removed[f] += len(gone)
                table[part, "".join(order), step] = (
                    len(left), len(gone), len(went), sum(x == {f} for _, x in mine), sum(mine[i][0] in good for i in gone), sum(mine[i][0] in toxic for i in gone),
                )
        out |= {k: (*v, removed[k[1][k[2] - 1]]) for k, v in table.items()}
    return out


def found(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1, "x") for d, t, p in rows], "doc_id long, text string, lang string, mask int, part string")
    out = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), AUDITED, part="lang").collect()
    assert len({(r.part, r.filter_order, r.step) for r in out}) == len(out)
    return {(r.part, r.filter_order, r.step): (*(r[c] for c in COLUMNS), r.shapley) for r in out}


def test_same_as_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "Of", "AND", "w%d" % rng.randint(0, 500)])
    pool = [" ".join(word() for _ in range(rng.choice([3, 99, 100, 101, 300]))) + rng.choice(["", "", " #", " a|b"]) for _ in range(25)]
    rows = [(rng.randint(0, 40), rng.choice(pool), rng.choice(["en", "fr", None, ""])) for _ in range(120)]
    rows += [(None, pool[0], "en"), (None, pool[0], "en"), (5, None, "fr"), (7, "", "fr"), (7, "", "fr"), (900, "X" * 5000 + " é" * 150, "en"), (901, " ".join("u%d" % i for i in range(20000)), "de")]
    labels = [(i, i % 3 - 1, i % 2) for i in range(50)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None)]
    assert found(spark, rows, labels) == brute(rows, labels)


def test_one_text_in_a_third_of_the_rows(spark):
    rows = [(i, "same text again" if i % 3 == 0 else f"text {i}", "en") for i in range(3000)]
    got = found(spark, rows, [(0, 1, 0)])
    assert got["en", "EABCD", 1][:4] == (2001, 999, 0, 0) and len(got) == 600


def test_empty_tables_and_other_filters(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty, labels, AUDITED).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "#", "x")], "doc_id long, text string, lang string")
    got = {(r.filter_order, r.step): r.removed for r in A.audit(docs, labels, {"h": A.holds("#"), "w": A.fewer_words(2)}).collect()}
    assert got == {("hw", 1): 1, ("hw", 2): 0, ("wh", 1): 1, ("wh", 2): 0}
    with pytest.raises(ValueError):
        A.audit(docs, labels, {})
