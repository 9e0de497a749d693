from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skysift.llm import jaccard_join as J
from skysift.llm.minhash import shingle_set
from skysift.llm.shingles import shingle_sets


def brute(rows, words=4, percent=85):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", 1, b"") for d, t in rows], "doc_id long, text string, component_id string, n int, prefix binary").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_documents(docs, **options).collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "w%d" % rng.randint(0, 2000)
    passage = [word() for _ in range(50)]
    base = [[word() for _ in range(rng.choice([1, 3, 4, 9, 20, 60, 200]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, len(w) // 40, len(w) // 25, len(w) // 12])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w += passage
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n\t "), (903, "The"), (904, "the"), (905, "the of"), (3, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (None, "quite alone here it stands"), (None, "quite Alone here it stands")]


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (2, 80), (5, 95)])
def test_same_as_brute_force(spark, words, percent):
    rows = corpus(words)
    assert found(spark, rows, words=words, percent=percent) == brute(rows, words, percent)


@pytest.mark.parametrize("alone", [True, False])
def test_small_groups(spark, monkeypatch, alone):
    """Without hubs, the matrix has to find every link."""
    stars = J._stars
    monkeypatch.setattr(J, "_stars", lambda classes, percent: stars(classes, percent).filter(f"{not alone}"))
    monkeypatch.setattr(J, "GROUP", 3)
    monkeypatch.setattr(J, "PARTNERS", 4)
    monkeypatch.setattr(J, "TEXTS", 20)
    rows = corpus(9, 400)
    assert found(spark, rows) == brute(rows)


def test_one_group_of_near_copies_and_a_common_passage(spark):
    rng = random.Random(4)
    base, passage = [f"b{i}" for i in range(120)], " ".join(f"p{i}" for i in range(60))
    near = lambda: " ".join(f"x{rng.randint(0, 10**6)}" if rng.random() < 0.01 else w for w in base)
    rows = [(i, near()) for i in range(400)] + [(1000 + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(100))) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_shingles_of_a_column():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "a", "bb", "É", "z" * 50]) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "\t\n", "x" * 2_500_000 + " y z w v", "x" * 2_500_001 + " y z w v"]
    for words in (1, 4):
        sets = shingle_sets(pa.array(texts).slice(1), words)
        assert [len(s) for s in sets] == [len(shingle_set(t, words)) for t in texts[1:]]
        of = {}
        for t, s in zip(texts[1:], sets):
            key = shingle_set(t, words).tobytes()
            assert of.setdefault(key, s.tobytes()) == s.tobytes()
        assert len(set(of.values())) == len(of)
        assert all((np.diff(s.astype("object")) > 0).all() for s in sets)
    assert shingle_sets(pa.array([], pa.string()), 4) == []


def test_empty_table(spark):
    assert J.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
