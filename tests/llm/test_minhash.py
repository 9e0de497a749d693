from __future__ import annotations

import random

import pytest

from skysift.llm import minhash
from skysift.llm.components import components


def brute(rows, words):
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
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "w%d" % rng.randint(0, 3000)
    rows, base = [], [[word() for _ in range(rng.choice([1, 2, 6, 12, 30, 80, 200]))] for _ in range(25)]
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, len(w) // 20, len(w) // 12])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \n\t "), (903, "The"), (904, "the"), (905, "the of"), (906, "é É"), (3, rows[3][1])]


@pytest.mark.parametrize("long_list", [48, 2])
@pytest.mark.parametrize("words", [2, 5])
def test_same_as_brute_force(spark, monkeypatch, words, long_list):
    monkeypatch.setattr(minhash, "LONG_LIST", long_list)
    monkeypatch.setattr(minhash, "INNER_BLOCK", 16)
    rows = corpus(words)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, component_id string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words, 80).collect())
    assert got == brute(rows, words)


def test_heavy_values_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG_LIST", 4)
    monkeypatch.setattr(minhash, "HEAVY_VALUES", 1000)
    rows = corpus(7)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect())
    assert got == brute(rows, 2)


@pytest.mark.parametrize("same", [None, 7])
def test_many_rows_of_one_id(spark, same):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(400)]
    rows = [(same, t + (" end" if i % 2 else "")) for i in range(25) for t in base] + [(same, None), (same, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    groups = minhash.row_groups(docs, 5, 80).collect()
    assert len(groups) == len(rows) and sum(r.first for r in groups) == 402 and {r.component_id for r in groups} == {same}
    assert len({r.rid for r in groups}) == len(rows)
    found = minhash.near_duplicates(docs, 5, 80).collect()
    assert sum(r.kept for r in found) == (402 if same is None else len(rows))


def test_rows_without_an_id_give_way(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, text), (9, text + " end"), (4, text), (None, "quite another text of six words")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2, 80).collect()), key=str)
    assert got == [(0, 4, False), (0, None, True), (4, 4, True), (9, 4, False)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(80, 81), (81, 82), (82, 80)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 81: 80, 82: 80}
