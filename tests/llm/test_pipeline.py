from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from skysift.llm import langid
from skysift.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, counts = [n for n, _ in corpus_pipeline.STAGES], []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, DATA))
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
        counts.append((docs.count(), out.count()))
        docs = out
    assert names == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    assert counts[0][0] > counts[0][1] and counts[2][0] > counts[2][1] and counts[3][0] > counts[3][1]
    placed = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert sum(r.length for r in placed) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "do", "ki", "the", "ing"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def words(text):
    out, now = [], ""
    for ch in (text or "") + " ":
        o = ord(ch)
        if ch.isascii() and not ch.isalnum():
            if now:
                out.append(now)
            now = ""
        else:
            now += ch.lower() if o < 128 else ch
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with null and repeated ids, null columns, an empty and a very long text, and clashing columns."""
    rng = random.Random(11)
    item = prose(rng, 14)
    base = [prose(rng, 60) for _ in range(40)]
    docs = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    docs += [(None, base[0] + " more", "en", "s1"), (None, base[1], None, None), (5, base[5], "en", "s1"), (5, base[6] + " x", "en", "s1"), (5, prose(rng, 50), "en", "s2")]
    docs += [(None, prose(rng, 20) + " " + item + " " + prose(rng, 20), "en", "s2"), (60, prose(rng, 30) + "; " + item, "en", "s2"), (61, "", "en", "s1"), (62, None, "en", "s1"), (63, "12 34 .", "en", "s2"), (64, prose(rng, 30_000), "en", "s0"), (65, base[7] + ".", None, "s0")]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(*d, n, "x", 2.5, "y") for n, d in enumerate(docs)], "doc_id long, text string, lang string, source string, row long, lang_pred string, score double, host_rate string").repartition(3)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (None, base[9]), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_same_as_brute_force(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.row: r for r in docs.collect()}

    def kept(name):
        out = stages[name](spark, docs, planted)
        assert out.columns == docs.columns
        found = [r.row for r in out.collect()]
        assert len(set(found)) == len(found)
        return set(found)

    # labels of one kind only: nothing speaks against a document
    assert kept("quality") == set(rows)
    # a text with a letter has a language; learning documents are there
    assert kept("language") == {n for n, r in rows.items() if any(map(str.isalpha, r.text or ""))}
    # one row of each group, that of the least id
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    group = {n: n for n in rows}
    sets = {n: shingles(r.text) for n, r in rows.items()}
    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = group[b], group[a]
                group = {n: new if g == old else g for n, g in group.items()}
    left = kept("near_duplicates")
    assert sorted(group[n] for n in left) == sorted(set(group.values()))
    for n in left:
        ids = [rows[m].doc_id for m in rows if group[m] == group[n]]
        assert rows[n].doc_id == min((i for i in ids if i is not None), default=None)
    # rows with a whole window go, by row
    items = [words(r.text) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect() if r.item_id is not None]
    wins = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    hit = {n for n, r in rows.items() if any(tuple(w[i : i + 10]) in wins for w in [words(r.text)] for i in range(len(w) - 9))}
    assert len(hit) == 2 and kept("decontamination") == set(rows) - hit
    # all tokens are packed once
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for r in rows.values():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, p, 4096 * p, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    placed = stages["packing"](spark, docs, planted).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed), key=str) == sorted(want, key=str)


def test_run_is_its_stages(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    assert out.filter("doc_id = 60").count() == 0 and out.select("sequence_id", "offset").distinct().count() == out.count()
    empty = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, planted).count() == 0
    assert langid.UNKNOWN == "und"
