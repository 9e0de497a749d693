from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import langid, masked_lm, quality

SYLLABLES = {"xx": ["ba", "do", "ki"], "yy": ["sch", "ung", "ein"], "zz": ["ção", "lha", "mente"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def phrases(text, sample):
    """Greedy longest matches."""
    n, now = 0, ""
    for i, ch in enumerate(text):
        if now + ch in sample:
            now += ch
            n += i == 0
        else:
            n += 1
            now = ch if ch in sample else ""
    return n


@pytest.mark.parametrize("few", [128, 0, 10])
def test_phrases_same_as_brute_force(monkeypatch, few):
    monkeypatch.setattr(langid, "FEW", max(few, 1))
    rng = random.Random(1)
    texts = sorted((k, prose(rng, k, 80)) for k in SYLLABLES)
    parser = langid.Parser(texts)
    some = [prose(rng, "xx", 30), prose(rng, "zz", 900), "Ünknown ж text 12", "a", "ж", "", "  b ", prose(rng, "yy", 300), *(prose(rng, "xx", n) for n in range(1, 12))]
    plain = [parser._plain(t) for t in some]
    symbols = [parser.symbol[np.frombuffer(t.encode("utf-32-le"), "<u4")] for t in plain]
    assert parser.phrases(symbols).tolist() == [[phrases(p, parser._plain(t)) for _, t in texts] for p in plain]


def test_predictions_same_as_brute_force_on_skewed_lengths(spark):
    rng = random.Random(9)
    mixed = lambda n: " ".join(prose(rng, rng.choice(list(SYLLABLES)), 1) for _ in range(n))
    rows = [(i, mixed(rng.choice([1, 2, 5, 30])) + rng.choice(["", " 12 ж"]), rng.choice(list(SYLLABLES))) for i in range(150)] + [(200, mixed(6000), "xx"), (201, prose(rng, "yy", 20000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.sample(docs.filter(~langid.held_out(F.col("doc_id"))), 3000)
    plain = [langid.Parser._plain(t) for _, t in learned]
    for r in langid.predict(docs, learned).collect():
        n = [phrases(langid.Parser._plain(r.text), p) for p in plain]
        best = n.index(min(n))
        assert r.lang_pred == learned[best][0] and r.score == pytest.approx(1 - n[best] / min(n[:best] + n[best + 1 :]))


def test_language_of_held_out_documents(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, k, rng.randint(20, 200)), k) for i, k in enumerate(rng.choice(list(SYLLABLES)) for _ in range(200))]
    rows += [(300, None, "xx"), (301, "", "xx"), (302, "12 ...", "yy"), (303, prose(rng, "yy", 50), None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, score int")
    learned = langid.sample(docs.filter(~langid.held_out(F.col("doc_id"))), 2000)
    got = {r.doc_id: r for r in langid.predict(docs, learned).collect()}
    assert all(got[d].lang_pred == k and 0 < got[d].score <= 1 for d, _, k in rows[:200])
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (300, 301, 302)) and got[303].lang_pred == "yy"
    none = langid.sample(docs.limit(0))
    assert none == [] and {r.lang_pred for r in langid.predict(docs.limit(3), none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), learned).count() == 0


def test_sample_leaves_no_language_out(spark):
    rng = random.Random(5)
    rows = [(f"long{k}", "".join(rng.choices("abcdefgh", k=2500)) + str(k)) for k in range(8)]  # one long text each
    rows += [(f"three{k}", f"{i} " + "".join(rng.choices("abcdefgh", k=800))) for k in range(8) for i in range(3)]
    rows += [("copies", "same text") for _ in range(2000)] + [("copies", f"rare {i} text") for i in range(4)]
    rows += [("many", f"short text {i}") for i in range(3000)]
    got = dict(langid.sample(spark.createDataFrame(rows, "lang string, text string"), 100))
    assert set(got) == {k for k, _ in rows}
    assert all(len(t) >= 100 for k, t in got.items() if k != "copies")
    assert all(t in got["copies"] for t in ("same text", *(f"rare {i} text" for i in range(4))))


def window(text, i):
    raw = [masked_lm.PAD] * masked_lm.SIDE + list((text or "").encode()) + [masked_lm.PAD] * masked_lm.SIDE
    return raw[i : i + 2 * masked_lm.SIDE + 1]


def naive(params, w):
    """The log-probability of a window's centre, by plain loops."""
    e, b, vh, ch, vl, cl = params
    around = w[: masked_lm.SIDE] + w[masked_lm.SIDE + 1 :]
    h = [math.tanh(float(b[k]) + sum(float(e[i][s][k]) for i, s in enumerate(around))) for k in range(masked_lm.HIDDEN)]
    high, low = divmod(w[masked_lm.SIDE], 16)

    def softmax(v, c, at):
        z = [float(c[j]) + sum(h[k] * float(v[k][j]) for k in range(len(h))) for j in range(16)]
        return z[at] - math.log(sum(math.exp(x) for x in z))

    return softmax(vh, ch, high) + softmax(vl[high], cl[high], low)


def test_network_same_as_plain_loops():
    params = [p + np.float32(0.1) for p in masked_lm.initial(3)]
    text = "Größe, ж and more."
    codes, starts = masked_lm.windows_of([masked_lm.bytes_of(t) for t in ("", text, "a")])
    n = len(text.encode())
    assert starts.tolist() == [0, 0, n, n + 1]
    wins = [window(text, i) for i in range(n)] + [window("a", 0)]
    got = masked_lm.log_probabilities(params, codes)
    assert np.allclose(got, [naive(params, w) for w in wins], rtol=1e-4)
    # the distribution over all 256 bytes sums to one
    base = codes[4] & ~(511 << masked_lm.BITS * masked_lm.SIDE)
    every = np.array([base | c << masked_lm.BITS * masked_lm.SIDE for c in range(256)])
    assert abs(np.exp(masked_lm.log_probabilities(params, every).astype(float)).sum() - 1) < 1e-4


def test_parameters_same_whatever_the_fan_in(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(random.Random(i), "yy", 40)) for i in range(30)], "doc_id long, text string")
    windows = masked_lm.count_windows(docs).repartition(9, "code").sortWithinPartitions("code").cache()
    flat = masked_lm._flat(masked_lm.fit(windows, rounds=2, task_windows=60))
    monkeypatch.setattr(masked_lm, "FAN_IN", 2)
    assert np.allclose(masked_lm._flat(masked_lm.fit(windows, rounds=2, task_windows=60)), flat, atol=1e-5)
    windows.unpersist()


def test_gradients_same_as_differences():
    rng = np.random.default_rng(2)
    params = [p.astype("float64") + 0.1 for p in masked_lm.initial(4)]
    codes, _ = masked_lm.windows_of([masked_lm.bytes_of("some text, twice: some text")])
    weight = rng.random(len(codes))
    loss = lambda: -(masked_lm.log_probabilities(params, codes) * weight).sum()
    for p, g in zip(params, masked_lm.gradients(params, codes, weight)):
        used = np.flatnonzero(g.ravel()) if g.any() else np.arange(g.size)
        for at in rng.choice(used, min(6, len(used)), replace=False):
            flat = p.reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - g.ravel()[at]) < 1e-5


def test_masked_lm_scores(spark, monkeypatch):
    rng = random.Random(3)
    greek = lambda n: " ".join("".join(rng.choice(["λο", "γο", "κα", "τη"]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows_first = "ba do ki"
    rows = [(i, prose(rng, "xx", 40)) for i in range(60)] + [(60 + i, greek(40)) for i in range(25)] + [(90, "qzv jwx kqp " * 10), (91, None), (92, ""), (93, "a"), (94, "ΨΩξ χφΔ ΘψΞ " * 10), (95, "long " * 30_000), (0, rows_first)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, mean double, n string").repartition(3)
    monkeypatch.setattr(masked_lm, "HELD_WINDOWS", 500)
    windows = {r.code: r.n for r in masked_lm.count_windows(docs).collect()}
    want: dict[int, int] = {}
    for _, t in rows:
        raw = [masked_lm.PAD] * masked_lm.SIDE + list((t or "").encode()) + [masked_lm.PAD] * masked_lm.SIDE
        for i in range(len(raw) - 2 * masked_lm.SIDE):
            code = 0
            for x in raw[i : i + 2 * masked_lm.SIDE + 1]:
                code = code << masked_lm.BITS | x
            want[code] = want.get(code, 0) + 1
    assert windows == want
    params = masked_lm.fit(masked_lm.written(masked_lm.count_windows(docs)), rounds=12, task_windows=1500)
    got = {r.doc_id: r for r in masked_lm.score(docs, params).collect() if r.n_tokens != len(rows_first)}
    for d, t in rows[:2] + rows[60:62] + [(93, "a")]:
        lp = sum(naive(params, window(t, i)) for i in range(len(t.encode())))
        assert got[d].n_tokens == len(t.encode()) and abs(got[d].log_probability - lp) < 1e-3 * abs(lp)
    assert got[91].mean is None and got[92].log_probability == 0 and got[95].n_tokens == 150_000
    assert got[90].mean < min(got[i].mean for i in range(1, 60)) and got[94].mean < min(got[i].mean for i in range(60, 85))
    assert masked_lm.score_documents(docs.limit(0)).count() == 0


def test_rates_and_posteriors_same_as_plain_formulas(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "yy", 5), rng.choice(["a", "a", "b", "c", None]), rng.choice(["p", "q", None])) for i in range(400)] + [(None, "no id", "a", "p"), (7, "again", "a", "q")]
    labels = [(i, int(rng.random() < {"a": 0.9, "b": 0.4}.get(rows[i][2], 0.7))) for i in range(0, 400, 2)] + [(4, 0), (None, 1), (6, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int")
    known: dict[int, int] = {}
    for d, y in labels:
        if d is not None and y is not None:
            known[d] = min(y, known.get(d, 1))
    paths: dict[tuple, list[int]] = {}
    hosts: dict[object, list[int]] = {}
    for d, _, h, p in rows:
        if d in known:
            for table, key in ((paths, (h, p)), (hosts, h)):
                table.setdefault(key, []).append(known[d])
    total = [y for ys in hosts.values() for y in ys]
    rate = (sum(total) + 1) / (len(total) + 2)

    def weight(groups, centre, free):
        n, over = sum(len(y) for y, _ in groups), len(groups) - free
        clip = lambda p: min(max(p, 1e-3), 1 - 1e-3)
        s = sum(len(y) * (sum(y) / len(y) - clip(centre(k))) ** 2 / (clip(centre(k)) * (1 - clip(centre(k)))) for y, k in groups)
        return 1 / min(max((s - over) / (n - sum(len(y) ** 2 for y, _ in groups) / n - over), 1e-3), 0.5) - 1

    w = weight([(y, h) for h, y in hosts.items()], lambda k: rate, 1)
    of_host = {h: (sum(y) + w * rate) / (len(y) + w) for h, y in hosts.items()}
    w = weight([(y, k[0]) for k, y in paths.items()], lambda k: of_host[k], len(hosts))
    of_path = {k: (sum(y) + w * of_host[k[0]]) / (len(y) + w) for k, y in paths.items()}
    for r in quality.classify(docs, marks, "host", "path").collect():
        prior = of_path.get((r.host, r.path), of_host.get(r.host, rate))
        assert abs(r.prior - prior) < 1e-9
        assert abs(r.posterior - 1 / (1 + math.exp(-(r.evidence + math.log(prior / (1 - prior)))))) < 1e-9 and r.kept == (r.posterior >= 0.5)


def test_quality_keeps_good_and_drops_bad(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        rows.append((i, "!!! ".join(prose(rng, "xx", 60).upper().split()) if bad else prose(rng, "xx", 60) + ".", "hot" if i % 3 else f"h{i % 7}", f"p{i % 2}", "x"))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    labels += [(4, None), (9999, 1), (2, 1)]
    docs = spark.createDataFrame([*rows, (500, None, None, None, "x"), (501, "", "new", "p", "x"), (1, *rows[1][1:])], "doc_id long, text string, host string, path string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, marks, "host", "path").collect()
    assert len(got) == 243 and all(0 <= r.posterior <= 1 for r in got)
    assert all(r.kept == (r.doc_id % 6 != 0) for r in got if r.doc_id < 240)
    for some in (marks.limit(0), marks.filter("quality = 1")):
        assert all(r.kept for r in quality.classify(docs.limit(5), some, "host", "path").collect())
    assert quality.classify(docs.limit(0), marks, "host", "path").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "t", "big", "p") for i in range(400)] + [(1000, "t", "tiny", "p")]
    marks = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(1000, 0)], "doc_id long, label long")
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    rate, hosts, _ = quality.posteriors(docs, marks, "host", "path")
    rates = {r.host: r.host_rate for r in hosts.collect()}
    assert abs(rates["big"] - 0.75) < 0.02 and rates["tiny"] > 0.2 and 0.7 < rate < 0.8
