"""Crowded keys: what is split, summed or drawn gives the same as the plain way."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.functions import quantiles as Q
from skysift.operators import cluster, encounters, lightcurve, replicates, shape, spectra

c = F.col


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_by_selection(spark, monkeypatch, keys):
    df = spark.range(30000).select((c("id") % 3).alias("k"), F.when(c("id") % 7 > 0, F.when(c("id") % 2 == 0, 5.0).otherwise((c("id") * 7919 % 10007) / 7.0)).alias("v"))
    df = df.union(spark.createDataFrame([(1, float("nan")), (9, None)], "k long, v double"))
    at = [0.0, 0.03, 0.5, 0.55, 0.9, 1.0]
    plain = df.filter("v IS NOT NULL AND NOT isnan(v)").groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, at))).alias("q"))
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, Q.quantiles(df, keys, "v", at).collect())) == want
    monkeypatch.setattr(Q, "SMALL", 10)
    assert sorted(map(tuple, Q.quantiles(df, keys, "v", at).collect())) == want
    assert [r.q for r in Q.quantiles(df.filter("false"), keys, "v", at).collect()] == ([None] if not keys else [])


def brute_neighbours(points, k):
    out = []
    for i, (key, _, *x) in enumerate(points):
        d = sorted(math.dist(x, y) for j, (other, _, *y) in enumerate(points) if j != i and other == key)
        out.append(d[k - 1] if len(d) >= k else None)
    return out


@pytest.mark.parametrize(("n_axes", "k"), [(1, 1), (3, 2), (5, 1), (5, 3)])
def test_neighbours_with_a_crowded_place(spark, n_axes, k):
    rng = random.Random(n_axes)
    place = lambda scale: tuple(rng.gauss(0, scale) for _ in range(n_axes))
    points = [(i % 2, i, *place(10.0)) for i in range(120)] + [(0, 500 + i, *place(0.001)) for i in range(60)] + [(1, 700 + i, *([3.0] * n_axes)) for i in range(90)] + [(1, 9000, *([1e7] * n_axes)), (2, 9001, *place(1.0))]
    names = [f"x{i}" for i in range(n_axes)]
    df = spark.createDataFrame([*points, (0, 9999, *([float("nan")] + [0.0] * (n_axes - 1)))], "g int, source_id long, " + ", ".join(f"{x} double" for x in names))
    got = {r.source_id: r.distance for r in cluster.kth_neighbour(df, ["g"], names, k, 1.0).collect()}
    want = dict(zip((p[1] for p in points), brute_neighbours(points, k)))
    assert got.pop(9999) is None and len(got) == len(want)
    for i, d in want.items():
        assert got[i] == (None if d is None else pytest.approx(d, abs=1e-12))


@pytest.mark.parametrize(("n_axes", "k"), [(1, 1), (3, 2), (5, 1)])
def test_neighbours_in_replicates(spark, monkeypatch, n_axes, k):
    monkeypatch.setattr(replicates, "BOX", 40)
    rng = np.random.default_rng(n_axes)
    x = np.concatenate([rng.normal(0, 10, (300, n_axes)), rng.normal(3, 0.01, (100, n_axes)), np.full((30, n_axes), 5.0), np.full((1, n_axes), 1e6)])
    member = rng.random((len(x), 9)) < [0.3, 0.05, 0.5, 0.01, 0.2, 0.1, 0.2, 0.02, 0.4]
    names = [f"x{i}" for i in range(n_axes)]
    rows = [(*map(float, p), np.packbits(m).tobytes()) for p, m in zip(x, member)]
    rows.append((float("nan"), *([0.0] * (n_axes - 1)), b"\xff\xff"))
    df = spark.createDataFrame(rows, ", ".join(f"{a} double" for a in names) + ", bits binary").repartition(3)
    want = []
    for r in range(9):
        mine = x[member[:, r]]
        for i, p in enumerate(mine):
            d = np.sort(np.delete(np.sqrt(((mine - p) ** 2).sum(axis=1)), i))
            want += [(r, d[k - 1])] if len(d) >= k else []
    got = sorted((r.rep, r.distance) for r in replicates.kth_in_replicates(df, names, k, 8).collect())
    assert [a for a, _ in got] == [a for a, _ in sorted(want)]
    assert np.allclose([b for _, b in got], [b for _, b in sorted(want)], rtol=1e-12, atol=1e-12)


def test_replicates_hold_the_matched_draws(spark):
    parent = spark.range(600).select(c("id").alias("source_id"), F.when(c("id") < 3, 1).otherwise(c("id") % 4 + 2).cast("long").alias("stratum"), (c("id") * 1.0).alias("x"))
    anomalies = spark.createDataFrame([(1,)] * 8 + [(2,)] * 30 + [(3,)] * 149 + [(4,)], "stratum long")
    want = Counter((r.rep, r.x) for r in cluster.matched_draws(parent, anomalies, 20).collect())
    sizes = anomalies.groupBy("stratum").agg(F.count(F.lit(1)).alias("_want"))
    rows, pools = cluster.numbered(parent.join(sizes.select("stratum"), "stratum", "left_semi"))
    got = Counter()
    for r in replicates.with_replicates(rows.join(sizes, "stratum").join(pools, "stratum"), ["x"], 20, cluster.STRIDES).collect():
        got.update((int(i), r.x) for i in np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))))
    assert got == want


def test_draws_follow_the_strata(spark):
    parent = spark.range(5000).select(c("id").alias("source_id"), F.when(c("id") < 5, 1).when(c("id") < 100, 2).otherwise(3).cast("long").alias("stratum"))
    anomalies = spark.createDataFrame([(1,)] * 8 + [(2,)] * 60 + [(3,)] * 40 + [(4,)], "stratum long")
    draws = cluster.matched_draws(parent, anomalies, 50).collect()
    by = Counter((r.rep, r.stratum) for r in draws)
    assert set(by.values()) == {8, 60, 40} and len(by) == 150
    for rep in range(50):
        for stratum in (2, 3):
            mine = [r.source_id for r in draws if (r.rep, r.stratum) == (rep, stratum)]
            assert len(set(mine)) == len(mine)  # without replacement
    assert len({r.source_id for r in draws if r.stratum == 1}) == 5
    sets = {tuple(sorted(r.source_id for r in draws if (r.rep, r.stratum) == (rep, 3))) for rep in range(50)}
    assert len(sets) == 50 and len({r.source_id for r in draws if r.stratum == 3}) > 1200
    again = cluster.matched_draws(parent.repartition(7), anomalies, 50).collect()
    assert Counter((r.rep, r.draw, r.stratum, r.source_id) for r in again) == Counter((r.rep, r.draw, r.stratum, r.source_id) for r in draws)


def test_injected_cluster_is_over_clustered(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(0, 360), rng.uniform(-40, 40), rng.uniform(2, 10), rng.gauss(0, 30), rng.gauss(0, 30), rng.uniform(8, 16), rng.uniform(0, 3), rng.gauss(0, 1)) for i in range(6000)]
    rows += [(20000 + i, 100 + rng.gauss(0, 0.5), 10 + rng.gauss(0, 0.5), 5 + rng.gauss(0, 0.01), 20 + rng.gauss(0, 0.3), -10 + rng.gauss(0, 0.3), rng.uniform(8, 16), rng.uniform(0, 3), 9.0) for i in range(30)]
    df = spark.createDataFrame(rows, "source_id long, ra double, dec double, parallax double, pmra double, pmdec double, phot_g_mean_mag double, bp_rp double, z double")
    df = encounters.tangential_velocity(encounters.galactic_position(df))
    tests, groups = cluster.cluster_run(df, "z", reps=60, features=())
    got = {r.space: r for r in tests.collect()}
    assert set(got) == {"position", "velocity", "phase"} and all(r.n_anom == r.n_excess == 30 and r.over_clustered and r.z < -3 for r in got.values())
    assert [r.n for r in groups.collect()][:1] == [30]
    none = {r.space: (r.n_anom, r.p_value) for r in cluster.cluster_run(df.withColumn("z", F.lit(0.0)), "z", reps=5)[0].collect()}
    assert none == dict.fromkeys(got, (0, None))


def curves(seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for source, n in ((1, 400), (2, 60), (3, 15), (4, 300)):
        t = np.sort(rng.uniform(0, 40, n))
        mag = 12 + 0.1 * np.sin(2 * np.pi * t / 1.7) + rng.normal(0, 0.03, n) + (0.4 * (np.abs(t % 7 - 3) < 0.2)) if source != 4 else np.full(n, 12.0)
        rows += [(source, float(a), float(b), 0.02 + 0.01 * (i % 3), i) for i, (a, b) in enumerate(zip(t, mag))]
    return rows


@pytest.mark.parametrize("name", ["periods", "dip_periods"])
def test_periodogram_of_a_source_in_pieces(spark, monkeypatch, name):
    df = spark.createDataFrame(curves(), "source_id long, mjd double, mag double, magerr double, tiebreak long").repartition(5)
    run = lambda: {r.source_id: r for r in getattr(lightcurve, name)(df, ["source_id"]).collect()}
    want = run()
    monkeypatch.setattr(lightcurve, "WHOLE", 50)
    monkeypatch.setattr(Q, "SMALL", 20)
    got = run()
    assert set(got) == set(want)
    for k, r in want.items():
        for x in r.asDict():
            assert got[k][x] == (pytest.approx(r[x], rel=1e-6, abs=1e-9) if isinstance(r[x], float) else r[x])


def test_peaks_are_taken_from_the_left(spark):
    def scan(mf, least, apart=3):
        out, i, n = [], 1, len(mf)
        while i < n - 1:
            if mf[i] >= least and mf[i] >= mf[i - 1] and mf[i] >= mf[i + 1]:
                lo, hi = max(0, i - apart), min(n, i + apart + 1)
                out.append((i, lo + int(np.argmax(mf[lo:hi]))))
                i = hi
            else:
                i += 1
        return out

    rng = random.Random(3)
    rows, want = [], {}
    for s in range(40):
        mf = [float(rng.choice([0, 1, 2, 3, 4, 5, 5, 6, 7])) for _ in range(rng.choice([5, 30, 80]))]
        rows += [(s, i, x, len(mf)) for i, x in enumerate(mf)]
        want[s] = scan(mf, 4)
    df = spark.createDataFrame(rows, "spec_id long, pix int, strength double, n int")
    got = {s: [] for s in want}
    for r in spectra.peaks(df, 4.0, 3, ["spec_id"]).orderBy("spec_id", "from_pix").collect():
        got[r.spec_id].append((r.from_pix, r.at))
    assert got == want


def test_anchor_and_own_errors_are_drawn(spark):
    schema = "source_id long, ra double, dec double, parallax double, pmra double, pmdec double, radial_velocity double, parallax_error double, pmra_error double, pmdec_error double, radial_velocity_error double"
    star = lambda i, e: (i, 12.0, 6.0, 80.0, 50.0, -20.0, 30.0, *e)
    anchor = lambda e: spark.createDataFrame([(1, 10.0, 5.0, 100.0, 0.0, 0.0, -10.0, *e)], schema)
    none, some = (0.0, None, -1.0, float("nan")), (1.0, 1.0, 1.0, 1.0)
    stars = spark.createDataFrame([star(2, none), star(3, some), (4, 1.0, 1.0, None, 0.0, 0.0, 5.0, *some)], schema)
    spread = lambda r: r.d_min_pc_84 - r.d_min_pc_16
    fixed = {r.source_id: r for r in encounters.encounter_uncertainty(stars, anchor(none), 200).collect()}
    assert spread(fixed[2]) == 0 and spread(fixed[3]) > 0 and fixed[4].n_valid == 0 and fixed[4].robust is False and fixed[4].d_min_pc_50 is None
    moved = {r.source_id: r for r in encounters.encounter_uncertainty(stars, anchor(some), 200).collect()}
    assert spread(moved[2]) > 0 and moved[2].n_valid == 200
    exact = encounters.closest_approach(encounters.phase_space(stars.filter("source_id = 2")), encounters.phase_space(anchor(none))).first()
    assert fixed[2].d_min_pc_50 == pytest.approx(exact.d_min_pc) and fixed[2].t_enc_myr_50 == pytest.approx(exact.t_enc_myr)


def test_dust_by_bisection_is_the_nearest_of_the_grid(spark):
    from skysift.functions.exprs import BANDS, BOLTZMANN, LIGHT, PLANCK
    from skysift.operators import catalog

    step = (catalog.DUST_HIGH - catalog.DUST_LOW) / (catalog.DUST_GRID - 1)
    grid = [i * step + catalog.DUST_LOW for i in range(catalog.DUST_GRID)]
    planck = lambda t, b: 2 * PLANCK * (LIGHT / (BANDS[b][0] * 1e-6)) ** 3 / LIGHT**2 / math.expm1(PLANCK * (LIGHT / (BANDS[b][0] * 1e-6)) / BOLTZMANN / t)
    ratios = [planck(t, "W1") / planck(t, "W2") for t in grid]
    wanted = [1e-12, ratios[0], ratios[7] * 1.0001, (ratios[100] + ratios[101]) / 2 * 0.9999, ratios[300] * 0.9999, ratios[-1], 5.0, 1e30, 1e308]
    rows = [(i, r, 1.0) for i, r in enumerate(wanted)] + [(97, 1e308, 1e-10), (98, -1.0, 1.0), (99, None, 1.0)]
    df = spark.createDataFrame(rows, "source_id long, W1_excess_jy double, W2_excess_jy double").withColumns({"sed_scale": F.lit(1.0), "teff": F.lit(5000.0)})
    made = catalog.dust(df)
    got = {r.source_id: r.t_dust_k for r in made.collect()}
    for i, w in enumerate(wanted):
        assert got[i] == pytest.approx(min((abs(r - w), t) for r, t in zip(ratios, grid))[1], abs=1e-9)
    assert (got[97], got[98], got[99]) == (catalog.DUST_LOW, None, None)
    # a row asks a few temperatures, not the whole grid
    assert "sequence(0, 599" not in made._jdf.queryExecution().optimizedPlan().toString() and ", 598, 599" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n_axes", [1, 2, 3])
def test_friends_in_a_crowd_are_linked_without_pairs(spark, monkeypatch, n_axes):
    rng = np.random.default_rng(5 + n_axes)
    x = np.concatenate([rng.uniform(-30 if n_axes == 3 else -200, 30 if n_axes == 3 else 200, (150, n_axes)), rng.normal(0, 0.5, (150, n_axes))])
    df = spark.createDataFrame([(i % 295, *map(float, p)) for i, p in enumerate(x)] + [(9999, *([float("nan")] * n_axes))], "source_id long, " + ", ".join(f"x{i} double" for i in range(n_axes)))
    root = list(range(295))
    find = lambda i: i if root[i] == i else find(root[i])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i, j in zip(*np.nonzero(d <= 4.0)):
        a, b = sorted((find(i % 295), find(j % 295)))
        root[b] = a
    sizes = Counter(find(i) for i in range(295))
    number = {r: n for n, r in enumerate(sorted(r for r, n in sizes.items() if n >= 3))}
    monkeypatch.delattr(cluster, "close_pairs")
    got = {r.source_id: r.group for r in cluster.friends_of_friends(df, [f"x{i}" for i in range(n_axes)], 4.0, 3).collect()}
    assert got == {i: number[find(i)] for i in range(295) if find(i) in number}


def test_copied_side_of_a_match_is_not_broadcast(spark):
    from skysift.operators import xmatch

    df = spark.createDataFrame([(i, i % 2, i // 2 * 0.1, 1.0) for i in range(40)], "spec_id long, release long, ra double, dec double")
    out = xmatch.overlapping_spectra(df, 1.0)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.spec_id, r.other_id) for r in out.collect()) == sorted((i, i ^ 1) for i in range(40))


def moved_bytes(spark, run):
    """What the stages of ``run`` write to the shuffle and spill."""
    sc = spark.sparkContext
    store, lists = sc._jsc.sc().statusStore(), sc._jvm.java.util
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), lists.ArrayList())
    total = lambda: {s.stageId(): s.shuffleWriteBytes() + s.memoryBytesSpilled() + s.diskBytesSpilled() for s in (x.apply(i) for x in [stages()] for i in range(x.size()))}
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for i, n in total().items() if i not in before)


STAR = "source_id long, ra double, dec double, parallax double, pmra double, pmdec double, radial_velocity double, parallax_error double, pmra_error double, pmdec_error double, radial_velocity_error double"


def test_draws_are_not_shuffled(spark):
    stars = spark.createDataFrame([(i, i % 360 * 1.0, 6.0, 80.0, 50.0, -20.0, 30.0, 1.0, 1.0, 1.0, 1.0) for i in range(300)], STAR)
    anchor = spark.createDataFrame([(999, 10.0, 5.0, 100.0, 0.0, 0.0, -10.0, 1.0, 1.0, 1.0, 1.0)], STAR)
    got = []
    moved = moved_bytes(spark, lambda: got.extend(encounters.encounter_uncertainty(stars, anchor, 1000).collect()))
    assert len(got) == 300 and all(r.n_valid == 1000 for r in got)
    # a star is a row of some hundred bytes, a draw that is moved has eight at least for each of three figures
    assert moved < 300 * 1000


def test_draws_of_an_id_are_one_star_whatever_the_batches(spark):
    star = lambda i, x: (i, 12.0, 6.0, x, 50.0, -20.0, 30.0, 1.0, 1.0, 1.0, 1.0)
    anchor = spark.createDataFrame([star(-5, 90.0)], STAR)
    rows = [star(i % 40, 80.0 + i // 40) for i in range(100)] + [(77, 1.0, None, 80.0, 0.0, 0.0, 5.0, 1.0, 1.0, 1.0, 1.0), star(None, 80.0)]
    run = lambda df: {r.source_id: r for r in encounters.encounter_uncertainty(df, anchor, 50).collect()}
    whole = run(spark.createDataFrame(rows, STAR))
    alone = run(spark.createDataFrame([star(35, 80.0), star(135, 80.0)], STAR))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert run(spark.createDataFrame(rows, STAR)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(whole) == [*range(40), 77] and whole[77].n_valid == 0 and whole[77].d_min_pc_50 is None
    assert [whole[i].n_valid for i in (0, 19, 20, 39)] == [150, 150, 100, 100]
    two = run(spark.createDataFrame([star(35, 80.0), star(35, 81.0)], STAR))
    assert two[35] == whole[35] and alone[35].n_valid == 50


def test_families_without_rows_of_anchors(spark, monkeypatch):
    from skysift.functions.lines import GALAXY, LOCKED
    from skysift.operators import triage

    rng = random.Random(11)
    rows = [(s, w) for s in range(30) for w in [rng.uniform(3600, 9800) for _ in range(rng.choice([1, 4, 9]))]]
    rows += [(s, x * (1.05 + s / 100)) for s in range(30, 40) for _, x in rng.sample(GALAXY, 4)] * 2 + [(3, float("nan")), (4, None), (None, 5000.0), (None, 5100.0), (99, 10.0)]
    rest = sorted(x for _, x in GALAXY)
    want = {}
    for s in {s for s, _ in rows}:
        ws = sorted({w for t, w in rows if t == s and w is not None and w == w})
        n = len(ws) + any(t == s and w is not None and w != w for t, w in rows)
        for a in ws:
            for place, (_, x) in enumerate(GALAXY):
                z = a / x - 1.0
                if -0.003 <= z <= 1.2:
                    met = {name for w in ws for name, r in GALAXY if r == min(rest, key=lambda y: abs(w / (y * (z + 1.0)) - 1.0)) and abs(w / (r * (z + 1.0)) - 1.0) * triage.LIGHT_KMS <= 250}
                    galaxy = len(met) >= 3 or any(p in met and q in met for p, q in LOCKED)
                    new = ((galaxy, len(met), -a, -place), (n, len(met), z, galaxy))
                    want[s] = max(want.get(s, new), new)
    want = {s: v for s, (_, v) in want.items()}
    df = spark.createDataFrame(rows, "spec_id long, wavelength double")
    out = triage.redshift_families(df)
    assert {r.spec_id: tuple(r)[1:] for r in out.collect()} == want
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(triage, "PAIRS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert {r.spec_id: tuple(r)[1:] for r in triage.redshift_families(df).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_of_lines_are_counted_once_and_without_groups(spark):
    from skysift.operators import triage

    rng = random.Random(4)
    rows = [(rng.randrange(12), rng.choice([5000.0, 5003.0, 5006.0, 5009.5]) + rng.randrange(9) * 1.5) for _ in range(120)]
    df = spark.createDataFrame(rows + [(0, None)], "spec_id long, wavelength double")
    out = triage.recurrent(df, 3.0)
    got = Counter(map(tuple, out.select("spec_id", "wavelength", "n_spectra").collect()))
    assert got == Counter((s, w, len({t for t, x in rows if abs(x - w) <= 3.0})) for s, w in rows)
    # spectra are sorted once, to be written; what is left knows wavelengths only
    assert "_run" not in out._jdf.queryExecution().optimizedPlan().toString() and "PARTITION BY spec_id" not in out._jdf.queryExecution().optimizedPlan().toString() and "windowspecdefinition(spec_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_line_compares_a_cells_own_middles(spark):
    from skysift.operators import triage

    lines, middles = triage.KNOWN, [(a + b) / 2 for a, b in zip(triage.KNOWN, triage.KNOWN[1:])]
    asked = [y for m in middles for y in (m, m - 1e-9, m + 1e-9)] + [-5.0, 0.0, 1e300, float("inf"), float("-inf")]
    for some in (lines, [6000.0], [5000.0, 5000.01, 6000.0]):
        out = spark.createDataFrame([(x,) for x in asked], "w double").select("w", triage.nearest_line(c("w"), some)["line"].alias("line"))
        mids = [(a + b) / 2 for a, b in zip(some, some[1:])]
        assert all(r.line == some[sum(r.w > m for m in mids)] for r in out.collect())
        assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    odd = spark.createDataFrame([(float("nan"),), (None,)], "w double").select(triage.nearest_line(c("w"), lines)["line"].alias("line"))
    assert [r.line for r in odd.collect()] == [lines[-1], None]


def test_sums_of_a_periodogram_take_few_sines(monkeypatch):
    rng = np.random.default_rng(3)
    n = 1300
    t, y, w = rng.uniform(0, 400, n), rng.normal(size=n), rng.uniform(0.5, 2, n)
    freq = lightcurve.grid(np.ptp(t), 100.0)
    phase = 2 * np.pi * freq[:, None] * t
    cos, sin = np.cos(phase), np.sin(phase)
    want = np.stack([cos @ w, sin @ w, cos @ (w * y), sin @ (w * y), (cos * cos) @ w, (cos * sin) @ w])
    taken = []

    def counted(f):
        return lambda x: (taken.append(np.size(x)), f(x))[1]

    for name in ("exp", "cos", "sin"):
        monkeypatch.setattr(np, name, counted(getattr(np, name)))
    got = lightcurve.trig_sums(t, y, w, freq)
    assert np.abs(got - want).max() < 1e-9 * n
    assert sum(taken) < phase.size / 10
    assert np.abs(lightcurve.trig_sums(t[:5], y[:5], w[:5], freq[:1])[:, 0] - [cos[0, :5] @ w[:5], sin[0, :5] @ w[:5], cos[0, :5] @ (w * y)[:5], sin[0, :5] @ (w * y)[:5], cos[0, :5] ** 2 @ w[:5], (cos * sin)[0, :5] @ w[:5]]).max() < 1e-9


def test_epochs_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    rows = [(k, 100.0 * i / 7, 12.0 + (k * 31 + i * 17) % 23 / 100.0) for k in range(40) for i in range(60)]
    df = spark.createDataFrame(rows, "source_id long, mjd double, mag double")
    want = {r.source_id: r for r in lightcurve.fades(df, ["source_id"]).collect()}
    monkeypatch.setattr(lightcurve, "TASK_ROWS", 100)
    held = lightcurve.seasons(df, ["source_id"])
    sizes = held.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("source_id").alias("n")).collect()
    assert len(sizes) > 8 and max(r.n for r in sizes) < 10
    got = {r.source_id: r for r in lightcurve.fades(df, ["source_id"]).collect()}
    assert want.keys() == got.keys() and len(want) == 40
    assert all(abs(got[k].slope - want[k].slope) < 1e-9 and got[k].n_seasons == want[k].n_seasons for k in want)


@pytest.mark.parametrize("window", [1, 5, 21, 101])
def test_running_medians_are_those_of_single_windows(spark, monkeypatch, window):
    monkeypatch.setattr(spectra, "WINDOW_VALUES", 200)  # a few spectra at once
    rng = random.Random(window)
    odd = {3: None, 4: float("nan"), 5: float("inf")}
    groups = {(k, s): [odd.get(k, 0.0) if k in odd and i == 2 else rng.randint(0, 9) / 4 for i in range(n)] for k, n in enumerate([1, 2, 5, 64, 64, 64, 64, 65, 130, 7]) for s in (8.0, 15.0)}
    gap = 9  # its pixels count from 1
    rows = [(k, s, i + (k == gap), f, "x") for (k, s), fluxes in groups.items() for i, f in enumerate(fluxes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "spec_id long, snr double, pix int, flux double, other string")
    out = spectra.continuum(df, window, ("spec_id", "snr"))
    assert out.columns == [*df.columns, "continuum"] and [t for _, t in out.dtypes[:-1]] == [t for _, t in df.dtypes]
    got = {(r.spec_id, r.snr, r.pix): r for r in out.collect()}
    assert len(got) == len(rows)
    order = lambda f: (0, 0.0) if f is None else (2, 0.0) if f != f else (1, f)
    for (k, s), fluxes in groups.items():
        n = len(fluxes)
        h = (min(window, n if n % 2 else n - 1) - 1) // 2
        seen = [(i + (k == gap), f) for i, f in enumerate(fluxes)]
        both = seen + [(-i, f) for i, f in seen if 1 <= i <= h] + [(2 * (n - 1) - i, f) for i, f in seen if n - 1 - h <= i <= n - 2]
        for i, f in seen:
            near = sorted((y for q, y in both if abs(q - i) <= h), key=order)
            r = got[k, s, i]
            assert order(r.continuum) == order(near[len(near) // 2]) and order(r.flux) == order(f) and r.other == "x"


def test_an_edge_between_equal_colours_is_their_weighed_sum(spark):
    n, bins = 98, 24
    v = sorted([0.42, 3.27, 3.77, 6.95, 7.03, 7.96][i % 6] for i in range(n))
    want, above = set(), 0
    for i in range(1, bins):
        place = i / bins * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        e = (high - place) * v[low] + (place - low) * v[high] + (v[low] if low == high else 0.0)
        above += v[low] == v[high] and e > v[low]
        want.add(e)
    assert above
    colours = spark.createDataFrame(list(enumerate(v)), "spec_id long, colour double")
    pixels = colours.select("spec_id", F.posexplode(F.array(F.lit(0.3), F.lit(0.7) - c("spec_id") / 1e4)).alias("pix", "flux"))
    found = shape.fit_locus(pixels, colours, per_bin=4, least=1)
    assert set(found.edges[1:-1]) == want
    got = {r.spec_id: r.bin for r in colours.select("spec_id", found.bin_of(c("colour")).alias("bin")).collect()}
    assert got == {i: sum(x >= e for e in want) for i, x in enumerate(v)}


def test_all_clean_anomalies_are_ranked(spark):
    k = c("id")
    noise = ((k * 7919 + c("pix") * 104729) % 101) / 1e4
    bump = F.when((k % 2 == 0) & (k / 2 % 24 == c("pix")), 1.0 + k % 7).otherwise(0.0)
    pixels = spark.range(2400).select("id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("pix")).select(k.alias("spec_id"), "pix", (1.0 + noise + bump).alias("flux"))
    meta = spark.range(2400).selectExpr("id AS spec_id", "1e0 + id / 1e4 AS colour", "0e0 AS quasar", "0e0 AS galaxy", "5e0 AS abs_g", "'NOT_AVAILABLE' AS variable", "0 AS non_single")
    rows = shape.shape_run(pixels, meta, most=0.9)[0].filter("class = 'clean'").collect()
    best = sorted(rows, key=lambda r: (-r.narrow, -max(r.global_sigma, r.peak), r.spec_id))
    assert len(rows) >= 1200 and [r.rank for r in best] == list(range(1, len(rows) + 1))


def test_medians_of_replicates_without_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (3900, 3)), rng.standard_cauchy((100, 3))])
    parent = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(x)], "source_id long, stratum long, x double, y double, z double")
    anomalies, seen = parent.filter("source_id % 4 = 0"), []

    def written(df, plain=replicates.written):
        out = plain(df)
        if "distance" in out.columns:
            seen.append(out.count())
        return out

    plain = cluster.null_tests(parent, anomalies, {"a": ("x", "y", "z")}, 2, 1.0, 60).first()
    monkeypatch.setattr(replicates, "DIRECT", 1000, raising=False)
    for module in (replicates, cluster, Q):
        monkeypatch.setattr(module, "written", written)
    got = cluster.null_tests(parent, anomalies, {"a": ("x", "y", "z")}, 2, 1.0, 60).first()
    assert got[:2] == plain[:2] and got[2:] == pytest.approx(plain[2:], rel=1e-9)
    assert sum(seen) < 61 * 1000 / 2
    d = np.sort(np.sqrt(((x[::4][:, None] - x[::4]) ** 2).sum(axis=2)), axis=1)[:, 2]
    assert plain.observed == pytest.approx(np.median(d), rel=1e-12)


def test_medians_that_lie_elsewhere_are_found(spark, monkeypatch):
    monkeypatch.setattr(replicates, "DIRECT", 100)
    monkeypatch.setattr(replicates, "BOX", 100)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), rng.normal(50, 30, (200, 2)), np.full((50, 2), 7.0)])
    member = rng.random((len(x), 31)) < 0.2
    member[:, 20:24] = (np.arange(len(x)) >= 500)[:, None] & (rng.random((len(x), 4)) < 0.5)
    member[:, 25] = np.arange(len(x)) >= 700
    member[:, 26:28] = [[i == 9, False] for i in range(len(x))]
    rows = [(*map(float, p), np.packbits(m).tobytes()) for p, m in zip(x, member)]
    got = {r.rep: r.s for r in replicates.medians(spark.createDataFrame(rows, "x double, y double, bits binary"), ["x", "y"], 2, 30).collect()}
    want = {}
    for r in range(31):
        mine = x[member[:, r]]
        if len(mine) > 2:
            want[r] = np.median(np.sort(np.sqrt(((mine[:, None] - mine) ** 2).sum(axis=2)), axis=1)[:, 2])
    assert set(got) == set(want) and all(got[r] == pytest.approx(want[r], rel=1e-12, abs=1e-12) for r in want)
