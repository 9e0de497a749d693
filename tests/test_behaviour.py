"""Injected signals on small tables."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skysift.operators import cluster, encounters, indicators, lightcurve, limits, xmatch
from skysift.operators.lightcurve import false_alarm, grid, lomb_scargle


def curve(spark, seed=1, n=120, dips=(), slope=0.0, days=2000.0, source=1):
    rng = random.Random(seed)
    t = sorted(rng.uniform(0, days) for _ in range(n))
    rows = []
    for i, x in enumerate(t):
        m = 12 + rng.gauss(0, 0.01) + slope * x / 365.25
        m += sum(d for at, d in dips if abs(x - at) < 3)
        rows.append((source, "g", x, m, 0.01, i))
    return spark.createDataFrame(rows, "source_id long, band string, mjd double, mag double, magerr double, tiebreak long")


def test_flat_curve_has_no_dips(spark):
    row = lightcurve.dip_summary(curve(spark), ["source_id"]).first()
    assert row.n_events == 0 and row.score < 0.5


def test_dips_are_found_whatever_the_partitions(spark):
    rows = [(1, "g", float(t), 12.0 + (0.3 if t % 50 in (0, 1, 2) and t > 10 else 0.0) + 0.001 * (t % 7), 0.01, t) for t in range(200)]
    df = spark.createDataFrame(rows, "source_id long, band string, mjd double, mag double, magerr double, tiebreak long")
    got = [lightcurve.dip_candidates(lightcurve.dip_summary(df.repartition(n), ["source_id"])).first() for n in (1, 7)]
    assert got[0] == got[1] and got[0].n_events == 3 and got[0].is_candidate


def test_lone_outlier_is_no_event(spark):
    rows = [(1, "g", float(t), 13.0 if t == 40 else 12.0 + 0.001 * (t % 5), 0.01, t) for t in range(80)]
    df = spark.createDataFrame(rows, "source_id long, band string, mjd double, mag double, magerr double, tiebreak long")
    assert lightcurve.dip_summary(df, ["source_id"]).first().n_events == 0


def test_too_few_epochs_give_no_row(spark):
    assert lightcurve.dip_summary(curve(spark, n=10), ["source_id"]).count() == 0
    assert lightcurve.fades(curve(spark, n=100, days=200.0), ["source_id"]).count() == 0


def test_fade_is_found_and_brightening_is_not(spark):
    up = lightcurve.fades(curve(spark, n=300, slope=0.1), ["source_id"]).first()
    down = lightcurve.fades(curve(spark, n=300, slope=-0.1), ["source_id"]).first()
    assert up.is_fader and abs(up.slope - 0.1) < 0.01
    assert not down.is_fader and down.score == 0


def test_period_is_recovered():
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 30, 200))
    y = 0.1 * np.sin(2 * np.pi * t / 1.7) + rng.normal(0, 0.02, 200)
    freq = grid(np.ptp(t), 100.0)
    power, amplitude = lomb_scargle(t, y, np.ones(200), freq)
    assert abs(1 / freq[power.argmax()] - 1.7) < 0.02 and abs(amplitude.max() - 0.1) < 0.02
    assert false_alarm(power.max(), 200, 10.0, t, np.ones(200)) < 1e-6
    noise, _ = lomb_scargle(t, rng.normal(0, 1, 200), np.ones(200), freq)
    assert false_alarm(noise.max(), 200, 10.0, t, np.ones(200)) > 1e-3


def test_sky_match_wraps_and_breaks_ties(spark):
    a = spark.createDataFrame([(1, 359.9999, 0.0), (2, 10.0, 89.9), (3, 50.0, -30.0)], "source_id long, ra double, dec double")
    b = spark.createDataFrame([(9, 0.0001, 0.0), (7, 0.0001, 0.0), (5, 10.2, 89.9), (4, 51.0, -30.0)], "cand_id long, ra double, dec double")
    got = {(r.source_id, r.cand_id) for r in xmatch.nearest(a, b, 5.0).collect()}
    assert got == {(1, 7), (2, 5)}


def test_no_literature_means_no_novelty(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "source_id long, ra double, dec double")
    empty = spark.createDataFrame([], "label string, id long, ra double, dec double")
    assert xmatch.novel(a, empty, a.filter("false")).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in cluster.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[100] == 100


def test_neighbours_match_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)] + [(99, 900.0, 900.0)]
    df = spark.createDataFrame(pts, "source_id long, x double, y double")
    got = {r.source_id: r.distance for r in cluster.kth_neighbour(df, [], ["x", "y"], 2, 3.0).collect()}
    for i, x, y in pts:
        want = sorted(math.hypot(x - u, y - v) for j, u, v in pts if j != i)[1]
        assert got[i] == pytest.approx(want)


def test_limit_values(spark):
    df = spark.createDataFrame([(0, 100), (3, 100), (200, 1000)], "k long, n long")
    got = {r.k: r.upper_limit * r.n for r in limits.occurrence_limit(df, "k", "n").collect()}
    assert got[0] == pytest.approx(2.9957, abs=1e-3) and got[3] == pytest.approx(7.7537, abs=1e-3) and got[200] == pytest.approx(224.9, abs=0.5)


def test_small_errors_reproduce_the_pass(spark):
    rows = [(1, 10.0, 5.0, 100.0, 0.0, 0.0, -10.0), (2, 12.0, 6.0, 80.0, 50.0, -20.0, 30.0)]
    df = encounters.phase_space(spark.createDataFrame(rows, "source_id long, ra double, dec double, parallax double, pmra double, pmdec double, radial_velocity double"))
    exact = encounters.closest_approach(df.filter("source_id = 2"), df.filter("source_id = 1")).first()
    with_errors = lambda e: df.withColumns({f"{x}_error": F.lit(e) for x in encounters.DRAWN})
    passed = lambda e: encounters.encounter_uncertainty(with_errors(e).filter("source_id = 2"), with_errors(e).filter("source_id = 1"), 40).first()
    tiny, wide = passed(1e-9), passed(1.0)
    assert tiny.d_min_pc_50 == pytest.approx(exact.d_min_pc, rel=1e-6)
    assert wide.d_min_pc_84 - wide.d_min_pc_16 > tiny.d_min_pc_84 - tiny.d_min_pc_16


def test_absent_axes_do_not_count(spark):
    assert sum(w for _, _, w in indicators.SUITE) == pytest.approx(12.3)
