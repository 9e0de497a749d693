"""Injected lines and features."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skysift.operators import cluster, shape, spectra, triage

WAVE = np.arange(5200.0, 5600.0)


def spectrum(at=None, amplitude=0.5, sigma=1.5, seed=1):
    rng = np.random.default_rng(seed)
    flux = 1.0 + rng.normal(0, 0.005, len(WAVE))
    if at is not None:
        flux += amplitude * np.exp(-0.5 * ((np.arange(len(WAVE)) - at) / sigma) ** 2)
    return flux


def frame(spark, *fluxes):
    rows = [(i, WAVE.tolist(), f.tolist(), [40000.0] * len(WAVE)) for i, f in enumerate(fluxes)]
    return spark.createDataFrame(rows, "spec_id long, wave array<double>, flux array<double>, ivar array<double>")


def pixels(df):
    """The long form of array rows: one row for each pixel."""
    arrays = [x for x in df.columns if x != "spec_id"]
    return df.select("spec_id", F.posexplode(F.arrays_zip(*arrays)).alias("pix", "p")).select("spec_id", "pix", *(F.col("p")[x].alias(x) for x in arrays))


def test_line_is_found_spike_and_wide_line_are_not(spark):
    spike = spectrum()
    spike[100] += 0.5
    df = frame(spark, spectrum(200), spike, spectrum(200, sigma=6.0), spectrum())
    found = spectra.candidates(spectra.find_lines(pixels(df))).collect()
    assert [(r.spec_id, r.pix) for r in found] == [(0, 200)] and found[0].score > 0.5


def test_absorption_line_and_snippet(spark):
    df = frame(spark, spectrum(300, -0.4))
    found = spectra.find_lines(pixels(df), absorption=True).withColumn("reason", spectra.absorption_reason())
    row = spectra.with_snippets(found, df).first()
    assert row.pix == 300 and row.reason is None and len(row.win_flux) == 81


def test_recovery_rises_with_strength(spark):
    df = frame(spark, *(spectrum(seed=s) for s in range(12)))
    got = {r.snr: r.recovered for r in spectra.recovery(pixels(df), (3.0, 30.0)).collect()}
    assert got[3.0] <= got[30.0] and got[30.0] > 0.5


def test_narrow_feature_is_found_and_smooth_curve_is_not(spark):
    x = np.linspace(-1, 1, 120)
    smooth = 1 + 0.3 * x - 0.2 * x**3
    bump = smooth + 0.2 * np.exp(-0.5 * ((np.arange(120) - 60) / 1.2) ** 2)
    df = spark.createDataFrame([(0, smooth.tolist()), (1, bump.tolist()), (2, [1.0] * 5)], "spec_id long, flux array<double>")
    assert [(r.spec_id, r.pix) for r in shape.feature_scan(pixels(df)).collect()] == [(1, 60)]


def test_ids_of_nineteen_digits(spark):
    big = 4_611_686_018_427_387_904
    df = frame(spark, spectrum(200), spectrum()).withColumn("spec_id", F.col("spec_id") + big)
    assert [(r.spec_id, r.pix) for r in spectra.find_lines(pixels(df)).collect()] == [(big, 200)]
    assert {r.n for r in spectra.recovery(pixels(df), (30.0,)).collect()} == {2}
    points = spark.createDataFrame([(big + i, float(i // 3 * 100 + i % 3)) for i in range(6)] + [(7, 1e6)], "source_id long, x double")
    groups = {r.source_id: r.group for r in cluster.friends_of_friends(points, ["x"], 1.5, 3).collect()}
    assert groups == {big + i: i // 3 for i in range(6)}
    far = {r.source_id: r.distance for r in cluster.kth_neighbour(points, [], ["x"], 1, 1.0).collect()}
    assert far[7] == 1e6 - 102 and far[big] == 1.0 and len(far) == 7


def test_locked_pair_is_a_galaxy_single_line_never(spark):
    rows = [(1, 6564.61 * 1.1, 1), (1, 6585.27 * 1.1, 2), (2, 7000.0, 1)]
    df = spark.createDataFrame(rows, "spec_id long, wavelength double, line_no int")
    got = {r.spec_id: r.is_galaxy for r in triage.redshift_families(df).collect()}
    assert got == {1: True, 2: False}


def test_duplicates_and_recurrence(spark):
    rows = [(s, 0, 5000.0 + s / 10, 10.0, "emission") for s in range(3)] + [(9, 0, 5300.0, 9.0, "emission"), (9, 1, 5300.01, 8.0, "absorption"), (8, 0, 4701.0, 9.0, "emission")]
    df = spark.createDataFrame(rows, "spec_id long, line_no int, wavelength double, significance double, search_mode string")
    got = {(r.spec_id, r.line_no): r.verdict for r in triage.triage(df, [6000.0]).collect()}
    assert got == {(0, 0): "recurrent", (1, 0): "recurrent", (2, 0): "recurrent", (9, 0): "survives", (9, 1): "duplicate", (8, 0): "survives"}
    assert triage.recurrent_bins(df).filter(F.col("spec_id") < 3).count() == 0


def test_excluded_bandwidth_by_cells(spark):
    rng = random.Random(7)
    lines = [rng.uniform(3500, 9900) for _ in range(150)] + [3600.0, 4000.0, 4000.0, 4001.0, 9800.0, 5009.999, 5010.0]
    df = triage.excluded_bandwidth(spark.createDataFrame([(x,) for x in lines], "line double"), 300.0)
    total, end = 0.0, 0.0
    for lo, hi in sorted((max(x - x * 300 / triage.LIGHT_KMS, 3600), min(x + x * 300 / triage.LIGHT_KMS, 9800)) for x in lines):
        if lo < hi:
            total += max(0.0, hi - max(lo, end))
            end = max(end, hi)
    got = df.first()
    assert abs(got.excluded - total) < 1e-6 and abs(got.fraction - total / 6200) < 1e-9
    # no task sorts the whole list
    assert "windowspecdefinition(_cell" in df._jdf.queryExecution().optimizedPlan().toString() and "windowspecdefinition(lo" not in df._jdf.queryExecution().optimizedPlan().toString()
