"""Decision rules, each branch on a row worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skysift.operators import assembly, catalog, spectra, verdicts, xmatch

c = F.col
NAN = float("nan")


def column(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_object_class(spark):
    rows = {
        (None, None): "unexamined", ("", " "): "unexamined", ("nan", "None"): "unexamined", ("CV*", "DA"): "interacting binary (CV)", ("Nova", None): "interacting binary (CV)", ("EB*", None): "eclipsing binary",
        ("**", "DA+M4"): "WD+dwarf binary", ("Star", "G2+K"): "WD+dwarf binary", ("WD*", "DAZ"): "metal-polluted WD (disk)", ("SB*", "DA"): "binary", ("**", None): "binary", ("WD*", None): "white dwarf (other)",
        ("Star", "DQ7"): "white dwarf (other)", ("QSO", "G2V"): "qso", ("", "G2V"): "unexamined",
    }
    assert column(spark, list(rows), "k string, s string", verdicts.object_class(c("k"), c("s"))) == list(rows.values())


def test_shape_class(spark):
    rows = [((0.6, 0.9, 12.0, 0.0, "VARIABLE", 1), "quasar"), ((NAN, 0.6, None, None, None, None), "galaxy"), ((0.5, 0.5, 10.1, 1.4, "VARIABLE", 1), "white_dwarf"), ((None, None, NAN, 1.0, "variable x", 0), "known_variable"), ((None, None, 10.0, 1.0, "NOT", 2), "non_single_star"), ((0.0, 0.0, 11.0, 1.5, None, None), "clean")]
    got = column(spark, [r for r, _ in rows], "q double, g double, m double, b double, v string, n int", verdicts.shape_class(c("q"), c("g"), c("m"), c("b"), c("v"), c("n")))
    assert got == [x for _, x in rows]


def test_infrared_counterpart(spark):
    rows = [
        ((None, 0.1, 9.0, None, None), "insufficient_ir"), ((0.0, 0.1, 9.0, None, None), "insufficient_ir"), ((0.1, None, 9.0, 0.1, None), "insufficient_ir"), ((0.1, -0.01, 2.0, 0.09, 9.0), "ir_brightens_dusty"),
        ((0.1, -0.01, 1.9, 0.03, 2.0), "ir_fades_gray_occulter"), ((0.1, 0.03, 1.9, 0.01, 2.5), "ir_fades_reddening_law"), ((0.1, 0.02, 9.0, None, None), "ir_flat_chromatic_fade"), ((0.1, 0.0001, 0.1, NAN, NAN), "ir_flat_chromatic_fade"),
    ]
    got = column(spark, [r for r, _ in rows], "o double, a double, x double, b double, y double", verdicts.infrared_counterpart(c("o"), (c("a"), c("x")), (c("b"), c("y"))))
    assert got == [x for _, x in rows]


def test_excess_verdict(spark):
    rows = [
        ((10.2, 10.0, None, None), "ir_excess_dusty"), ((10.14, 10.0, None, "Mira Mi*"), "known_variable"), ((None, 10.0, 10.61, "EB*"), "ir_excess_dusty"), ((None, 10.0, 10.5, "Star"), "clean"), ((10.0, None, 10.0, "Star"), "no_ir_data"),
        ((10.0, NAN, 9.0, ""), "no_ir_data"), ((NAN, 10.0, 10.1, None), "clean"), ((None, None, None, "em outflow"), "known_variable"),
    ]
    assert column(spark, [r for r, _ in rows], "a double, b double, k double, t string", xmatch.excess_verdict(c("a"), c("b"), c("k"), c("t"))) == [x for _, x in rows]


def test_colour_reasons_sum_the_errors_that_are_known(spark):
    rows = [((10.0, 9.6, None, None, 0.1, None), ["w1_w2"]), ((10.0, 9.6, None, None, 0.14, None), []), ((10.0, 9.7, 9.3, None, None, None), ["w1_w3"]), ((10.0, NAN, None, 9.0, 0.3, 0.1), ["w1_w4"]), ((None, 9.0, 9.0, 9.0, 0.1, 0.1), [])]
    reasons = verdicts.colour_reasons(c("a"), c("b"), c("d"), c("e"), c("x"), c("y"), F.lit(0.1), F.lit(0.01))
    assert column(spark, [r for r, _ in rows], "a double, b double, d double, e double, x double, y double", reasons) == [x for _, x in rows]


def test_vet_verdict(spark):
    rows = [
        (("known_variable", "glint", 1.0, 0.5, True, True, 3, 1.0), "known_variable"), (("no_ir_data", "dipper", None, None, False, False, 3, 1.0), "no_ir_data"),
        (("clean", "secular_fader", 0.079, 0.5, True, False, 0, None), "marginal_fade"), (("clean", "secular_fader", None, 0.5, True, False, 0, None), "marginal_fade"), (("clean", "secular_fader", -0.2, 0.91, True, False, 0, None), "active_dwarf_fade"),
        (("clean", "secular_fader", 0.2, NAN, True, False, 0, None), "clean_secular_fade"), (("clean", "secular_fader", 0.2, 0.9, False, False, 0, None), "single_band_fade"),
        (("clean", "glint", 0.0, 2.0, False, True, 0, None), "clean_glint"), (("clean", "glint", 0.0, 2.0, True, None, 0, None), "chromatic_flare"),
        (("clean", "dipper", 0.0, 2.0, True, True, 1, 1.0), "single_band_unconfirmed"), (("clean", "dipper", 0.0, 2.0, True, True, 2, NAN), "single_band_unconfirmed"), (("clean", "dipper", 0.0, 2.0, True, True, 2, 0.5), "clean_achromatic"), (("clean", None, 0.0, 2.0, True, True, 3, 0.49), "single_band_artifact"),
    ]
    verdict = verdicts.vet_verdict(*(c(x) for x in "abdefghj"))
    assert column(spark, [r for r, _ in rows], "a string, b string, d double, e double, f boolean, g boolean, h int, j double", verdict) == [x for _, x in rows]


def test_vet_run_takes_the_first_type_and_checks_its_bands(spark):
    candidates = [(1, "glint", 0.3, 0.5), (1, "dipper", 0.3, 0.5), (2, "dipper", 0.0, 0.5), (3, "secular_fader", 0.3, 0.5), (4, "glint", 0.0, 0.5), (5, "dipper", 0.0, 0.5)]
    photometry = [(i, 10.0, 10.0, 10.0, "Star") for i in (1, 2, 3, 4)] + [(5, 10.5, 10.0, 10.0, "Star")]
    curves = []
    for source in (1, 2, 3, 4, 5):
        for k in range(200):
            t = k * 10.0
            for band in "gr":
                mag = 12.0 + 0.001 * (k % 5)
                if source == 1 and k in (50, 51, 120):
                    mag += 0.3  # dips in both bands
                if source == 2 and k in (50, 51, 120) and band == "g":
                    mag += 0.3  # in one band
                if source == 3:
                    mag += t / 2000.0 * 0.3
                if source == 4 and k == 77:
                    mag -= 0.5 if band == "g" else 0.1  # a flare
                curves.append((source, band, t, mag, 0.01, len(curves)))
    got = verdicts.vet_run(
        spark.createDataFrame(candidates, "source_id long, cand_type string, secular_total_mag double, bp_rp double"),
        spark.createDataFrame(photometry, "source_id long, W1mag double, W2mag double, Ksmag double, otype string"),
        spark.createDataFrame(curves, "source_id long, band string, mjd double, mag double, magerr double, tiebreak long"),
    ).collect()
    assert {r.source_id: (r.cand_type, r.verdict) for r in got} == {1: ("dipper", "clean_achromatic"), 2: ("dipper", "single_band_artifact"), 3: ("secular_fader", "clean_secular_fade"), 4: ("glint", "chromatic_flare"), 5: ("dipper", "ir_excess_dusty")}


def test_hot_dust_overrides_survivors_only(spark):
    stars = spark.createDataFrame([(1, 10.0, 0.0, 15.0, 1.0, 5.0, 5.0), (2, 20.0, 0.0, 15.0, 1.0, 5.0, 5.0), (3, 20.0, 0.0005, 15.0, 1.0, 90.0, 5.0), (4, 30.0, 0.0, 15.0, 1.0, 5.0, 5.0), (5, 30.0, 0.0005, 20.0, 1.0, 5.0, 5.0)], "source_id long, ra double, dec double, g double, bp_rp double, pmra double, pmdec double")
    asked = stars.filter("source_id IN (1, 2, 4)")
    verdict = lambda t: {r.source_id: r.verdict for r in xmatch.blend_verdicts(asked.withColumn("t_dust_k", F.lit(t).cast("double")), stars).collect()}
    assert verdict(1800.0) == verdict(NAN) == verdict(None) == {1: "isolated", 2: "background_blend", 4: "clean"}
    assert verdict(1801.0) == {1: "stellar_companion", 2: "background_blend", 4: "stellar_companion"}
    report = assembly.blend_report(xmatch.blend_verdicts(asked.withColumns({"t_dust_k": F.lit(None).cast("double"), "tau": c("source_id") * 1.0}), stars))
    assert [r.source_id for r in report[0].collect()] == [2, 4, 1] and {r.source_id for r in report[2].collect()} == {1, 4}


def test_unknown_magnitudes_stay_unknown(spark):
    base = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 0.0, 5000.0, NAN)], "source_id long, ra double, dec double, pmra double, pmdec double, teff double, ruwe double")
    rest = spark.createDataFrame([(1, 9.0, 0.02, 9.0, 0.02, 1.0, 2.0, 9.5, 9.3, 9.2)], "source_id long, W1mag double, e_W1mag double, W2mag double, e_W2mag double, ra_wise double, dec_wise double, Jmag double, Hmag double, Ksmag double")
    row = assembly.analysis_table(base, [rest]).first()
    assert row.W1mag_unwise is None and row.ruwe is None and math.isinf(row.gaia_nn_arcsec) and row.e_pmra_wise == 50.0 and row.known_disk is False
    assert assembly.analysis_table(base, [rest]).select(catalog.crowding_ok(catalog.DEFAULT).alias("ok")).first().ok
    with pytest.raises(ValueError):
        assembly.analysis_table(base, [])


def test_line_score(spark):
    rows = [((10.0, 1.0, 1), 0.45 * (1 - math.exp(-1)) + 0.35 + 0.2), ((-1.0, NAN, 2), 0.35 + 0.1), ((1e9, None, 1), 1.0), ((10.0, 1.25, 4), 0.45 * (1 - math.exp(-1)) + 0.35 * math.exp(-0.5) + 0.05)]
    assert column(spark, [r for r, _ in rows], "s double, w double, n int", spectra.line_score(c("s"), c("w"), c("n"))) == pytest.approx([x for _, x in rows])


def test_good_frames(spark):
    rows = [(1, "w1", float(k), 12.0 + (k % 2) * 0.1, 0.01, 1, "00h0") for k in range(12)] + [(1, "w1", 50.0, 20.0, 0.01, 0, "0000"), (1, "w1", 51.0, 20.0, 0.01, 5, "0D00")] + [(2, "w1", float(k), 12.0, 0.01, 1, "0000") for k in range(11)]
    df = spark.createDataFrame(rows, "source_id long, band string, mjd double, mag double, magerr double, qual_frame int, cc_flags string").withColumn("tiebreak", c("mjd"))
    got = {r.source_id: (r.n_kept, r.frac_rms) for r in assembly.frame_rms(df).collect()}
    rms = 0.4 * math.log(10) * math.sqrt(0.05**2 * 12 / 11 - 0.01**2)
    assert got[1][0] == 12 and got[1][1] == pytest.approx(rms) and got[2][1] is None
    assert {r.source_id: (r.n_epochs, r.n_seasons, r.slope) for r in assembly.frame_fades(df).collect()} == {1: (12, 0, None), 2: (11, 0, None)}
