"""Archive scans on rows worked out by hand: each bound, unknown values, order and ties."""

from __future__ import annotations

import math

from skysift.sources import archive as S
from skysift.sources import scans

STAR = "source_id long, ra double, dec double, parallax double, parallax_over_error double, pmra double, pmdec double, radial_velocity double, phot_g_mean_mag double, bp_rp double, ruwe double, phot_variable_flag string, has_xp_sampled boolean"


def star(i, ra=10.0, dec=0.0, parallax=10.0, snr=20.0, rv=1.0, g=14.0, ruwe=1.0, flag="VARIABLE", xp=True):
    return (i, ra, dec, parallax, snr, 1.0, 1.0, rv, g, 1.0, ruwe, flag, xp)


def ids(df, key="source_id"):
    return [r[key] for r in df.collect()]


def test_cone_is_a_great_circle_and_wraps(spark):
    d = spark.createDataFrame([star(1, 359.5, 60.0), star(2, 1.5, 60.0), star(3, 0.0, 61.1), star(4, 180.0, 89.9), star(5, None, 60.0)], STAR)
    assert sorted(ids(S.in_cone(d, 0.0, 60.0, 1.0))) == [1, 2]
    assert ids(S.in_cone(d, 0.0, 89.95, 1.0)) == [4]


def test_field_targets(spark):
    rows = [star(9), star(1, g=12.9), star(2, g=18.5), star(3, flag="NOT_AVAILABLE"), star(4, ra=12.0), star(5, g=None), star(6, flag=None)]
    d = spark.createDataFrame(rows, STAR)
    assert sorted(ids(S.field_targets(d, 10.0, 0.0))) == [2, 9]
    assert ids(S.field_targets(d, 10.0, 0.0, variable_only=False, n=3)) == [2, 3, 6]
    south = spark.createDataFrame([star(1, dec=-28.0), star(2, dec=-27.9)], STAR)
    assert ids(S.field_targets(south, 10.0, -28.0)) == [2]


def test_cone_stars_and_shell(spark):
    d = spark.createDataFrame([star(1), star(2, snr=10.0), star(3, ruwe=1.4), star(4, parallax=5.0), star(5, g=15.0), star(6), star(7, snr=8.0, rv=None)], STAR)
    measured = spark.createDataFrame([(i, 1.0) for i in range(1, 6)], "source_id long, W1mag double")
    assert ids(S.cone_stars(d, measured, 10.0, 0.0, 1.0, 5.0, 15.0)) == [1]
    assert sorted(ids(S.anchor_shell(d, 100.0, 50.0, 15.0))) == [1, 2, 6]  # 4 is at 200 pc
    assert ids(S.anchor_shell(d, 150.0, 50.0, 15.0)) == []  # 100 and 200 pc are the shell's own bounds
    assert sorted(ids(S.anchor_shell(d, 150.0, 60.0, 15.0))) == [1, 2, 4, 6]
    assert ids(S.anchor_shell(d, 0.5, 10.0, 15.0)) == []


def test_solutions_with_their_sources(spark):
    d = spark.createDataFrame([star(i, parallax=p) for i, p in ((1, 8.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, 8.5), (6, 7.0))], STAR)
    orbits = [(i, 1.0, 0.1, a, 1.0, 1.0, 1.0, k) for i, a, k in ((3, 1.0, "Orbital"), (2, 1.0, "OrbitalAlternative"), (1, None, "Orbital"), (4, 1.0, "Orbital"), (5, 1.0, "SB1"), (6, 1.0, "Orbital"), (7, 1.0, "Orbital"))]
    o = spark.createDataFrame(orbits, "source_id long, period double, eccentricity double, a_thiele_innes double, b_thiele_innes double, f_thiele_innes double, g_thiele_innes double, nss_solution_type string")
    assert ids(S.orbit_solutions(o, d, 2.0, 3)) == [2, 3, 6]
    a = spark.createDataFrame([(i, 1.0, 1.0, 0.1, 0.1, s) for i, s in ((1, 5.0), (2, 30.0), (3, 30.0), (4, 99.0), (5, None), (6, 40.0))], "source_id long, accel_ra double, accel_dec double, accel_ra_error double, accel_dec_error double, significance double")
    assert ids(S.acceleration_solutions(a, d, 2.0, 5.0, 2)) == [6, 2]


def test_spectra_lists(spark):
    d = spark.createDataFrame([star(3), star(1), star(2, xp=False), star(4, g=17.5), star(5, xp=None)], STAR)
    assert ids(S.spectrum_sources(d, 10.0, 0.0, n=9)) == [1, 3]
    s = spark.createDataFrame([(3, "A", "STAR"), (1, "A", "GALAXY"), (2, "B", "STAR"), (0, None, "STAR")], "spec_id long, data_release string, spectype string")
    assert ids(S.spectrum_ids(s, "A", n=5), "spec_id") == [1, 3]
    assert ids(S.spectrum_ids(s, "A", "STAR"), "spec_id") == [3]
    raw = spark.createDataFrame([(1, 5.0, 1.0, 1), (2, 6.0, 3.0, 1), (3, 6.0, 2.0, 2), (4, 7.0, None, 1)], "spec_id long, wavelength double, hunt_rank double, n_lines_in_spectrum int")
    assert ids(S.confirm_shortlist(raw, 2), "spec_id") == [2, 1]
    assert ids(S.confirm_shortlist(raw, 2, raw.drop("n_lines_in_spectrum").withColumnRenamed("hunt_rank", "significance")), "spec_id") == [2, 3]


def test_near_infrared_and_planets(spark):
    i = spark.createDataFrame([(1,), (2,), (3,), (1,)], "source_id long")
    n = spark.createDataFrame([(1, 10), (2, 20), (4, 10)], "source_id long, clean_oid long")
    links = spark.createDataFrame([(10, "a"), (20, "b")], "clean_oid long, designation string")
    t = spark.createDataFrame([("a", *[float(x) for x in range(6)])], "designation string, j_m double, j_msigcom double, h_m double, h_msigcom double, ks_m double, ks_msigcom double")
    assert [tuple(r) for r in S.near_infrared(i, n, links, t).collect()] == [(1, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)]
    p = spark.createDataFrame([("x", 79.9, 1), ("y", 80.0, 1), ("z", None, 1)], "HostName string, sy_dist double, other int")
    assert [tuple(r) for r in S.nearby_planets(p).collect()] == [("x", 79.9)]


def test_field_candidates_from_files(spark, tmp_path):
    files = {
        "f2/dip.csv": "source_id,resists_mundane\n1,True\n2,False\n3,1\n",
        "f1/dip.csv": "source_id,resists_mundane\n1,true\n",
        "f1/fade.csv": "source_id,hr_class\n1,main_sequence\n5,unknown\n6,main_sequence\n",
        "f1/glint.csv": "source_id,hr_class\n6,main_sequence\n7,main_sequence\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    read = lambda f, x, k: scans.union_of_fields(spark, f"{tmp_path}/*/{f}.csv", f"source_id long, {x} string", k)
    lists = {"dipper": read("dip", "resists_mundane", "dipper"), "secular_fader": read("fade", "hr_class", "secular_fader"), "glint": read("glint", "hr_class", "glint")}
    got = {r.source_id: (r.cand_type, r.field_dir) for r in S.field_candidates(lists).collect()}
    assert got == {1: ("dipper", "f1"), 3: ("dipper", "f2"), 6: ("secular_fader", "f1"), 7: ("glint", "f1")}


def test_nearest_source_and_enrichment(spark):
    at = spark.createDataFrame([("p", 10.0, 0.0), ("q", 50.0, 0.0)], "name string, ra double, dec double")
    s = spark.createDataFrame([star(2, 10.0, 2 / 3600, parallax=20.0), star(1, 10.0, 1 / 3600, parallax=-1.0)], STAR)
    (r,) = S.nearest_sources(at, s).collect()
    assert (r.name, r.gaia_source_id, r.distance_pc, r.abs_g) == ("p", 1, None, None) and math.isclose(r.match_arcsec, 1.0, rel_tol=1e-6)
    near = S.nearest_sources(at, s.filter("source_id = 2")).first()
    assert near.distance_pc == 50.0 and math.isclose(near.abs_g, 14.0 + 5 * math.log10(0.2))
    cands = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(1, 6)], "source_id long, ra double, dec double")
    wise = spark.createDataFrame([(i, 10.0 * i, 0.0, w1, 10.0) for i, w1 in ((1, 10.2), (2, 10.1), (3, 10.1), (5, None))], "cand_id long, ra double, dec double, W1mag double, W2mag double")
    near = spark.createDataFrame([(5, 50.0, 0.0, 1.0, 1.0, 10.7)], "cand_id long, ra double, dec double, Jmag double, Hmag double, Ksmag double")
    objects = spark.createDataFrame([(2, 20.0, 0.0, "eb*"), (1, 10.0, 0.0, "EB*")], "cand_id long, ra double, dec double, otype string")
    got = {r.source_id: r.ir_verdict for r in S.enriched(cands, wise, near, objects).collect()}
    assert got == {1: "ir_excess_dusty", 2: "known_variable", 3: "clean", 4: "no_ir_data", 5: "ir_excess_dusty"}
