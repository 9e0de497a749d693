"""Registered queries over positions, orbits and motions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.exprs import KMS_PER_MASYR_KPC
from skysift.operators import assembly as A
from skysift.operators import encounters as N
from skysift.operators import orbits as O
from skysift.operators import xmatch as M
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import rounded

c = F.col


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "catalogue")


def _b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "sky_b")


def sky_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.within(_a(spark, sf_dir).select("source_id", "ra", "dec"), _b(spark, sf_dir), 6.0).select("source_id", "cand_id", "sep"), 4)


def sky_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir)
    twice = b.unionByName(b.withColumns({"cand_id": c("cand_id") + 100000, "ra": c("ra") + 0.0003}))
    return rounded(M.nearest(_a(spark, sf_dir).select("source_id", "ra", "dec"), twice, 8.0).select("source_id", "cand_id", "sep"), 4)


def sky_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.cone(_a(spark, sf_dir), 120.0, 10.0, 20.0).filter("parallax_over_error > 10 AND ruwe < 1.4 AND phot_g_mean_mag < 15")
    return rounded(d.select("source_id", "ra", "dec"))


def counterpart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.neighbour_counts(M.within(_a(spark, sf_dir).select("source_id", "ra", "dec"), _b(spark, sf_dir), 6.0))


def known_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir)
    ids = b.filter("cand_id % 3 = 0").select((c("cand_id") * 7).alias("source_id"))
    return M.known_flag(_a(spark, sf_dir).select("source_id", "ra", "dec"), ids, b.filter("cand_id % 2 = 0"), 6.0).select("source_id", "known")


def _literature(b: DataFrame) -> DataFrame:
    label = F.concat(F.lit("cat"), (c("cand_id") % 4).cast("string"))
    ident = F.when(c("cand_id") % 3 == 0, c("cand_id") * 7).when(c("cand_id") % 3 == 1, (c("cand_id") - 1) * 7).otherwise(-1)
    return b.select(label.alias("label"), ident.alias("id"), "ra", "dec")


def literature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.literature_match(_a(spark, sf_dir).select("source_id", "ra", "dec"), _literature(_b(spark, sf_dir)), 6.0).select("source_id", "labels", "match_kind", "in_literature")


def novel_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir).select("source_id", "ra", "dec")
    return M.novel(a, _literature(_b(spark, sf_dir)), a.filter("source_id % 40 = 0")).select("source_id")


def blend_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir).select("source_id", "ra", "dec", c("phot_g_mean_mag").alias("g"), "bp_rp", "pmra", "pmdec")
    b = _b(spark, sf_dir).select((c("cand_id") + 1000000).alias("source_id"), "ra", "dec", (c("mag") + 2.0).alias("g"), (c("cand_id") % 5 * 1.0).alias("bp_rp"), (c("cand_id") * 7 * 31 % 401 - 200.0).alias("pmra"), (c("cand_id") * 11 % 401 - 200.0).alias("pmdec"))
    chosen = a.withColumn("t_dust_k", (c("source_id") % 40) * 50.0)
    return rounded(M.blend_verdicts(chosen, a.unionByName(b), 6.5).select("source_id", "n_in_beam", "nearest", "flux_ratio", "comoving", "verdict"), 4)


def blend_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors of the blend follow-up, by the report's verdicts."""
    v = blend_verdicts(spark, sf_dir).withColumn("tau", c("source_id") % 9 / 10.0)
    return A.blend_report(v)[2].select("source_id", "verdict")


def blend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blend_report(blend_verdicts(spark, sf_dir).withColumn("tau", c("source_id") % 9 / 10.0))[1]


def hr_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = M.hr_class(c("phot_g_mean_mag") - c("source_id") % 12, c("bp_rp"), c("parallax"), c("parallax_over_error") - 4)
    return _a(spark, sf_dir).select("source_id", kind.alias("hr_class"))


def excess_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(c("source_id") % 6 == 0, "EB*Algol").when(c("source_id") % 6 == 1, "Mira Mi*").otherwise("Star")
    w1, w2 = F.when(c("source_id") % 14 != 5, c("W1mag")), F.when(c("source_id") % 10 == 3, float("nan")).otherwise(c("W2mag"))
    return _a(spark, sf_dir).select("source_id", M.excess_verdict(w1, w2, c("Ksmag"), kind).alias("verdict"))


def object_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.context(_a(spark, sf_dir).select("source_id", "ra", "dec"), _b(spark, sf_dir), 5.0).select("source_id", "n_context", "nearest_kind")


def planet_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = _b(spark, sf_dir), c("cand_id")
    p = b.select(n.alias("planet_id"), F.concat(F.lit("host"), n.cast("string")).alias("host"), F.when(n % 2 == 0, F.concat(F.lit("DR3 1"), F.lpad((n * 7).cast("string"), 6, "0"))).alias("id_text"), "ra", "dec", (n % 30 / 10.0).alias("radius"), F.when(n % 3 > 0, n % 25 / 10.0).alias("insolation"), F.when(n % 4 > 0, n * 13 % 500 + 50.0).alias("temperature"))
    targets = _a(spark, sf_dir).select((c("source_id") + 1000000).alias("source_id"), "ra", "dec")
    return M.host_match(targets, p, 6.0).select("source_id", "n_planets", "temperate", "hycean", "host")


def accelerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = O.accelerations(bound(spark, sf_dir, "accelerations"))
    return rounded(d.select("source_id", "accel_total", "significance", "dist_pc", (c("accel_si") * 1e12).alias("accel_pm"), "implied_mass", "abs_g", "companion_abs_g", "dark"), 4)


def acceleration_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.rank_accelerations(O.accelerations(bound(spark, sf_dir, "accelerations"))).select("source_id", "rank_score"), 6)


def unexplained_accelerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = O.accelerations(bound(spark, sf_dir, "accelerations")).filter("significance > 50")
    return O.without_orbits(a, bound(spark, sf_dir, "orbits")).select("source_id")


def orbit_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.orbits(bound(spark, sf_dir, "orbits")).select("source_id", "a0_mas", "mass_function", "m1", "m2", "amrf", "triage_class", "compact"), 4)


def dark_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.rank_dark(O.orbits(bound(spark, sf_dir, "orbits"))).select("source_id", "m2", "triage_class", "rank_score"), 4)


def phase_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.tangential_velocity(N.phase_space(bound(spark, sf_dir, "stars")))
    return rounded(d.select("source_id", *N.POSITION, *N.VELOCITY, "vtan"), 4)


def _met(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = N.phase_space(bound(spark, sf_dir, "stars"))
    anchor = stars.filter("radial_velocity IS NOT NULL").orderBy("source_id").limit(1)
    return N.closest_approach(stars, anchor)


def close_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.transfer(_met(spark, sf_dir)).filter("v_rel_kms > 0").select("source_id", "sep_now_pc", "v_rel_kms", "t_enc_myr", "d_min_pc", "past_encounter", "transfer_score", "comoving"), 5)


def regime_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.regime_sweep(_met(spark, sf_dir).filter("v_rel_kms > 0")), 5)


def destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.rank_targets(N.destinations(_met(spark, sf_dir).filter("v_rel_kms > 0")))
    return rounded(d.select("source_id", "cross_yr_0", "abs_g", "ms_residual", "lum_class", "dest_score"), 4)


#: Errors of the stars' astrometry, as the given tables have none: some differ by star, some are unknown.
ERRORS = {
    "parallax": "0.02e0 + (source_id % 5) / 50e0", "pmra": "0.03e0 + (source_id % 7) / 100e0", "pmdec": "CASE WHEN source_id % 11 = 0 THEN NULL ELSE 0.05e0 END",
    "radial_velocity": "CASE WHEN source_id % 13 = 0 THEN -1e0 ELSE 0.5e0 + (source_id % 3) END",
}


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "stars").withColumns({f"{n}_error": F.expr(e) for n, e in ERRORS.items()})


def _recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.transfer(_met(spark, sf_dir).filter("t_enc_myr < 0 AND d_min_pc <= 5 AND v_rel_kms > 0"))


def encounter_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = _measured(spark, sf_dir)
    anchor = stars.filter("radial_velocity IS NOT NULL").orderBy("source_id").limit(1)
    near = stars.join(_recipients(spark, sf_dir).select("source_id"), "source_id", "left_semi")
    return rounded(N.encounter_uncertainty(near, anchor, 3000), 4)


def encounter_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of recipients with the photometry and score of the search; the anchor's velocity error is unknown."""
    stars = _measured(spark, sf_dir)
    anchor = stars.filter("radial_velocity IS NOT NULL").orderBy("source_id").limit(1).withColumn("radial_velocity_error", F.lit(None).cast("double"))
    out = N.encounter_followup(_recipients(spark, sf_dir).filter("transfer_score > 0"), stars, anchor, 3000)
    return rounded(out.select("source_id", "n_valid", "d_min_pc_50", "frac_2pc", "robust", "phot_g_mean_mag", "bp_rp", "dist_pc", "transfer_score"), 4)


def control_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _a(spark, sf_dir), _b(spark, sf_dir)
    return rounded(M.control_union(a.filter("known_disk").select("source_id", "ra", "teff"), b.select(c("cand_id").alias("source_id"), "ra", "mag")))


def literature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("cand_id")
    raw = _b(spark, sf_dir).select(F.concat(F.lit("x"), n.cast("string")).alias("name"), F.when(n % 2 == 0, (n * 7).cast("string")).otherwise("none").alias("gaia"), (n % 5 - 2).alias("other"), "ra", "dec")
    return rounded(M.literature_table(raw, "survey", ("gaia", "other")))


def shortlist_photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _b(spark, sf_dir).select("cand_id", "ra", "dec", c("mag").alias("g"), (c("cand_id") % 30 / 10.0).alias("bp_rp"), (c("cand_id") % 20 + 1.0).alias("parallax"), (c("cand_id") % 12 * 1.0).alias("parallax_snr"))
    return M.with_photometry(_a(spark, sf_dir).select("source_id", "ra", "dec"), b, 6.0).select("source_id", "cand_id", "hr_class")


def overlapping_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _a(spark, sf_dir).select(c("source_id").alias("spec_id"), (c("source_id") % 3).alias("release"), "ra", "dec")
    b = _b(spark, sf_dir).select((c("cand_id") + 1000000).alias("spec_id"), ((c("cand_id") + c("cand_id") % 2) % 3).alias("release"), "ra", "dec")
    return rounded(M.overlapping_spectra(a.unionByName(b), 6.0), 4)


def luminous_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir, "orbits").select("source_id", (c("ruwe") / 2).alias("bp_rp_excess"))
    return M.luminous_companion(bound(spark, sf_dir, "accelerations").select("source_id"), e).select("source_id", "luminous_companion")


QUERIES = {f.__name__: f for f in (control_union, literature_table, shortlist_photometry, overlapping_spectra, luminous_companions, sky_pairs, sky_nearest, sky_cone, counterpart_counts, known_objects, literature_match, novel_sources, blend_verdicts, blend_survivors, blend_counts, hr_classes, excess_verdicts, object_context, planet_hosts, accelerations, acceleration_rank, unexplained_accelerations, orbit_masses, dark_companions, phase_space, close_encounters, regime_sweep, destinations, encounter_uncertainty, encounter_followup)}

_A, _B = duck("catalogue"), duck("sky_b")


def _sep(ra: str, dec: str, ra0: str, dec0: str) -> str:
    return f"(sqrt(pow(least(abs({ra} - {ra0}), 360e0 - abs({ra} - {ra0})) * cos(radians({dec0})), 2) + pow({dec} - {dec0}, 2)) * 3600e0)"


def _pairs(radius: float, a: str = _A, b: str = _B) -> str:
    return f"(SELECT a.source_id, b.*, {_sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} AS sep FROM {a} a JOIN {b} b ON abs(a.dec - b.dec) <= {radius / 3600 * 1.01!r} AND {_sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= {radius})"


_LIT = f"(SELECT 'cat' || (cand_id % 4) AS label, CASE cand_id % 3 WHEN 0 THEN cand_id * 7 WHEN 1 THEN (cand_id - 1) * 7 ELSE -1 END AS id, ra, dec FROM {_B})"


def _matched(radius: float) -> str:
    return f"""
WITH a AS (SELECT source_id, ra, dec FROM {_A}), l AS (SELECT * FROM {_LIT}),
i AS (SELECT id, string_agg(label, ';' ORDER BY label) AS labels FROM (SELECT DISTINCT id, label FROM l WHERE id > 0) GROUP BY id),
p AS (SELECT source_id, arg_min(label, struct_pack(a := sep, b := label)) AS label FROM {_pairs(radius, "a", "l")} GROUP BY 1),
m AS (SELECT a.source_id, coalesce(labels, label, '') AS labels, CASE WHEN labels IS NOT NULL THEN 'id' WHEN label IS NOT NULL THEN 'position' ELSE 'none' END AS match_kind FROM a LEFT JOIN i ON i.id = a.source_id LEFT JOIN p ON p.source_id = a.source_id)"""


def _rot(x: str, y: str, z: str, scale: str) -> list[str]:
    return [f"({scale} * ({r[0]!r}e0 * ({x}) + {r[1]!r}e0 * ({y}) + {r[2]!r}e0 * ({z})))" for r in N.ROTATION]


def _space(rows: str) -> str:
    k = KMS_PER_MASYR_KPC / 1000
    a, d = f"({k!r}e0 * pmra * dist)", f"({k!r}e0 * pmdec * dist)"
    r, de = "radians(ra)", "radians(dec)"
    pos = _rot(f"cos({de}) * cos({r})", f"cos({de}) * sin({r})", f"sin({de})", "dist")
    vel = _rot(f"radial_velocity * cos({de}) * cos({r}) - {a} * sin({r}) - {d} * sin({de}) * cos({r})", f"radial_velocity * cos({de}) * sin({r}) + {a} * cos({r}) - {d} * sin({de}) * sin({r})", f"radial_velocity * sin({de}) + {d} * cos({de})", "1e0")
    names = ", ".join(f"{e} AS {n}" for n, e in zip(N.POSITION + N.VELOCITY, pos + vel))
    return f"(SELECT *, {names} FROM (SELECT *, CASE WHEN parallax >= 0.5e0 THEN 1000e0 / parallax END AS dist FROM {rows}) s)"


_STARS = duck("stars")
_ANCHOR = f"(SELECT {', '.join(f'{n} AS {n}_0' for n in N.POSITION + N.VELOCITY)} FROM {_space(_STARS)} s WHERE radial_velocity IS NOT NULL ORDER BY source_id LIMIT 1)"


def _approach(rows: str) -> str:
    dr, dv = [f"({n} - {n}_0)" for n in N.POSITION], [f"({n} - {n}_0)" for n in N.VELOCITY]
    k = f"{N.PC_PER_MYR!r}e0"
    sep, rel = (f"sqrt({' + '.join(f'{x} * {x}' for x in d)})" for d in (dr, dv))
    dot = " + ".join(f"{a} * {b}" for a, b in zip(dr, dv))
    ends = " + ".join(f"pow({a} + {b} * {k} * t_enc_myr, 2)" for a, b in zip(dr, dv))
    return f"(SELECT *, sqrt({ends}) AS d_min_pc FROM (SELECT *, CASE WHEN v_rel_kms > 0 THEN -({dot}) * {k} / pow(v_rel_kms * {k}, 2) END AS t_enc_myr FROM (SELECT *, {sep} AS sep_now_pc, {rel} AS v_rel_kms FROM {rows} s, {_ANCHOR} z) q) w)"


_MET = _approach(_space(_STARS))
_ESC = f"sqrt({2 * N.GM_SUN * 0.36 / N.PC_KM!r} / d_min_pc)"
_RIDGE = "CASE " + " ".join(f"WHEN bp_rp >= {x0}e0 AND bp_rp <= {x1}e0 THEN {y0}e0 + (bp_rp - {x0}e0) * {(y1 - y0) / (x1 - x0)!r}e0" for (x0, y0), (x1, y1) in reversed(list(zip(N.RIDGE, N.RIDGE[1:])))) + " END"
_ORB = f"""
WITH o0 AS (SELECT *, (a_ti * a_ti + b_ti * b_ti + f_ti * f_ti + g_ti * g_ti) / 2e0 AS u, a_ti * g_ti - b_ti * f_ti AS v, period / 365.25e0 AS py, 1000e0 / parallax AS dist_pc, phot_g_mean_mag + 5e0 * log10(parallax / 100e0) AS abs_g FROM {duck("orbits")}),
o1 AS (SELECT *, sqrt(u + sqrt(greatest(u * u - v * v, 0e0))) AS a0_mas, least(greatest(pow(10e0, (4.8e0 - abs_g) / 8e0), 0.1e0), 20e0) AS m1 FROM o0),
o2 AS (SELECT *, pow(a0_mas / parallax, 3) / (py * py) AS f, a0_mas / parallax * pow(py, -2e0 / 3e0) * pow(m1, -1e0 / 3e0) AS amrf FROM o1),
o3 AS (SELECT *, -f AS b_, -2e0 * f * m1 AS c_, -f * m1 * m1 AS d_ FROM o2),
o4 AS (SELECT *, c_ - b_ * b_ / 3e0 AS p_, 2e0 * b_ * b_ * b_ / 27e0 - b_ * c_ / 3e0 + d_ AS q_ FROM o3),
o5 AS (SELECT *, q_ * q_ / 4e0 + p_ * p_ * p_ / 27e0 AS disc FROM o4),
o6 AS (SELECT *, CASE WHEN disc >= 0 THEN cbrt(-q_ / 2e0 + sqrt(disc)) + cbrt(-q_ / 2e0 - sqrt(disc)) ELSE 2e0 * sqrt(-p_ / 3e0) * cos(acos(least(greatest(3e0 * q_ / (2e0 * p_) * sqrt(-3e0 / p_), -1e0), 1e0)) / 3e0) END - b_ / 3e0 AS m2 FROM o5),
o AS (SELECT *, CASE WHEN amrf > {O.CEILING * 2 ** (1 / 3)!r}e0 THEN 3 WHEN amrf > {O.CEILING!r}e0 THEN 2 ELSE 1 END AS triage_class FROM o6)"""
_ACC = f"""
WITH a0 AS (SELECT *, sqrt(accel_ra * accel_ra + accel_dec * accel_dec) AS accel_total, 1000e0 / parallax AS dist_pc, phot_g_mean_mag + 5e0 * log10(parallax / 100e0) AS abs_g FROM {duck("accelerations")}),
a1 AS (SELECT *, accel_total / sqrt(accel_ra_error * accel_ra_error + accel_dec_error * accel_dec_error) AS significance, accel_total / parallax * {KMS_PER_MASYR_KPC * 1e3 / O.YEAR!r} AS accel_si FROM a0),
a2 AS (SELECT *, accel_si * {(3.0 * O.AU) ** 2 / O.GRAVITY / O.SUN!r} AS implied_mass FROM a1),
a AS (SELECT *, CASE WHEN implied_mass > 0 THEN 4.8e0 - 8e0 * log10(implied_mass) END AS companion_abs_g FROM a2)"""


def _uniform(stream: int) -> str:
    x = f"((source_id % 2147483648) * 2654435761 + draw * 40503 + {stream * 69069 + 12345}) % 4294967296"
    x = f"(({x}) * 1103515245 + 12345) % 4294967296"
    return f"((((({x}) % 65536) * 65539 + (({x}) // 65536) * 40503 + 7) % 4294967296 + 0.5e0) / 4294967296e0)"


def _normal(stream: int) -> str:
    return f"(sqrt(-2e0 * ln({_uniform(stream)})) * cos(2e0 * pi() * {_uniform(stream + 1)}))"


def _drawn(rows: str, stream: int, n: int) -> str:
    value = lambda x, i: f"{x} + greatest(coalesce({x}_error, 0e0), 0e0) * {_normal(stream + 2 * i)} AS {x}"
    return f"(SELECT source_id, draw, ra, dec, {', '.join(value(x, i) for i, x in enumerate(N.DRAWN))} FROM {rows} e, range({n}) r(draw))"


_ERRORS = f"(SELECT *, {', '.join(f'{e} AS {n}_error' for n, e in ERRORS.items())} FROM {_STARS})"


def _uncertain(stars: str, anchor: str, n: int) -> str:
    """Table m: a row for each draw of a star and of the anchor."""
    place = ", ".join(f"{x} AS {x}_0" for x in N.POSITION + N.VELOCITY)
    dr, dv = [f"({x} - {x}_0)" for x in N.POSITION], [f"({x} - {x}_0)" for x in N.VELOCITY]
    k, dot = f"{N.PC_PER_MYR!r}e0", " + ".join(f"{a} * {b}" for a, b in zip(dr, dv))
    ends = " + ".join(f"pow({a} + {b} * {k} * t_enc_myr, 2)" for a, b in zip(dr, dv))
    return f"""
ad AS (SELECT draw, {place} FROM {_space(_drawn(anchor, 8, n))} x),
sd AS (SELECT * FROM {_space(_drawn(stars, 0, n))} x JOIN ad USING (draw)),
s1 AS (SELECT *, sqrt({" + ".join(f"{x} * {x}" for x in dv)}) AS v_rel_kms FROM sd),
s2 AS (SELECT *, CASE WHEN v_rel_kms > 0 THEN -({dot}) * {k} / pow(v_rel_kms * {k}, 2) END AS t_enc_myr FROM s1),
m AS (SELECT *, sqrt({ends}) AS d_min_pc FROM s2),
u AS (SELECT source_id, count(d_min_pc) AS n_valid, {", ".join(f"quantile_cont({x}, {p / 100}) AS {x}_{p}" for x in ("d_min_pc", "t_enc_myr", "v_rel_kms") for p in (16, 50, 84))},
  {", ".join(f"avg(CAST({x} AS INTEGER)) AS {y}" for y, x in (("frac_past", "t_enc_myr < 0"), ("frac_1pc", "d_min_pc < 1"), ("frac_2pc", "d_min_pc < 2")))} FROM m WHERE d_min_pc IS NOT NULL GROUP BY 1)"""


_NEAR = f"(SELECT * FROM {_MET} m WHERE t_enc_myr < 0 AND d_min_pc <= 5 AND v_rel_kms > 0)"
_FIRST = f"(SELECT * FROM {_ERRORS} WHERE radial_velocity IS NOT NULL ORDER BY source_id LIMIT 1)"
_ROBUST = "frac_past > 0.9e0 AND frac_2pc > 0.5e0 AS robust"
_R = lambda *names, d=4: ", ".join(f"round({n}, {d}) + 0e0 AS {n}" for n in names)
ORACLE_SQL = {
    "control_union": f"SELECT source_id, round(ra, 5) AS ra, teff, NULL::DOUBLE AS mag FROM {_A} WHERE known_disk UNION ALL SELECT cand_id, round(ra, 5), NULL, round(mag, 5) FROM {_B}",
    "literature_table": f"""
WITH r AS (SELECT CASE WHEN cand_id % 2 = 0 THEN cand_id * 7 END AS a, cand_id % 5 - 2 AS b, ra, dec FROM {_B})
SELECT DISTINCT 'survey' AS label, id, round(ra, 5) AS ra, round(dec, 5) + 0e0 AS dec FROM (SELECT a AS id, ra, dec FROM r UNION ALL SELECT b, ra, dec FROM r) WHERE id > 0""",
    "shortlist_photometry": f"""
WITH p AS (SELECT source_id, arg_min(cand_id, struct_pack(a := sep, b := cand_id)) AS cand_id FROM {_pairs(6.0)} GROUP BY 1),
q AS (SELECT a.source_id, b.cand_id, b.cand_id % 30 / 10e0 AS col, b.mag + 5e0 * log10((b.cand_id % 20 + 1e0) / 100e0) AS mg, b.cand_id % 12 AS snr FROM {_A} a LEFT JOIN p USING (source_id) LEFT JOIN {_B} b ON b.cand_id = p.cand_id),
d AS (SELECT *, mg - (2e0 + 4.3e0 * col - 0.55e0 * col * col + 0.16e0 * col * col * col) AS d FROM q)
SELECT source_id, cand_id, CASE WHEN mg IS NULL OR snr < 5 THEN 'unknown' WHEN d > 4 AND col < 1.2e0 THEN 'white_dwarf' WHEN d < -1.5e0 THEN 'giant' WHEN abs(d) <= 1.5e0 THEN 'main_sequence' ELSE 'evolved_or_pms' END AS hr_class FROM d""",
    "overlapping_spectra": f"""
WITH u AS (SELECT source_id AS source_id, source_id % 3 AS rel, ra, dec FROM {_A} UNION ALL SELECT cand_id + 1000000, (cand_id + cand_id % 2) % 3, ra, dec FROM {_B}), o AS (SELECT source_id AS oid, rel AS orel, ra, dec FROM u)
SELECT p.source_id AS spec_id, oid AS other_id, round(sep, 4) + 0e0 AS sep FROM {_pairs(6.0, "u", "o")} p JOIN u ON u.source_id = p.source_id WHERE oid <> p.source_id AND orel <> u.rel""",
    "luminous_companions": f"SELECT a.source_id, coalesce(ruwe / 2e0 > 1.5e0, false) AS luminous_companion FROM {duck('accelerations')} a LEFT JOIN {duck('orbits')} o USING (source_id)",
    "sky_pairs": f"SELECT source_id, cand_id, round(sep, 4) + 0e0 AS sep FROM {_pairs(6.0)}",
    "sky_nearest": f"""WITH b AS (SELECT cand_id, ra, dec FROM {_B} UNION ALL SELECT cand_id + 100000, ra + 0.0003e0, dec FROM {_B}), a AS (SELECT * FROM {_A})
SELECT source_id, cand_id, round(sep, 4) + 0e0 AS sep FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sep, cand_id) AS r FROM {_pairs(8.0, "a", "b")}) WHERE r = 1""",
    "sky_cone": f"SELECT source_id, round(ra, 5) AS ra, round(dec, 5) + 0e0 AS dec FROM {_A} WHERE {_sep('ra', 'dec', '120e0', '10e0')} <= 72000 AND parallax_over_error > 10 AND ruwe < 1.4e0 AND phot_g_mean_mag < 15",
    "counterpart_counts": f"SELECT source_id, count(*) AS n_neighbours FROM {_pairs(6.0)} GROUP BY 1",
    "known_objects": f"""SELECT source_id, source_id IN (SELECT cand_id * 7 FROM {_B} WHERE cand_id % 3 = 0) OR source_id IN (SELECT source_id FROM {_pairs(6.0)} WHERE cand_id % 2 = 0) AS known FROM {_A}""",
    "literature_match": _matched(6.0) + "SELECT source_id, labels, match_kind, match_kind <> 'none' AS in_literature FROM m",
    "novel_sources": _matched(2.0) + "SELECT source_id FROM m WHERE match_kind = 'none' AND source_id % 40 <> 0",
    "blend_verdicts": f"""
WITH s AS (SELECT source_id, ra, dec, phot_g_mean_mag AS g, bp_rp, pmra, pmdec FROM {_A} UNION ALL SELECT cand_id + 1000000, ra, dec, mag + 2, cand_id % 5, cand_id * 7 * 31 % 401 - 200e0, cand_id * 11 % 401 - 200e0 FROM {_B}),
q AS (SELECT *, g - least(greatest(0.2e0 + 1.1e0 * least(greatest(bp_rp, 0e0), 4e0), 0e0), 5e0) AS red FROM s),
k AS (SELECT *, (source_id % 40) * 50e0 AS t_dust_k FROM q WHERE source_id < 1000000),
n AS (SELECT k.source_id, count(*) AS n, min({_sep("k.ra", "k.dec", "q.ra", "q.dec")}) AS nearest, sum(pow(10e0, -0.4e0 * (q.red - k.red))) AS ratio, bool_or(sqrt(pow(q.pmra - k.pmra, 2) + pow(q.pmdec - k.pmdec, 2)) <= 0.5e0 * sqrt(k.pmra * k.pmra + k.pmdec * k.pmdec)) AS mv
  FROM k JOIN q ON q.source_id <> k.source_id AND abs(k.dec - q.dec) < 0.01e0 AND {_sep("k.ra", "k.dec", "q.ra", "q.dec")} <= 6.5e0 GROUP BY 1)
SELECT k.source_id, coalesce(n, 0) AS n_in_beam, round(nearest, 4) AS nearest, coalesce(round(ratio, 4), 0e0) AS flux_ratio, coalesce(mv, false) AS comoving,
  CASE WHEN t_dust_k > 1800 AND (coalesce(n, 0) = 0 OR ratio < 0.1e0) THEN 'stellar_companion' WHEN coalesce(n, 0) = 0 THEN 'isolated' WHEN ratio < 0.1e0 THEN 'clean' WHEN mv THEN 'comoving_blend' ELSE 'background_blend' END AS verdict FROM k LEFT JOIN n USING (source_id)""",
    "hr_classes": f"""
WITH h AS (SELECT source_id, bp_rp, parallax_over_error - 4 AS snr, phot_g_mean_mag - source_id % 12 + 5e0 * log10(parallax / 100e0) AS mg, least(greatest(bp_rp, -0.2e0), 4e0) AS x FROM {_A}),
d AS (SELECT *, mg - (2e0 + 4.3e0 * x - 0.55e0 * x * x + 0.16e0 * x * x * x) AS d FROM h)
SELECT source_id, CASE WHEN mg IS NULL OR bp_rp IS NULL OR snr < 5 THEN 'unknown' WHEN d > 4 AND bp_rp < 1.2e0 THEN 'white_dwarf' WHEN d < -1.5e0 THEN 'giant' WHEN abs(d) <= 1.5e0 THEN 'main_sequence' ELSE 'evolved_or_pms' END AS hr_class FROM d""",
    "excess_verdicts": f"""
WITH v AS (SELECT source_id, CASE WHEN source_id % 14 <> 5 THEN W1mag END AS w1, CASE WHEN source_id % 10 <> 3 THEN W2mag END AS w2, Ksmag AS k FROM {_A})
SELECT source_id, CASE WHEN coalesce(w1 - w2 > 0.15e0, false) OR coalesce(k - w2 > 0.6e0, false) THEN 'ir_excess_dusty' WHEN source_id % 6 < 2 THEN 'known_variable' WHEN w1 - w2 IS NULL AND k - w2 IS NULL THEN 'no_ir_data' ELSE 'clean' END AS verdict FROM v""",
    "object_context": f"""SELECT a.source_id, coalesce(n, 0) AS n_context, kind AS nearest_kind FROM {_A} a
LEFT JOIN (SELECT source_id, count(*) AS n, arg_min(kind, struct_pack(a := sep, b := cand_id)) AS kind FROM {_pairs(5.0)} GROUP BY 1) p USING (source_id)""",
    "planet_hosts": f"""
WITH p AS (SELECT cand_id AS pid, 'host' || cand_id AS host, CASE WHEN cand_id % 2 = 0 THEN 1000000 + cand_id * 7 END AS id, ra, dec, cand_id % 30 / 10e0 AS radius, CASE WHEN cand_id % 3 > 0 THEN cand_id % 25 / 10e0 END AS ins, CASE WHEN cand_id % 4 > 0 THEN cand_id * 13 % 500 + 50e0 END AS teq FROM {_B}),
f AS (SELECT *, coalesce(CASE WHEN ins IS NOT NULL THEN ins BETWEEN 0.2e0 AND 1.75e0 ELSE teq BETWEEN 180 AND 320 END, false) AS t, radius BETWEEN 1.5e0 AND 2.6e0 AND CASE WHEN ins IS NOT NULL THEN ins BETWEEN 0.01e0 AND 10 WHEN teq IS NOT NULL THEN teq BETWEEN 150 AND 510 ELSE true END AS h FROM p),
a AS (SELECT source_id + 1000000 AS source_id, ra, dec FROM {_A}),
i AS (SELECT a.source_id, count(*) AS n, bool_or(t) AS t, bool_or(h) AS h, min(host) AS host FROM a JOIN f ON f.id = a.source_id GROUP BY 1),
r AS (SELECT * FROM a WHERE source_id NOT IN (SELECT source_id FROM i)),
z AS (SELECT source_id, count(*) AS n, bool_or(t) AS t, bool_or(h) AS h, min(host) AS host FROM {_pairs(6.0, "r", "f")} GROUP BY 1),
u AS (SELECT * FROM i UNION ALL SELECT * FROM z)
SELECT a.source_id, coalesce(n, 0) AS n_planets, coalesce(t, false) AS temperate, coalesce(h, false) AS hycean, host FROM a LEFT JOIN u USING (source_id)""",
    "accelerations": _ACC + f"SELECT source_id, {_R('accel_total', 'significance', 'dist_pc')}, round(accel_si * 1e12, 4) AS accel_pm, {_R('implied_mass', 'abs_g', 'companion_abs_g')}, coalesce(companion_abs_g < abs_g + 0.5e0, false) AS dark FROM a",
    "acceleration_rank": _ACC + "SELECT source_id, round(least(significance, 200e0) / 200e0 * accel_si / max(accel_si) OVER () * least(greatest(1e0 - dist_pc / 500e0, 0e0), 1e0), 6) AS rank_score FROM a WHERE significance >= 20 AND dist_pc <= 500",
    "unexplained_accelerations": _ACC + f"SELECT source_id FROM a WHERE significance > 50 AND source_id NOT IN (SELECT source_id FROM {duck('orbits')})",
    "orbit_masses": _ORB + f"SELECT source_id, {_R('a0_mas')}, round(f, 4) AS mass_function, {_R('m1', 'm2', 'amrf')}, triage_class, m2 >= 3 AND triage_class >= 2 AS compact FROM o",
    "dark_companions": _ORB + "SELECT source_id, round(m2, 4) AS m2, triage_class, round(least(m2 / 15e0, 1e0) * greatest(1e0 - dist_pc / 1000e0, 0e0) * CASE WHEN triage_class >= 3 THEN 1e0 ELSE 0.5e0 END, 4) AS rank_score FROM o WHERE m2 BETWEEN 3 AND 25 AND dist_pc <= 1000 AND ruwe >= 3 AND triage_class >= 2",
    "phase_space": f"SELECT source_id, {_R(*N.POSITION, *N.VELOCITY)}, round({KMS_PER_MASYR_KPC!r}e0 / parallax * sqrt(pmra * pmra + pmdec * pmdec), 4) AS vtan FROM {_space(_STARS)} s",
    "close_encounters": f"""SELECT source_id, {_R('sep_now_pc', 'v_rel_kms', 't_enc_myr', 'd_min_pc', d=5)}, t_enc_myr < 0 AND t_enc_myr >= -10 AS past_encounter,
  CASE WHEN t_enc_myr < 0 AND t_enc_myr >= -10 THEN round(1e0 / (greatest(d_min_pc, 0.01e0) * pow(greatest(v_rel_kms, 0.1e0), 2)), 5) ELSE 0e0 END AS transfer_score, v_rel_kms <= 3 AND sep_now_pc <= 5 AS comoving FROM {_MET} m WHERE v_rel_kms > 0""",
    "regime_sweep": f"""SELECT reservoir, count(*) AS n_past, round(min(v_rel_kms), 5) AS v_rel_min, round(quantile_cont(v_rel_kms, 0.5), 5) AS v_rel_median, round(min(d_min_pc), 5) AS d_min_min, count(*) FILTER (d_min_pc < reservoir) AS n_within,
  count(*) FILTER (v_rel_kms < {_ESC}) AS n_capturable, count(*) FILTER (d_min_pc < reservoir AND v_rel_kms < {_ESC}) AS n_transfers, round(arg_min(v_rel_kms / {_ESC}, struct_pack(a := d_min_pc, b := source_id)), 5) AS speed_excess, round(max(1e0 + pow({_ESC} / v_rel_kms, 2)), 5) AS max_focusing
FROM {_MET} m, (VALUES (0.05e0), (0.1e0), (0.2e0), (0.5e0), (1e0), (2e0)) r(reservoir) WHERE t_enc_myr < 0 AND v_rel_kms > 0 GROUP BY 1""",
    "destinations": f"""
WITH d0 AS (SELECT *, phot_g_mean_mag - 5e0 * log10(dist) + 5e0 AS abs_g FROM {_MET} m WHERE t_enc_myr < 0 AND v_rel_kms > 0),
d1 AS (SELECT *, abs_g - ({_RIDGE}) AS ms_residual FROM d0),
d2 AS (SELECT *, CASE WHEN abs(ms_residual) <= 1.5e0 AND bp_rp < 0.45e0 THEN 'hot_shortlived' WHEN abs(ms_residual) <= 1.5e0 THEN 'main_sequence' WHEN ms_residual < -1.5e0 THEN 'giant' WHEN ms_residual > 3 THEN 'remnant' ELSE 'unknown' END AS lum_class, exp(-pow(bp_rp - 2.6e0, 2) / {2 * 1.1**2!r}e0) AS wish FROM d1)
SELECT source_id, round({N.LY_PER_PC!r}e0 * d_min_pc / 0.001e0, 4) AS cross_yr_0, {_R('abs_g', 'ms_residual')}, lum_class, round(CASE lum_class WHEN 'main_sequence' THEN wish WHEN 'hot_shortlived' THEN 0.1e0 * wish ELSE 0e0 END, 4) AS dest_score FROM d2""",
    "encounter_uncertainty": f"""
WITH c AS (SELECT * FROM {_ERRORS} WHERE source_id IN (SELECT source_id FROM {_NEAR})), {_uncertain("c", _FIRST, 3000)}
SELECT source_id, n_valid, {_R(*(f"{x}_{p}" for x in ("d_min_pc", "t_enc_myr", "v_rel_kms") for p in (16, 50, 84)))}, {_R("frac_past", "frac_1pc", "frac_2pc")}, {_ROBUST} FROM u""",
    "encounter_followup": f"""
WITH l AS (SELECT source_id, phot_g_mean_mag, bp_rp, dist, 1e0 / (greatest(d_min_pc, 0.01e0) * pow(greatest(v_rel_kms, 0.1e0), 2)) AS transfer_score FROM {_NEAR} WHERE t_enc_myr >= -10),
c AS (SELECT * FROM {_ERRORS} WHERE source_id IN (SELECT source_id FROM l)), {_uncertain("c", f"(SELECT * EXCLUDE (radial_velocity_error), 0.5e0 AS radial_velocity_error FROM {_FIRST})", 3000)}
SELECT source_id, n_valid, {_R("d_min_pc_50", "frac_2pc")}, {_ROBUST}, {_R("phot_g_mean_mag", "bp_rp")}, round(dist, 4) AS dist_pc, {_R("transfer_score")} FROM u JOIN l USING (source_id)""",
}
_V = ORACLE_SQL["blend_verdicts"]
ORACLE_SQL["blend_survivors"] = f"SELECT source_id, verdict FROM ({_V}) WHERE verdict IN ('clean', 'isolated')"
ORACLE_SQL["blend_counts"] = f"SELECT verdict, count(*) AS n FROM ({_V}) GROUP BY 1"
