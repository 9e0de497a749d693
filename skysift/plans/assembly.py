"""Registered queries over the assembled table, rankings and confirmations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.operators import assembly as A
from skysift.operators import catalog
from skysift.operators import encounters as N
from skysift.operators import xmatch as M
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import VETTED, rounded
from skysift.plans.lightcurve import _fit, _seasons
from skysift.plans.sky import _RIDGE

c = F.col


def _cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "catalogue")


def analysis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue taken apart into tables that overlap in columns, and put together again."""
    a = _cat(spark, sf_dir)
    base = a.select("source_id", "ra", "dec", "pmra", "pmdec", "teff")
    astrometry = a.filter("source_id % 11 <> 0").select("source_id", "pmra_error", "pmdec_error", (c("ra") + 1.0).alias("ra"))
    near = a.filter("source_id % 5 <> 0").select("source_id", "Jmag", "Hmag", "Ksmag", (c("teff") * 2.0).alias("teff"))
    wide = a.filter("source_id % 3 <> 0").select("source_id", "W1mag", "e_W1mag", "W2mag", "e_W2mag", "ra_wise", "dec_wise", "cc_flags", "ph_qual", "pmra")
    counts = a.filter("source_id % 2 = 0").select("source_id", "n_wise_neighbours")
    known = a.filter("known_disk").select("source_id")
    out = A.analysis_table(base, [astrometry, near, wide], counts, known.union(known))
    names = ("source_id", "ra", "teff", "pmra", "pmra_error", "Jmag", "W2mag", "w2snr", "cc_flags", "ph_qual", "n_wise_neighbours", "known_disk", "e_pmra_wise", "ext_flg")
    return rounded(out.select(*names))


def assembled_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass each step of the funnel over an assembled table without unWISE magnitudes."""
    a = _cat(spark, sf_dir)
    base = a.select("source_id", "ra", "dec", "pmra", "pmdec", "teff", "pmra_error", "pmdec_error", "parallax_over_error", "ruwe", "astrometric_excess_noise", "logg" if "logg" in a.columns else F.lit(4.0).alias("logg"), "pwd", "is_qso", "label")
    near = a.select("source_id", "Jmag", "Hmag", "Ksmag", "e_Jmag", "e_Hmag", "e_Ksmag", "Gmag", "BPmag", "RPmag", "e_Gmag", "e_BPmag", "e_RPmag")
    wide = a.select("source_id", "W1mag", "e_W1mag", "W2mag", "e_W2mag", "ra_wise", "dec_wise", "pmra_wise", "pmdec_wise", "e_pmra_wise", "e_pmdec_wise", "cc_flags", "ph_qual", "ext_flg", "gaia_nn_arcsec")
    out = A.analysis_table(base, [near, wide], a.select("source_id", "n_wise_neighbours"), a.filter("known_disk").select("source_id"))
    return catalog.funnel(out).select("source_id", "clean")


def flagged_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bound(spark, sf_dir, "sky_b")
    n = c("cand_id") % 7
    text = F.when(n == 0, " Yes ").when(n == 1, "0").when(n == 2, "2.5").when(n == 3, "E").when(n == 4, "no").when(n == 5, "-1")
    return A.flagged_ids(_cat(spark, sf_dir), b.withColumn("excess", text), "excess", 6.0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("source_id")
    return _cat(spark, sf_dir).select(
        "source_id", "bp_rp", (k % 3 > 0).alias("is_candidate"), (k % 4 > 0).alias("is_secular_fader"), (k % 5 > 0).alias("is_glint"), F.when(k % 6 < 4, "main_sequence").when(k % 6 == 4, "giant").alias("hr_class"),
        A.resists_mundane(F.when(k % 6 < 4, F.lit("main_sequence")).when(k % 6 == 4, F.lit("giant")), (k * 13 % 100) / 100.0, 0.4).alias("resists_mundane"),
        (k * 37 % 1009 / 100.0).alias("score"), (k * 41 % 997 / 10.0).alias("secular_sigma"), (k * 43 % 991 / 500.0).alias("glint_max_brighten"),
    )


def dip_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best candidates: a ranked report."""
    return rounded(A.ranked_dips(_events(spark, sf_dir), 50).select("source_id", "resists_mundane", "score"))


def fader_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.ranked_faders(_events(spark, sf_dir)).select("source_id", "bp_rp", "secular_sigma"))


def flash_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.ranked_flashes(_events(spark, sf_dir)).select("source_id", "glint_max_brighten"))


def cross_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spectrum's brightest pixel, looked for in the spectra that stand at the same place."""
    p = bound(spark, sf_dir, "spectra")
    lines = p.groupBy("spec_id").agg(F.max_by("wave", F.struct("flux", -c("pix"))).alias("wavelength"))
    group = F.floor(c("spec_id") / 3)
    places = lines.select("spec_id", (c("spec_id") % 3).alias("release"), (group % 360 + 0.5).alias("ra"), (group % 83 - 41.5 + F.floor(group / 360) / 100.0).alias("dec"))
    return rounded(A.cross_confirmed(lines, M.overlapping_spectra(places, 2.0), p, 4.0, 60.0, 600.0), 4)


def boosted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _cat(spark, sf_dir)
    targets = a.select("source_id", (1.0 + c("source_id") % 50 / 10.0).alias("d_min_pc"), (10.0 + c("source_id") % 90).alias("dist_pc"), "phot_g_mean_mag", "bp_rp")
    hosts = a.filter("source_id % 7 = 0").select("source_id", (c("source_id") % 14 == 0).alias("has_hycean_candidate"))
    out = A.boosted_targets(N.destinations(targets), hosts)
    return rounded(out.select("source_id", "lum_class", "known_planet_host", "has_hycean_candidate", "dest_score"), 4)


def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.target_counts(boosted_targets(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound(spark, sf_dir, name).withColumns({"qual_frame": c("tiebreak") % 4, "cc_flags": F.when(c("tiebreak") % 3 == 0, "00h0").when(c("tiebreak") % 3 == 1, "0000").otherwise("D000")})


def frame_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.frame_rms(_frames(spark, sf_dir, "long_curves")), 6)


def frame_fades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.frame_fades(_frames(spark, sf_dir, "long_curves"), 30), 4)


def survey_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir, "curves").select("source_id", (c("mjd") + 2400000.5).alias("jd"), (c("mag") - c("tiebreak") % 3 * 8.0).alias("mag"), (c("tiebreak") % 5 / 20.0).alias("mag_err"))
    out = A.survey_epochs(e, 20)
    return rounded(out.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("mjd").alias("first"), F.max("mag").alias("faintest")), 6)


def tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bound(spark, sf_dir, "lines").drop("search_mode")
    both = A.tagged_union(lines.filter("line_no % 2 = 0").withColumn("snr", c("significance")), lines.filter("line_no % 2 = 1"))
    return rounded(both.groupBy("search_mode").agg(F.count(F.lit(1)).alias("n"), F.count("snr").alias("n_snr"), F.max("wavelength").alias("reddest")))


def sweep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _cat(spark, sf_dir).groupBy((c("source_id") % 9).alias("field")).agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(c("W1mag") - c("W2mag") > 0.3).alias("n_excess"))
    return A.sweep_totals(fields)


QUERIES = {f.__name__: f for f in (analysis_table, flagged_controls, dip_ranking, fader_ranking, flash_ranking, cross_confirmation, boosted_targets, target_counts, assembled_funnel, frame_scatter, frame_fades, survey_curves, tagged_lines, sweep_totals)}

_A = duck("catalogue")
_C = duck("curves")
_G = f"(SELECT * FROM {duck('long_curves')} WHERE tiebreak % 4 > 0 AND tiebreak % 3 < 2)"
_EVENTS = f"""
WITH e AS (SELECT source_id, bp_rp, source_id % 3 > 0 AS cand, source_id % 4 > 0 AS fader, source_id % 5 > 0 AS flash, CASE WHEN source_id % 6 < 4 THEN 'main_sequence' WHEN source_id % 6 = 4 THEN 'giant' END AS hr,
  source_id % 6 < 4 AND (source_id * 13 % 100) / 100e0 <= 0.4e0 AS resists, (source_id * 37 % 1009) / 100e0 AS score, (source_id * 41 % 997) / 10e0 AS sigma, (source_id * 43 % 991) / 500e0 AS amp FROM {_A})"""
_TARGETS = f"""
WITH t AS (SELECT source_id, 1e0 + source_id % 50 / 10e0 AS d_min_pc, phot_g_mean_mag - 5e0 * log10(10e0 + source_id % 90) + 5e0 AS abs_g, bp_rp, source_id % 7 = 0 AS host, source_id % 14 = 0 AS hycean FROM {_A}),
d1 AS (SELECT *, abs_g - ({_RIDGE}) AS ms FROM t),
d2 AS (SELECT *, CASE WHEN abs(ms) <= 1.5e0 AND bp_rp < 0.45e0 THEN 'hot_shortlived' WHEN abs(ms) <= 1.5e0 THEN 'main_sequence' WHEN ms < -1.5e0 THEN 'giant' WHEN ms > 3 THEN 'remnant' ELSE 'unknown' END AS lum_class, exp(-pow(bp_rp - 2.6e0, 2) / {2 * 1.1**2!r}e0) AS wish FROM d1)"""
ORACLE_SQL = {
    "analysis_table": f"""
WITH a AS (SELECT * FROM {_A})
SELECT source_id, round(ra, 5) AS ra, round(teff, 5) AS teff, round(pmra, 5) + 0e0 AS pmra, CASE WHEN source_id % 11 <> 0 THEN round(pmra_error, 5) ELSE 1e0 END AS pmra_error, CASE WHEN source_id % 5 <> 0 THEN round(Jmag, 5) END AS Jmag,
  CASE WHEN source_id % 3 <> 0 THEN round(W2mag, 5) END AS W2mag, CASE WHEN source_id % 3 <> 0 THEN round(2.5e0 / ln(10e0) / e_W2mag, 5) END AS w2snr, CASE WHEN source_id % 3 <> 0 THEN cc_flags ELSE '0000' END AS cc_flags, CASE WHEN source_id % 3 <> 0 THEN ph_qual ELSE 'AA' END AS ph_qual,
  CASE WHEN source_id % 2 = 0 THEN n_wise_neighbours ELSE 1 END AS n_wise_neighbours, known_disk, 50e0 AS e_pmra_wise, 0 AS ext_flg FROM a""",
    "flagged_controls": f"""
WITH b AS (SELECT * FROM {duck("sky_b")} WHERE cand_id % 7 IN (0, 2, 3))
SELECT DISTINCT source_id FROM {_A} a JOIN b ON abs(a.dec - b.dec) < 0.01 AND
  2 * degrees(asin(sqrt(least(1e0, pow(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(a.ra - b.ra) / 2), 2))))) * 3600 <= 6""",
    "dip_ranking": _EVENTS + "SELECT source_id, resists AS resists_mundane, round(score, 5) AS score FROM e WHERE cand ORDER BY resists DESC, score DESC, source_id LIMIT 50",
    "fader_ranking": _EVENTS + "SELECT source_id, round(bp_rp, 5) + 0e0 AS bp_rp, round(sigma, 5) AS secular_sigma FROM e WHERE fader AND hr = 'main_sequence' AND bp_rp < 0.9e0",
    "flash_ranking": _EVENTS + "SELECT source_id, round(amp, 5) AS glint_max_brighten FROM e WHERE flash AND hr = 'main_sequence'",
    "cross_confirmation": f"""
WITH p AS (SELECT * FROM {duck("spectra")}), l AS (SELECT spec_id, arg_max(wave, struct_pack(a := flux, b := -pix)) AS wavelength FROM p GROUP BY 1),
m AS (SELECT l.spec_id, l.wavelength, o.spec_id AS other_id FROM l JOIN l o ON l.spec_id // 3 = o.spec_id // 3 AND l.spec_id <> o.spec_id),
n AS (SELECT m.spec_id, m.wavelength, other_id, flux, abs(wave - m.wavelength) AS d FROM m JOIN p ON p.spec_id = m.other_id WHERE abs(wave - m.wavelength) <= 600),
o AS (SELECT spec_id, wavelength, other_id, quantile_cont(flux, 0.5) FILTER (d > 60) AS level, stddev_pop(flux) FILTER (d > 60) AS noise, max(flux) FILTER (d <= 60) AS top FROM n GROUP BY 1, 2, 3),
b AS (SELECT spec_id, wavelength, count(*) AS k, max((top - level) / noise) AS s FROM o GROUP BY 1, 2)
SELECT spec_id, wavelength, coalesce(k, 0) AS n_overlap, round(s, 4) + 0e0 AS confirm_sigma, coalesce(s >= 4, false) AS cross_confirmed FROM l LEFT JOIN b USING (spec_id, wavelength)""",
    "boosted_targets": _TARGETS + "SELECT source_id, lum_class, host AS known_planet_host, hycean AS has_hycean_candidate, round(CASE lum_class WHEN 'main_sequence' THEN wish WHEN 'hot_shortlived' THEN 0.1e0 * wish ELSE 0e0 END + CASE WHEN host THEN 0.5e0 ELSE 0e0 END + CASE WHEN hycean THEN 1e0 ELSE 0e0 END, 4) AS dest_score FROM d2",
    "target_counts": _TARGETS + "SELECT count(*) AS n_candidates, count(*) FILTER (lum_class = 'main_sequence') AS n_main_sequence, count(*) FILTER (host) AS n_known_hosts, count(*) FILTER (hycean) AS n_hycean_hosts FROM d2",
    "frame_scatter": f"""
WITH e0 AS (SELECT * FROM {_G}),
m AS (SELECT source_id, band, count(*) AS n, quantile_cont(mag, 0.5) AS med, stddev_pop(mag) AS std FROM e0 GROUP BY 1, 2),
d AS (SELECT source_id, band, 1.4826e0 * quantile_cont(abs(mag - med), 0.5) AS mad FROM e0 JOIN m USING (source_id, band) GROUP BY 1, 2),
k AS (SELECT *, n >= 12 AND abs(mag - med) <= 4e0 * CASE WHEN mad > 0 THEN mad ELSE std END AS ok FROM e0 JOIN m USING (source_id, band) JOIN d USING (source_id, band)),
s AS (SELECT source_id, band, count(*) FILTER (ok) AS n_kept, stddev_samp(mag) FILTER (ok) AS s, quantile_cont(magerr, 0.5) FILTER (ok) AS e FROM k GROUP BY 1, 2)
SELECT source_id, band, n_kept, CASE WHEN n_kept >= 12 THEN round(0.4e0 * ln(10e0) * sqrt(greatest(s * s - e * e, 0e0)), 6) END AS frac_rms FROM s""",
    "frame_fades": _seasons(_G, "source_id, band").replace("nn >= 40", "nn >= 30") + _fit("se", "source_id, band") + f""",
co AS (SELECT source_id, band, count(*) AS n_epochs FROM {_G} GROUP BY 1, 2)
SELECT source_id, band, n_epochs, round(slope, 4) + 0e0 AS slope, round(slope_sigma, 4) + 0e0 AS slope_sigma, coalesce(n_seasons, 0) AS n_seasons FROM co LEFT JOIN ft USING (source_id, band)""",
    "survey_curves": f"""
WITH g AS (SELECT source_id, mjd, mag - tiebreak % 3 * 8e0 AS mag FROM {_C} WHERE tiebreak % 5 / 20e0 < 0.2e0 AND mag - tiebreak % 3 * 8e0 > 0)
SELECT source_id, count(*) AS n, round(min(mjd), 6) AS first, round(max(mag), 6) AS faintest FROM g GROUP BY 1 HAVING count(*) >= 20""",
    "tagged_lines": f"""SELECT CASE WHEN line_no % 2 = 0 THEN 'emission' ELSE 'absorption' END AS search_mode, count(*) AS n, count(*) FILTER (line_no % 2 = 0) AS n_snr, round(max(wavelength), 5) AS reddest FROM {duck("lines")} GROUP BY 1""",
    "sweep_totals": f"""SELECT count(DISTINCT source_id % 9) AS n_fields, count(*) AS n_sources, count(*) FILTER (W1mag - W2mag > 0.3e0) AS n_excess FROM {_A}""",
}
ORACLE_SQL["assembled_funnel"] = VETTED.replace(_A, f"(SELECT * REPLACE (NULL::DOUBLE AS W1mag_unwise, coalesce(e_pmra_wise, 50e0) AS e_pmra_wise, coalesce(gaia_nn_arcsec, 'inf'::DOUBLE) AS gaia_nn_arcsec) FROM {_A})") + "SELECT source_id, clean FROM c9"
