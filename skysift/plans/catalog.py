"""Registered queries over the star catalogue, with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.exprs import BANDS, LN10_04
from skysift.operators import catalog, indicators
from skysift.plans.bindings import bound, duck, sql_mag, sql_model, sql_planck

c = F.col


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Round doubles, so that results of two engines can be compared by value."""
    return df.select(*[(F.round(c(n), digits) + 0.0).alias(n) if t == "double" else c(n) for n, t in df.dtypes])


def _vetted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.analyze(bound(spark, sf_dir, "catalogue"))


def sed_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vetted(spark, sf_dir).select("source_id", "sed_anchor", "W1_pred_mag", "W2_pred_mag", "chi_W1", "chi_W2", "color_excess", "chi_color", "has_excess"))


def funnel_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.DEFAULT
    return rounded(_vetted(spark, sf_dir).select("source_id", "reject_reason", "clean", catalog.wise_offset(p).alias("offset"), catalog.pm_sigma().alias("pm_sigma"), catalog.w2_snr().alias("w2snr")))


def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.funnel_counts(_vetted(spark, sf_dir))


def funnel_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.diagnostics(bound(spark, sf_dir, "catalogue")))


def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.label_rates(_vetted(spark, sf_dir)))


def dust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.dust(_vetted(spark, sf_dir).filter("has_excess"))
    return rounded(d.select("source_id", "t_dust_k", "tau", catalog.in_locus(catalog.DEFAULT).alias("in_locus")))


def analyze_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.candidates(_vetted(spark, sf_dir)).select("source_id", "t_dust_k", "tau", "anomaly_score"))


def locus_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(catalog.calibrate_locus(catalog.dust(_vetted(spark, sf_dir).filter("has_excess AND clean")), 0.9))


def analyze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skysift.operators.limits import occurrence_limit

    d = catalog.anomaly(catalog.dust(_vetted(spark, sf_dir)))
    s = d.agg(F.count(F.lit(1)).alias("n_input"), F.count_if("clean").alias("n_clean"), F.count_if("has_excess").alias("n_excess"), F.count_if(c("clean") & c("has_excess")).alias("n_clean_excess"), F.count_if(c("clean") & c("has_excess") & c("is_candidate")).alias("n_candidates"))
    return rounded(occurrence_limit(s, "n_candidates", "n_clean"), 6)


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.combine(indicators.evaluate(catalog.dust(_vetted(spark, sf_dir))))


def indicator_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_axes(spark, sf_dir).select("source_id", "n_axes", "axes_flagged", "multimodal_score", "multimodal_candidate"), 4)


def indicator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_axes(spark, sf_dir).select("source_id", *(c(f"{n}.score").alias(n) for n, _, _ in indicators.SUITE)), 4)


def indicator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.summary(_axes(spark, sf_dir))


def excess_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skysift.operators.limits import histogram

    return histogram(_vetted(spark, sf_dir), "chi_W2", -10.0, 30.0, 60)


QUERIES = {f.__name__: f for f in (sed_excess, funnel_reasons, funnel_counts, funnel_diagnostics, label_rates, dust_fit, analyze_candidates, locus_calibration, analyze_summary, indicator_axes, indicator_scores, indicator_summary, excess_histogram)}


def _flux(mag: str, b: str) -> str:
    return f"({BANDS[b][1]!r}e0 * pow(10e0, -0.4e0 * {mag}))"


def _scale(bands: tuple[str, ...]) -> str:
    def term(b: str, square: bool) -> str:
        w = f"(1e0 / pow({LN10_04!r} * {_flux(f'{b}mag', b)} * coalesce(e_{b}mag, 0.05e0), 2))"
        model = sql_model("teff", b)
        return f"coalesce({w} * {model if square else _flux(f'{b}mag', b)} * {model}, 0e0)"

    num, den = (" + ".join(term(b, s) for b in bands) for s in (False, True))
    return f"CASE WHEN {den} > 0 THEN ({num}) / ({den}) END"


_FLOOR = LN10_04 * 0.05
_ERR = {b: f"coalesce(e_{b}mag, 0.1e0)" for b in ("W1", "W2")}
VETTED = f"""
WITH c0 AS (SELECT * FROM {duck("catalogue")}),
c1 AS (SELECT *, {_scale(("J", "H", "Ks"))} AS near_, {_scale(("RP", "BP", "G"))} AS wide_ FROM c0),
c2 AS (SELECT *, coalesce(near_, wide_) AS sed_scale, CASE WHEN near_ IS NOT NULL THEN 'nir' WHEN wide_ IS NOT NULL THEN 'gaia' ELSE 'none' END AS sed_anchor FROM c1),
c3 AS (SELECT *, sed_scale * {sql_model("teff", "W1")} AS p1, sed_scale * {sql_model("teff", "W2")} AS p2, {_flux("W1mag", "W1")} AS o1, {_flux("W2mag", "W2")} AS o2 FROM c2),
c4 AS (SELECT *, {sql_mag("p1", "W1")} AS W1_pred_mag, {sql_mag("p2", "W2")} AS W2_pred_mag, o1 - p1 AS x1, o2 - p2 AS x2,
  (o1 - p1) / sqrt(pow({LN10_04!r} * o1 * {_ERR["W1"]}, 2) + pow({_FLOOR!r} * p1, 2)) AS chi_W1,
  (o2 - p2) / sqrt(pow({LN10_04!r} * o2 * {_ERR["W2"]}, 2) + pow({_FLOOR!r} * p2, 2)) AS chi_W2 FROM c3),
c5 AS (SELECT *, W1mag - W2mag - W1_pred_mag + W2_pred_mag AS color_excess FROM c4),
c6 AS (SELECT *, color_excess / sqrt(pow({_ERR["W1"]}, 2) + pow({_ERR["W2"]}, 2) + 0.005e0) AS chi_color FROM c5),
c7 AS (SELECT *, coalesce((chi_W1 >= 5 OR chi_W2 >= 3) AND x2 > 0 AND chi_color >= 2, false) AS has_excess,
  sqrt(pow((ra_wise - ra) * 3.6e6 * cos(radians(dec)) - pmra * (2015.4e0 - 2016e0), 2) + pow((dec_wise - dec) * 3.6e6 - pmdec * (2015.4e0 - 2016e0), 2)) / 1000e0 AS off,
  sqrt(pow(pmra - pmra_wise, 2) / (pow(coalesce(pmra_error, 1e0), 2) + pow(coalesce(e_pmra_wise, 50e0), 2)) + pow(pmdec - pmdec_wise, 2) / (pow(coalesce(pmdec_error, 1e0), 2) + pow(coalesce(e_pmdec_wise, 50e0), 2))) AS pms,
  1e0 / ({LN10_04!r} * e_W2mag) AS w2snr FROM c6),
c8 AS (SELECT *, CASE
  WHEN ruwe > 1.4e0 OR parallax_over_error < 10 OR astrometric_excess_noise > 1 THEN 'astrometry'
  WHEN NOT coalesce(substr(cc_flags, 1, 2) = '00' AND substr(ph_qual, 1, 1) IN ('A', 'B') AND substr(ph_qual, 2, 1) IN ('A', 'B') AND ext_flg <= 0 AND W1mag >= 8 AND coalesce(w2snr, 99e0) >= 5, false) THEN 'wise_quality'
  WHEN NOT coalesce(n_wise_neighbours <= 1 AND coalesce(gaia_nn_arcsec, 1e9) >= 6 AND coalesce({LN10_04!r} * abs(W1mag - W1mag_unwise) <= 0.3e0, true), false) THEN 'crowding'
  WHEN NOT (coalesce(off <= 1, false) AND coalesce(pms <= 3, true)) THEN 'comovement'
  WHEN NOT (coalesce(W1mag - W2mag < 0.8e0, false) AND NOT coalesce(is_qso, false)) THEN 'extragalactic' ELSE '' END AS reject_reason FROM c7),
c9 AS (SELECT *, reject_reason = '' AS clean FROM c8),
g AS (SELECT t, {sql_planck("t", "W1")} / {sql_planck("t", "W2")} AS ratio FROM (SELECT i * {2420.0 / 599!r}e0 + 80e0 AS t FROM range(600) r(i))),
d0 AS (SELECT source_id AS sid, arg_min(t, struct_pack(a := abs(ratio - x1 / x2), b := t)) AS t_dust_k FROM c9, g WHERE x1 > 0 AND x2 > 0 GROUP BY source_id),
d1 AS (SELECT *, CASE WHEN sed_scale > 0 THEN x1 / {sql_model("t_dust_k", "W1")} * pow(t_dust_k, 4) / (sed_scale * pow(teff, 4)) END AS tau FROM c9 LEFT JOIN d0 ON sid = source_id),
v AS (SELECT *, coalesce(t_dust_k BETWEEN 600 AND 2500 AND tau BETWEEN 1e-4 AND 1e-1, false) AS in_locus FROM d1),
a AS (SELECT *, CASE WHEN known_disk THEN 0e0 ELSE CASE WHEN t_dust_k IS NOT NULL AND tau IS NOT NULL AND NOT in_locus THEN 0.5e0 ELSE 0e0 END + 0.3e0 * coalesce(least(greatest(tau / 0.3e0, 0e0), 1e0), 0e0) + 0.2e0 END AS anomaly_score,
  NOT known_disk AND NOT in_locus AND t_dust_k IS NOT NULL AND tau IS NOT NULL AS is_candidate FROM v)
"""
_UV = {b: f"({_flux(f'{b}mag', b)})" for b in ("NUV", "FUV")}
_UVP = {b: f"(sed_scale * {sql_model('teff', b)})" for b in _UV}
_SIG = {b: f"(({_UVP[b]} - {_UV[b]}) / sqrt(pow(coalesce({LN10_04!r} * {_UV[b]} * e_{b}mag, 0.2e0 * {_UV[b]}), 2) + pow(0.3e0 * {_UVP[b]}, 2)))" for b in _UV}
AXES = (
    VETTED
    + f""", i0 AS (SELECT *, greatest({_SIG["NUV"]}, {_SIG["FUV"]}) AS uvs,
  CASE WHEN NUVmag IS NOT NULL AND sed_scale IS NOT NULL THEN least(greatest(({_UVP["NUV"]} - {_UV["NUV"]}) / {_UVP["NUV"]}, 0e0), 1e0) END AS nd,
  coalesce(phot_variable_flag LIKE 'VARIABLE%', false) AS named, sqrt(pmra * pmra + pmdec * pmdec) * 4.74e0 / parallax AS vt FROM a),
i1 AS (SELECT *, CASE WHEN tau <> 0 THEN nd / tau END AS ratio FROM i0),
i2 AS (SELECT *,
  1e0 / (1e0 + exp((5e0 - chi_W2) / 2e0)) AS s_ir_excess, has_excess AS f_ir_excess, chi_W2 IS NOT NULL AS a_ir_excess,
  1e0 / (1e0 + exp((3e0 - uvs) / 1.5e0)) AS s_uv_deficit, coalesce(uvs >= 3, false) AS f_uv_deficit, uvs IS NOT NULL AS a_uv_deficit,
  CASE WHEN ratio > 0 THEN least(greatest(1e0 - abs(log10(ratio)), 0e0), 1e0) END AS s_energy_balance, coalesce(ratio BETWEEN 0.3e0 AND 3e0 AND tau >= 5e-3 AND nd >= 5e-3, false) AS f_energy_balance, ratio IS NOT NULL AS a_energy_balance,
  CASE WHEN ztf_ls_fap > 0 THEN 1e0 / (1e0 + exp((3e0 + log10(ztf_ls_fap)) / 1e0)) END AS s_periodicity, coalesce(ztf_ls_fap <= 1e-3 AND ztf_ls_amp_mag >= 0.02e0, false) AS f_periodicity, ztf_ls_fap IS NOT NULL AS a_periodicity,
  coalesce(1e0 / (1e0 + exp((0.03e0 - ztf_frac_rms) / 0.03e0)), CASE WHEN named THEN 0.6e0 END) AS s_optical_variability, coalesce(ztf_frac_rms >= 0.03e0, false) OR named AS f_optical_variability, ztf_frac_rms IS NOT NULL OR named AS a_optical_variability,
  1e0 / (1e0 + exp((0.05e0 - neowise_w1_frac_rms) / 0.05e0)) AS s_ir_variability, coalesce(neowise_w1_frac_rms >= 0.05e0, false) AS f_ir_variability, neowise_w1_frac_rms IS NOT NULL AS a_ir_variability,
  1e0 / (1e0 + exp((200e0 - vt) / 60e0)) AS s_kinematic, coalesce(vt >= 200, false) AS f_kinematic, vt IS NOT NULL AS a_kinematic FROM i1),
i3 AS (SELECT *, {" + ".join(f"CAST(f_{n} AS INTEGER)" for n, _, _ in indicators.SUITE)} AS n_axes FROM i2)
"""
)
_R = lambda *names, d=5: ", ".join(f"round({n}, {d}) + 0e0 AS {n}" for n in names)
_WEIGHTS = sum(w for _, _, w in indicators.SUITE)
ORACLE_SQL = {
    "sed_excess": VETTED + f"SELECT source_id, sed_anchor, {_R('W1_pred_mag', 'W2_pred_mag', 'chi_W1', 'chi_W2', 'color_excess', 'chi_color')}, has_excess FROM c9",
    "funnel_reasons": VETTED + "SELECT source_id, reject_reason, clean, round(off, 5) AS \"offset\", round(pms, 5) AS pm_sigma, round(w2snr, 5) AS w2snr FROM c9",
    "funnel_counts": VETTED
    + """, s(step, stage, fails) AS (VALUES (0, 'input', []), (1, 'astrometry', ['astrometry']), (2, 'wise_quality', ['astrometry', 'wise_quality']), (3, 'crowding', ['astrometry', 'wise_quality', 'crowding']),
  (4, 'comovement', ['astrometry', 'wise_quality', 'crowding', 'comovement']), (5, 'extragalactic', ['astrometry', 'wise_quality', 'crowding', 'comovement', 'extragalactic']))
SELECT step, stage, count(*) FILTER (NOT list_contains(fails, reject_reason)) AS n FROM c9, s GROUP BY step, stage""",
    "funnel_diagnostics": VETTED
    + """SELECT round(quantile_cont(off, 0.5), 5) AS offset_median, round(quantile_cont(off, 0.9), 5) AS offset_p90, round(quantile_cont(pms, 0.5), 5) AS pm_median, round(quantile_cont(pms, 0.9), 5) AS pm_p90,
  count(*) FILTER (off > 1) AS fail_offset, count(*) FILTER (pms > 3) AS fail_pm FROM c9""",
    "label_rates": VETTED + "SELECT label, count(*) AS n, round(avg(CAST(clean AS DOUBLE)), 5) AS kept_rate FROM c9 GROUP BY label",
    "dust_fit": VETTED + f"SELECT source_id, {_R('t_dust_k', 'tau')}, in_locus FROM v WHERE has_excess",
    "analyze_candidates": VETTED + f"SELECT source_id, {_R('t_dust_k', 'tau', 'anomaly_score')} FROM a WHERE clean AND has_excess AND is_candidate",
    "locus_calibration": VETTED
    + """SELECT round(quantile_cont(t_dust_k, 0.05), 5) AS t_dust_min, round(quantile_cont(t_dust_k, 0.95), 5) AS t_dust_max, round(quantile_cont(tau, 0.05), 5) AS tau_min, round(quantile_cont(tau, 0.95), 5) AS tau_max FROM v WHERE has_excess AND clean""",
    "indicator_axes": AXES
    + f"""SELECT source_id, n_axes, concat_ws(',', {", ".join(f"CASE WHEN f_{n} THEN '{n}' END" for n, _, _ in indicators.SUITE)}) AS axes_flagged,
  round(({" + ".join(f"{w!r}e0 * coalesce(s_{n}, 0e0)" for n, _, w in indicators.SUITE)}) / {_WEIGHTS!r}e0, 4) AS multimodal_score, n_axes >= 2 AS multimodal_candidate FROM i3""",
    "indicator_scores": AXES + f"SELECT source_id, {', '.join(f'round(s_{n}, 4) + 0e0 AS {n}' for n, _, _ in indicators.SUITE)} FROM i3",
    "indicator_summary": AXES
    + " UNION ALL ".join(f"SELECT '{n}' AS axis, count(*) FILTER (f_{n}) AS n_flagged, count(*) FILTER (a_{n}) AS n_available FROM i3" for n, _, _ in indicators.SUITE)
    + " UNION ALL SELECT 'two_or_more', count(*) FILTER (n_axes >= 2), count(*) FROM i3 UNION ALL SELECT 'three_or_more', count(*) FILTER (n_axes >= 3), count(*) FROM i3",
    "excess_histogram": VETTED + f"SELECT CAST(least(floor((least(greatest(chi_W2, -10e0), 30e0) + 10e0) / {40 / 60!r}e0), 59) AS INTEGER) AS bin, count(*) AS n FROM c9 WHERE chi_W2 IS NOT NULL GROUP BY 1",
}

