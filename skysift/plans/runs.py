"""Registered queries over whole runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.exprs import LN10_04
from skysift.operators import indicators, runs
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import _WEIGHTS, AXES, rounded
from skysift.plans.lightcurve import _LS, _PERIODS
from skysift.plans.sky import _ACC, _LIT, _MET, _ORB, _literature, _matched

c = F.col


def _encounters(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    stars = bound(spark, sf_dir, "stars")
    return runs.encounter_run(stars, stars.filter("radial_velocity IS NOT NULL").orderBy("source_id").limit(1))


def encounter_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_encounters(spark, sf_dir)["shortlist"].select("source_id", "sep_now_pc", "v_rel_kms", "t_enc_myr", "d_min_pc", "transfer_score", "comoving"))


def encounter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_encounters(spark, sf_dir)["summary"])


def _companions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    of = lambda name: bound(spark, sf_dir, name)
    return runs.companion_run(of("accelerations"), of("orbits"), of("catalogue"), _literature(of("sky_b")))


def companion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_companions(spark, sf_dir)["dark"].select("source_id", "m2", "triage_class", "labels", "match_kind", "known", "novel"), 4)


def companion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _companions(spark, sf_dir)["summary"]


def science_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-axis candidates; good infrared frames are made from the curves, types from the second list of positions."""
    curves = bound(spark, sf_dir, "curves")
    frames = curves.select("source_id", F.lit("w1").alias("band"), "mjd", ((c("mag") - 12.0) / 5.0 + 12.0).alias("mag"), "magerr", F.lit(1).alias("qual_frame"), F.lit("0000").alias("cc_flags"))
    n = c("cand_id")
    objects = bound(spark, sf_dir, "sky_b").select(n, "ra", "dec", F.when(n % 3 == 0, "WD*").when(n % 3 == 1, "EB*").alias("otype"), F.when(n % 2 == 0, "DA+M").alias("sptype"))
    out = runs.science_run(bound(spark, sf_dir, "catalogue"), curves, frames, objects, 6.0)["candidates"]
    return rounded(out.select("source_id", "n_axes", "axes_flagged", "multimodal_score", "candidate_class"), 4)


QUERIES = {f.__name__: f for f in (encounter_shortlist, encounter_summary, companion_candidates, companion_summary, science_candidates)}

_A, _B = duck("catalogue"), duck("sky_b")
_SCORED = f"""
WITH m AS (SELECT * FROM {_MET} q WHERE source_id <> (SELECT min(source_id) FROM {duck("stars")} WHERE radial_velocity IS NOT NULL) AND v_rel_kms IS NOT NULL AND sep_now_pc <= 40),
t AS (SELECT *, coalesce(t_enc_myr < 0 AND t_enc_myr >= -10, false) AS past, coalesce(v_rel_kms <= 3 AND sep_now_pc <= 5, false) AS comoving FROM m)"""
_DARK = _ORB + f""",
dk AS (SELECT o.*, least(m2 / 15e0, 1e0) AS w FROM o JOIN (SELECT source_id AS sid FROM {_A}) ON sid = o.source_id WHERE m2 BETWEEN 3 AND 25 AND dist_pc <= 1000 AND ruwe >= 3 AND triage_class >= 2),
mt AS ({_matched(2.0)} SELECT * FROM m),
dl AS (SELECT dk.*, labels, match_kind, match_kind <> 'none' AS lit FROM dk JOIN mt USING (source_id))"""
_BARE = f"(SELECT * REPLACE (NULL::DOUBLE AS ztf_frac_rms, NULL::DOUBLE AS ztf_ls_fap, NULL::DOUBLE AS ztf_ls_amp_mag, NULL::DOUBLE AS neowise_w1_frac_rms) FROM {_A})"
_SHORT = f"({AXES.replace(_A, _BARE)} SELECT source_id FROM i3 WHERE clean AND (n_axes >= 1 OR has_excess))"


def _clipped(curves: str, least: int) -> str:
    return f"""(WITH r0 AS (SELECT * FROM {curves}), rm AS (SELECT source_id, count(*) AS n, quantile_cont(mag, 0.5) AS med, stddev_pop(mag) AS std FROM r0 GROUP BY 1),
rd AS (SELECT source_id, 1.4826e0 * quantile_cont(abs(mag - med), 0.5) AS mad FROM r0 JOIN rm USING (source_id) GROUP BY 1),
rk AS (SELECT *, n >= {least} AND abs(mag - med) <= 4e0 * CASE WHEN mad > 0 THEN mad ELSE std END AS ok FROM r0 JOIN rm USING (source_id) JOIN rd USING (source_id)),
rs AS (SELECT source_id, count(*) FILTER (ok) AS kept, stddev_samp(mag) FILTER (ok) AS s, quantile_cont(magerr, 0.5) FILTER (ok) AS e FROM rk GROUP BY 1)
SELECT source_id, CASE WHEN kept >= {least} THEN {LN10_04!r} * sqrt(greatest(s * s - e * e, 0e0)) END AS frac FROM rs)"""


_C = duck("curves")
_MEASURED = f"""(SELECT a.* REPLACE (o.frac AS ztf_frac_rms, l.fap AS ztf_ls_fap, l.amplitude AS ztf_ls_amp_mag, n.frac AS neowise_w1_frac_rms)
FROM {_A} a LEFT JOIN {_SHORT} s ON s.source_id = a.source_id LEFT JOIN {_clipped(_C, 8)} o ON o.source_id = s.source_id LEFT JOIN ({_PERIODS} SELECT * FROM ls) l ON l.source_id = s.source_id
LEFT JOIN {_clipped(f"(SELECT * REPLACE ((mag - 12e0) / 5e0 + 12e0 AS mag) FROM {_C})", 12)} n ON n.source_id = s.source_id)"""
_NEAR = f"""(SELECT source_id, arg_min(cand_id, struct_pack(a := sep, b := cand_id)) AS cand_id FROM (SELECT a.source_id, b.cand_id,
  2 * degrees(asin(sqrt(least(1e0, pow(sin(radians(a.dec - b.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * pow(sin(radians(a.ra - b.ra) / 2), 2))))) * 3600 AS sep FROM {_A} a JOIN {_B} b ON abs(a.dec - b.dec) < 0.01) WHERE sep <= 6 GROUP BY 1)"""
ORACLE_SQL = {
    "encounter_shortlist": _SCORED
    + "SELECT source_id, round(sep_now_pc, 5) AS sep_now_pc, round(v_rel_kms, 5) AS v_rel_kms, round(t_enc_myr, 5) AS t_enc_myr, round(d_min_pc, 5) AS d_min_pc, round(1e0 / (greatest(d_min_pc, 0.01e0) * pow(greatest(v_rel_kms, 0.1e0), 2)), 5) AS transfer_score, comoving FROM t WHERE past AND d_min_pc <= 2",
    "encounter_summary": _SCORED + "SELECT count(*) AS n_searched, count(*) FILTER (past) AS n_past, count(*) FILTER (past AND d_min_pc <= 2) AS n_shortlist, count(*) FILTER (comoving) AS n_comoving, round(min(d_min_pc) FILTER (past AND d_min_pc <= 2), 5) AS closest_pc FROM t",
    "companion_candidates": _DARK + "SELECT source_id, round(m2, 4) AS m2, triage_class, labels, match_kind, false AS known, NOT lit AND (SELECT count(*) FROM l0) > 0 AS novel FROM dl".replace("l0", f"({_LIT})"),
    "companion_summary": _DARK
    + f""", ac AS ({_ACC} SELECT source_id FROM a WHERE significance >= 20 AND dist_pc <= 500 AND source_id NOT IN (SELECT source_id FROM {duck("orbits")}))
SELECT (SELECT count(*) FROM {duck("accelerations")}) AS n_searched, (SELECT count(*) FROM ac) AS n_accelerated, (SELECT count(*) FROM {duck("orbits")} JOIN (SELECT source_id FROM {_A}) USING (source_id)) AS n_orbits, count(*) AS n_dark, count(*) FILTER (lit) AS n_in_literature, count(*) FILTER (NOT lit) AS n_novel FROM dl""",
    "science_candidates": AXES.replace(_A, _MEASURED)
    + f""", k AS (SELECT i3.*, CASE WHEN cand_id % 3 = 0 THEN 'WD' WHEN cand_id % 3 = 1 THEN 'EB' ELSE '' END AS ot, coalesce(cand_id % 2 = 0, false) AS dwarf, cand_id FROM i3 LEFT JOIN {_NEAR} USING (source_id) WHERE clean AND n_axes >= 2)
SELECT source_id, n_axes, concat_ws(',', {", ".join(f"CASE WHEN f_{n} THEN '{n}' END" for n, _, _ in indicators.SUITE)}) AS axes_flagged, round(({" + ".join(f"{w!r}e0 * coalesce(s_{n}, 0e0)" for n, _, w in indicators.SUITE)}) / {_WEIGHTS!r}e0, 4) AS multimodal_score,
  CASE WHEN cand_id IS NULL OR (ot = '' AND NOT dwarf) THEN 'unexamined' WHEN ot = 'EB' THEN 'eclipsing binary' WHEN dwarf THEN 'WD+dwarf binary' WHEN ot = 'WD' THEN 'white dwarf (other)' END AS candidate_class FROM k""",
}
