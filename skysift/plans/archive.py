"""Registered queries over archive scans and the lists made of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.operators import assembly, catalog
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import ORACLE_SQL as _FUNNEL
from skysift.plans.catalog import rounded
from skysift.plans.sky import _pairs
from skysift.sources import archive as S

c = F.col


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


#: Inputs whose text is the same in both engines.
_ORBITS = ("source_id", "period", "0.1e0 AS eccentricity", "CASE WHEN source_id % 5 <> 0 THEN a_ti END AS a_thiele_innes", "b_ti AS b_thiele_innes", "f_ti AS f_thiele_innes", "g_ti AS g_thiele_innes", "CASE source_id % 3 WHEN 0 THEN 'Orbital' WHEN 1 THEN 'OrbitalTargeted' ELSE 'SB1' END AS nss_solution_type")
_ACCELERATED = ("source_id", "accel_ra", "accel_dec", "accel_ra_error", "accel_dec_error", "abs(accel_ra) / accel_ra_error AS significance")
_SAMPLED = ("source_id", "ra", "dec", "phot_g_mean_mag", "bp_rp", "source_id % 3 <> 0 AS has_xp_sampled")
_SPECTRA = ("vec_id AS spec_id", "CASE vec_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS data_release", "CASE vec_id % 2 WHEN 0 THEN 'STAR' ELSE 'GALAXY' END AS spectype")
_NEIGHBOURS = ("c_custkey AS source_id", "c_custkey * 3 AS clean_oid")
_LINKS = ("o_orderkey AS clean_oid", "concat('P', o_custkey) AS designation")
_TWOMASS = ("concat('P', c_custkey) AS designation", "c_acctbal AS j_m", "0.1e0 AS j_msigcom", "c_acctbal + 1 AS h_m", "0.2e0 AS h_msigcom", "c_acctbal + 2 AS ks_m", "0.3e0 AS ks_msigcom")
_PLANETS = ("concat('host', s_suppkey) AS hostname", "s_suppkey AS GAIA_ID", "CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) / 50 END AS SY_DIST", "s_name AS other")
_DIPPERS = ("o_custkey AS source_id", "concat('field', o_orderkey % 7) AS field_dir", "CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'false' ELSE '1' END AS resists_mundane", "o_totalprice AS score")
_FADERS = ("l_suppkey * 3 AS source_id", "concat('field', l_orderkey % 7) AS field_dir", "CASE l_returnflag WHEN 'N' THEN 'unknown' ELSE 'main_sequence' END AS hr_class", "l_extendedprice AS score")
_GLINTS = ("user_id AS source_id", "concat('field', event_id % 7) AS field_dir", "CASE WHEN value > 20 THEN 'main_sequence' ELSE 'unknown' END AS hr_class", "value AS score")


def field_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.field_targets(bound(spark, sf_dir, "catalogue"), 100.0, 0.0, 60.0, 11.0, 16.0).select("source_id", "ra", "phot_g_mean_mag"))


def cone_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    wise = bound(spark, sf_dir, "catalogue").filter("W1mag < 18").select("source_id", "W1mag")
    return rounded(S.cone_stars(bound(spark, sf_dir, "catalogue"), wise, 350.0, 20.0, 50.0, 3.0, 15.0).select("source_id", "parallax", "W1mag"))


def anchor_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.anchor_shell(bound(spark, sf_dir, "catalogue"), 150.0, 60.0, 16.0).select("source_id", "parallax", "radial_velocity"))


def orbit_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.orbit_solutions(bound(spark, sf_dir, "orbits").selectExpr(*_ORBITS), bound(spark, sf_dir, "catalogue"), 4.0, 40).select("source_id", "a_thiele_innes", "parallax", "ruwe"))


def acceleration_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.acceleration_solutions(bound(spark, sf_dir, "accelerations").selectExpr(*_ACCELERATED), bound(spark, sf_dir, "catalogue"), 3.0, 10.0, 40)
    return rounded(d.select("source_id", "gaia_significance", "parallax"), 4)


def spectrum_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.spectrum_sources(bound(spark, sf_dir, "catalogue").selectExpr(*_SAMPLED), 200.0, -10.0, 40.0).select("source_id", "ra"))


def spectrum_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.spectrum_ids(_table(spark, sf_dir, "embeddings", *_SPECTRA), "B", "STAR", 100)


def near_infrared(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "part", "p_partkey AS source_id", "p_size").filter("p_size > 10")
    return rounded(S.near_infrared(ids, _table(spark, sf_dir, "customer", *_NEIGHBOURS), _table(spark, sf_dir, "orders", *_LINKS), _table(spark, sf_dir, "customer", *_TWOMASS)), 4)


def quality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "part", "p_partkey AS source_id", "p_size").filter("p_size > 10")
    return rounded(S.columns_of(ids, bound(spark, sf_dir, "catalogue"), ("ruwe", "astrometric_excess_noise")))


def nearby_planets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.nearby_planets(_table(spark, sf_dir, "supplier", *_PLANETS)))


def field_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"dipper": ("orders", _DIPPERS), "secular_fader": ("lineitem", _FADERS), "glint": ("events", _GLINTS)}
    return rounded(S.field_candidates({k: _table(spark, sf_dir, t, *x) for k, (t, x) in lists.items()}).select("source_id", "cand_type", "field_dir", "score"), 4)


def nearest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.nearest_sources(bound(spark, sf_dir, "sky_b").withColumnRenamed("cand_id", "name"), bound(spark, sf_dir, "catalogue"), 6.0).select("name", "gaia_source_id", "distance_pc", "abs_g", "match_arcsec"), 4)


def enriched_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bound(spark, sf_dir, "sky_b")
    wise = b.filter("cand_id % 5 <> 0").withColumns({"W1mag": c("mag"), "W2mag": c("mag") - c("cand_id") % 4 / 4.0})
    near = b.filter("cand_id % 3 <> 0").withColumns({"Jmag": c("mag") + 1.0, "Hmag": c("mag") + 0.5, "Ksmag": c("mag") + c("cand_id") % 7 / 5.0})
    objects = b.withColumn("otype", F.when(c("cand_id") % 2 == 0, "EB*").otherwise("Star"))
    d = S.enriched(bound(spark, sf_dir, "catalogue").select("source_id", "ra", "dec"), wise, near, objects, 6.0)
    return rounded(d.select("source_id", "W1_W2", "K_W2", "otype", "ir_verdict"), 4)


def confirm_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bound(spark, sf_dir, "lines")
    alone = lines.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_lines_in_spectrum"))
    return rounded(S.confirm_shortlist(lines, 50, lines.join(alone, "spec_id")).select("spec_id", "wavelength", c("significance").cast("double").alias("significance")))


def follow_up_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = bound(spark, sf_dir, "catalogue").select("source_id", (c("bp_rp") * c("parallax")).alias("combined_score"))
    return rounded(assembly.follow_up(score, 25))


def clean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = bound(spark, sf_dir, "catalogue")
    scores = table.select("source_id", (c("teff") / 1e4).alias("tau"), (c("teff") / 10.0).alias("t_dust_k"))
    return rounded(assembly.clean_merged(catalog.analyze(table), scores).select("source_id", "tau", "t_dust_k"))


QUERIES = {f.__name__: f for f in (field_targets, cone_stars, anchor_shell, orbit_solutions, acceleration_solutions, spectrum_sources, spectrum_ids, near_infrared, quality_columns, nearby_planets, field_candidates, nearest_sources, enriched_shortlist, confirm_shortlist, follow_up_input, clean_scores)}

_A, _B = duck("catalogue"), duck("sky_b")


def _cone(ra0: float, dec0: float, radius: float) -> str:
    """The great-circle distance by the law of cosines."""
    return f"degrees(acos(least(1e0, sin(radians(dec)) * sin(radians({dec0}e0)) + cos(radians(dec)) * cos(radians({dec0}e0)) * cos(radians(ra - {ra0}e0))))) <= {radius}"


def _of(source: str, columns: tuple[str, ...]) -> str:
    return f"(SELECT {', '.join(columns)} FROM {source})"


def _near(where: str, columns: str) -> str:
    return f"(SELECT source_id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sep, cand_id) AS i FROM {_pairs(6.0, b=f'(SELECT * FROM {_B} WHERE {where})')}) WHERE i = 1)"


_BY_POSITION = _pairs(6.0, f"(SELECT cand_id AS source_id, ra, dec FROM {_B})", f"(SELECT source_id AS gaia, ra, dec, parallax, phot_g_mean_mag AS g FROM {_A})")
ORACLE_SQL = {
    "field_targets": f"SELECT source_id, round(ra, 5) AS ra, round(phot_g_mean_mag, 5) AS phot_g_mean_mag FROM {_A} WHERE {_cone(100, 0, 60)} AND phot_g_mean_mag BETWEEN 11 AND 16 AND dec > -28 AND phot_variable_flag = 'VARIABLE'",
    "cone_stars": f"SELECT source_id, round(parallax, 5) AS parallax, round(W1mag, 5) AS W1mag FROM {_A} WHERE {_cone(350, 20, 50)} AND parallax > 3 AND parallax_over_error > 10 AND phot_g_mean_mag < 15 AND ruwe < 1.4e0 AND W1mag < 18",
    "anchor_shell": f"SELECT source_id, round(parallax, 5) AS parallax, round(radial_velocity, 5) AS radial_velocity FROM {_A} WHERE 1000e0 / parallax > 90 AND 1000e0 / parallax < 210 AND parallax_over_error > 8 AND radial_velocity IS NOT NULL AND ruwe < 1.4e0 AND phot_g_mean_mag < 16",
    "orbit_solutions": f"SELECT o.source_id, round(a_thiele_innes, 5) AS a_thiele_innes, round(a.parallax, 5) AS parallax, round(a.ruwe, 5) AS ruwe FROM {_of(duck('orbits'), _ORBITS)} o JOIN {_A} a USING (source_id) WHERE a.parallax > 4 AND nss_solution_type LIKE 'Orbital%' AND a_thiele_innes IS NOT NULL ORDER BY a.parallax DESC, o.source_id LIMIT 40",
    "acceleration_solutions": f"SELECT x.source_id, round(significance, 4) AS gaia_significance, round(a.parallax, 4) AS parallax FROM {_of(duck('accelerations'), _ACCELERATED)} x JOIN {_A} a USING (source_id) WHERE a.parallax > 3 AND significance > 10 ORDER BY significance DESC, x.source_id LIMIT 40",
    "spectrum_sources": f"SELECT source_id, round(ra, 5) AS ra FROM {_of(_A, _SAMPLED)} WHERE {_cone(200, -10, 40)} AND has_xp_sampled AND phot_g_mean_mag < 17.5e0",
    "spectrum_ids": f"SELECT spec_id FROM {_of('embeddings', _SPECTRA)} WHERE data_release = 'B' AND spectype = 'STAR' ORDER BY 1 LIMIT 100",
    "near_infrared": f"""SELECT n.source_id, round(j_m, 4) AS Jmag, j_msigcom AS e_Jmag, round(h_m, 4) AS Hmag, h_msigcom AS e_Hmag, round(ks_m, 4) AS Ksmag, ks_msigcom AS e_Ksmag FROM {_of("customer", _NEIGHBOURS)} n JOIN {_of("orders", _LINKS)} j USING (clean_oid) JOIN {_of("customer", _TWOMASS)} t USING (designation)
WHERE n.source_id IN (SELECT p_partkey FROM part WHERE p_size > 10)""",
    "quality_columns": f"SELECT source_id, round(ruwe, 5) AS ruwe, round(astrometric_excess_noise, 5) AS astrometric_excess_noise FROM {_A} WHERE source_id IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "nearby_planets": f"SELECT hostname, gaia_id AS gaia_id, round(sy_dist, 5) AS sy_dist FROM {_of('supplier', _PLANETS)} WHERE sy_dist IS NOT NULL AND sy_dist < 80",
    "field_candidates": f"""
WITH u AS (SELECT 0 AS k, 'dipper' AS cand_type, source_id, field_dir, score FROM {_of("orders", _DIPPERS)} WHERE lower(resists_mundane) IN ('true', '1')
UNION ALL SELECT 1, 'secular_fader', source_id, field_dir, score FROM {_of("lineitem", _FADERS)} WHERE hr_class = 'main_sequence'
UNION ALL SELECT 2, 'glint', source_id, field_dir, score FROM {_of("events", _GLINTS)} WHERE hr_class = 'main_sequence'),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k, field_dir, score) AS i FROM u)
SELECT source_id, cand_type, field_dir, round(score, 4) AS score FROM r WHERE i = 1""",
    "nearest_sources": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sep, gaia) AS i FROM {_BY_POSITION})
SELECT source_id AS name, gaia AS gaia_source_id, round(CASE WHEN parallax > 0 THEN 1000e0 / parallax END, 4) AS distance_pc, round(CASE WHEN parallax > 0 THEN g + 5e0 * log10(parallax / 100e0) END, 4) AS abs_g, round(sep, 4) AS match_arcsec FROM r WHERE i = 1""",
    "enriched_shortlist": f"""
WITH e AS (SELECT a.source_id, w1 - w2 AS w1w2, k - w2 AS kw2, otype FROM {_A} a LEFT JOIN {_near("cand_id % 5 <> 0", "mag AS w1, mag - (cand_id % 4) / 4e0 AS w2")} w USING (source_id)
  LEFT JOIN {_near("cand_id % 3 <> 0", "mag + (cand_id % 7) / 5e0 AS k")} t USING (source_id) LEFT JOIN {_near("true", "CASE WHEN cand_id % 2 = 0 THEN 'EB*' ELSE 'Star' END AS otype")} o USING (source_id))
SELECT source_id, round(w1w2, 4) AS W1_W2, round(kw2, 4) AS K_W2, otype,
  CASE WHEN coalesce(w1w2 > 0.15e0, false) OR coalesce(kw2 > 0.6e0, false) THEN 'ir_excess_dusty' WHEN otype = 'EB*' THEN 'known_variable' WHEN w1w2 IS NULL AND kw2 IS NULL THEN 'no_ir_data' ELSE 'clean' END AS ir_verdict FROM e""",
    "confirm_shortlist": f"SELECT spec_id, round(wavelength, 5) AS wavelength, CAST(significance AS DOUBLE) AS significance FROM {duck('lines')} WHERE spec_id IN (SELECT spec_id FROM {duck('lines')} GROUP BY 1 HAVING count(*) = 1) ORDER BY significance DESC, spec_id, wavelength LIMIT 50",
    "follow_up_input": f"SELECT source_id, round(bp_rp * parallax, 5) AS combined_score FROM {_A} ORDER BY bp_rp * parallax DESC NULLS LAST, source_id LIMIT 25",
    "clean_scores": f"SELECT source_id, round(teff / 1e4, 5) AS tau, round(teff / 1e1, 5) AS t_dust_k FROM {_A} WHERE source_id IN (SELECT source_id FROM ({_FUNNEL['funnel_reasons']}) WHERE clean)",
}
