"""Registered queries over scans, decisions, sinks and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.tables import shared_folder
from skysift.operators import catalog, indicators, lightcurve, xmatch
from skysift.operators import verdicts as V
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import AXES, rounded
from skysift.plans.lightcurve import _LONG, DIPS, _fit, _runs, _seasons
from skysift.sources import scans, sinks
from skysift.streaming import twins

c = F.col


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "catalogue")


def parent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scans.ingest(_stars(spark, sf_dir)).withColumn("parallax_error", F.lit(0.2))
    return rounded(scans.parent_sample(d, 200.0, 0.93).select("source_id", "parallax_over_error"))


def aliased_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.aliased(_stars(spark, sf_dir), {"id": ("objid", "source_id"), "lon": ("RAJ2000", "ra"), "none": ("absent",)}))


def first_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.first_rows(_stars(spark, sf_dir).filter("parallax > 4").select("source_id", "label"), 50)


def photometry_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stars(spark, sf_dir).select("source_id", "W1mag", "W2mag")
    ids = bound(spark, sf_dir, "sky_b").select((c("cand_id") * 7).alias("source_id"))
    return rounded(scans.by_ids(d.union(d), ids.union(ids)))


def distance_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.distance_shell(bound(spark, sf_dir, "stars"), 25.0, 5.0, 14.0).select("source_id")


def spectra_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bound(spark, sf_dir, "spectra").withColumnRenamed("spec_id", "source_id")
    meta = p.filter("pix = 0").select("source_id", "label")
    d = scans.aligned(meta, scans.samples_to_arrays(p.filter("pix < 63 OR source_id % 2 = 0")), 64)
    return rounded(d.select("source_id", "label", F.size("wave").alias("n"), F.aggregate("flux", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("flux", 5).alias("fifth")))


def region_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bound(spark, sf_dir, "curves")
    e = e.select(c("source_id").alias("oid"), "mjd", "mag", (c("tiebreak") % 17 / 10.0).alias("ra"), (c("tiebreak") % 19 / 10.0).alias("dec"), (c("source_id") % 4).alias("field"), F.when(c("source_id") % 3 > 0, c("source_id") % 3).alias("ccdid"), F.lit(1).alias("qid"), F.when(c("tiebreak") % 29 == 0, 32768).otherwise(0).alias("catflags"))
    return rounded(scans.region_sources(scans.good_epochs(e), 60))


def field_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.in_tiles(_stars(spark, sf_dir).select("source_id", "ra", "dec"), scans.tiles(spark, 120.0, 10.0, 20.0, 8.0), 0.5).select("source_id", "tile")


KINDS = ("CV*", "EB*Algol", "**", "SB*", "WD*", "Star", "", "Nova", "WUMa", "QSO", "V*")
SPECTRAL = ("DA3", "G2V", "DA+M4", "DZ7", None, "none", "K2III+K")


def object_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (c("source_id") % len(names)).cast("int") + 1)
    return _stars(spark, sf_dir).select("source_id", V.object_class(pick(KINDS), pick(SPECTRAL)).alias("object_class"), V.shape_class(c("ruwe") - 0.8, c("pwd") - 0.45, c("phot_g_mean_mag") - 2, c("bp_rp"), c("phot_variable_flag"), c("ext_flg")).alias("shape_class"))


def companion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = V.colour_reasons(c("W1mag"), c("W2mag"), c("W2mag") - 0.4, c("W2mag") - 0.7, c("e_W1mag"), c("e_W2mag"), c("e_W2mag") * 4, c("e_W1mag"))
    found = V.companion_reasons(c("ruwe"), c("astrometric_excess_noise") + 0.3, c("parallax_over_error") / 4, c("source_id") % 14, c("ext_flg"))
    return _stars(spark, sf_dir).select("source_id", F.array_join(found, ",").alias("reasons"), F.array_join(red, ",").alias("red"), (F.size(found) > 0).alias("companion_flag"))


def trend_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The g trend as the optical one against the r trend and a third of it, so that bands disagree."""
    f = lightcurve.fades(bound(spark, sf_dir, "long_curves"), ["source_id", "band"])
    p = f.groupBy("source_id").pivot("band", ["g", "r"]).agg(F.first("slope").alias("slope"), F.first("slope_sigma").alias("sigma"))
    second = (F.when(c("source_id") % 3 > 0, -c("r_slope") / 3), c("r_sigma") * 5)
    counterpart = V.infrared_counterpart(c("g_slope") * 10, (F.when(c("source_id") % 4 > 0, c("r_slope")), c("r_sigma") * 4), second)
    return p.select("source_id", counterpart.alias("counterpart"), V.infrared_trend(c("r_slope") * 10, c("r_sigma") * 4).alias("trend"))


def band_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lightcurve.fades(bound(spark, sf_dir, "long_curves"), ["source_id", "band"])
    kinds = f.select("source_id", "band", F.explode(F.array(F.struct(F.lit("fade").alias("kind"), (c("slope") > 0.005).alias("qualifies")), F.struct(F.lit("rise").alias("kind"), (c("slope") < -0.005).alias("qualifies")))).alias("k")).select("source_id", "band", "k.*")
    return V.band_verdicts(kinds)


def vet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _stars(spark, sf_dir), c("source_id")
    ir = xmatch.excess_verdict(c("W1mag"), F.when(k % 10 != 3, c("W2mag")), c("Ksmag") - 0.2, F.when(k % 6 == 0, "EB*").otherwise("Star"))
    kind = F.element_at(F.array(*map(F.lit, V.TYPES)), (k % 3).cast("int") + 1)
    d = d.select("source_id", ir.alias("ir"), kind.alias("kind"), F.when(k % 8 > 0, (k % 9 - 4) / 20.0).alias("amplitude"), "bp_rp", (k % 5 > 2).alias("fade"), (k % 7 > 3).alias("flash"), (k % 4).cast("int").alias("n"), F.when(k % 11 > 0, k % 11 / 10.0).alias("frac"))
    return d.select("source_id", V.vet_verdict(c("ir"), c("kind"), c("amplitude"), c("bp_rp"), c("fade"), c("flash"), c("n"), c("frac")).alias("verdict"))


def vet_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the long curves as a candidate, some of two types, with its own fitted fade, its stars' photometry and its curves."""
    curves, k = bound(spark, sf_dir, "long_curves"), c("source_id")
    fades = lightcurve.fades(curves, ["source_id"]).select("source_id", c("total_change").alias("secular_total_mag"))
    stars = _stars(spark, sf_dir)
    rows = stars.select("source_id", "bp_rp").join(fades, "source_id")
    kinds = F.array(F.element_at(F.array(*map(F.lit, V.TYPES)), (k % 3).cast("int") + 1), F.element_at(F.array(*map(F.lit, V.TYPES)), (k % 5 % 3).cast("int") + 1))
    candidates = rows.select("source_id", F.explode(kinds).alias("cand_type"), "secular_total_mag", (c("bp_rp") / 2).alias("bp_rp"))
    photometry = stars.filter("source_id % 17 > 0").select("source_id", "W1mag", (c("W2mag") + F.when(k % 4 == 0, 0.0).otherwise(1.0)).alias("W2mag"), "Ksmag", F.when(k % 6 == 0, "Mi*").otherwise("Star").alias("otype"))
    # the first epoch of some sources is much brighter
    mag = c("mag") - F.when((k % 2 == 0) & (c("mjd") == c("_first")), 2.0).otherwise(0.0)
    first = curves.groupBy("source_id").agg(F.min("mjd").alias("_first"))
    shown = curves.join(first, "source_id").withColumn("mag", mag).drop("_first")
    return rounded(V.vet_run(candidates, photometry, shown), 4)


def variability_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = indicators.combine(indicators.evaluate(catalog.dust(catalog.analyze(_stars(spark, sf_dir)))))
    return V.shortlist(d, 60).select("source_id", "n_axes")


def target_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stars(spark, sf_dir)
    curves = lightcurve.dip_summary(bound(spark, sf_dir, "curves"), ["source_id"]).select("source_id", "n_events", (c("event_depth") >= 0.3).alias("dip_flag"))
    wise = d.filter("source_id % 4 = 0").select("source_id", (c("W1mag") - c("W2mag") > 0.5).alias("red_flag"))
    out = V.dossier(d.select("source_id"), {"curve": curves, "infrared": wise})
    out = out.withColumns({"dip_flag": c("curve.dip_flag"), "red_flag": c("infrared.red_flag"), "n_events": c("curve.n_events")})
    return V.rollup(out, ["dip_flag", "red_flag"]).select("source_id", "n_events", "anomaly_flagged", V.coverage(F.when(c("curve").isNull(), "fetch failed").otherwise("found")).alias("coverage"))


def field_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields are written apart, one is written again, and all are read back."""
    d, path = _stars(spark, sf_dir).select("source_id", "label", "teff"), shared_folder(spark)
    for field in ("A", "B"):
        sinks.write_field(d.filter(c("source_id") % 2 == int(field == "B")), path, field)
    sinks.write_field(d.filter("source_id % 2 = 1 AND teff > 6000"), path, "B")
    return spark.read.option("basePath", path).parquet(f"{path}/field=*").select("source_id", "label", c("field").cast("string").alias("field"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return twins.stream(spark, f"{sf_dir}/events.parque[t]", schema)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    q = twins.running_counts(_events(spark, sf_dir), "event_type", f"{path}/out", f"{path}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    twins.first_seen(_events(spark, sf_dir), "user_id", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    twins.candidates(_events(spark, sf_dir), lambda d: d.filter("value > 200").select("event_id", "user_id", "value"), f"{path}/out", f"{path}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out"))


def stream_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    history = lambda: spark.read.parquet(f"{sf_dir}/events.parquet")
    total = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    twins.touched_summaries(_events(spark, sf_dir), history, total, "user_id", f"{path}/out", f"{path}/state").awaitTermination()
    return rounded(twins.latest(spark, f"{path}/out", "user_id"))


QUERIES = {
    f.__name__: f
    for f in (
        parent_sample, aliased_columns, first_parents, photometry_by_ids, distance_shell, spectra_arrays, region_sources, field_tiles, object_classes, companion_reasons, trend_verdicts, band_verdicts, vet_verdicts, vet_run,
        variability_shortlist, target_dossiers, field_sink, stream_counts, stream_first_seen, stream_candidates, stream_touched,
    )
}

_A, _C = duck("catalogue"), duck("curves")
_BANDS = _seasons(_LONG, "source_id, band") + _fit("se", "source_id, band")
ORACLE_SQL = {
    "parent_sample": f"SELECT source_id, round(parallax / 0.2e0, 5) AS parallax_over_error FROM {_A} WHERE parallax >= 5 AND pwd >= 0.93e0",
    "aliased_columns": f"SELECT source_id AS id, round(ra, 5) AS lon FROM {_A}",
    "first_parents": f"SELECT source_id, label FROM {_A} WHERE parallax > 4 ORDER BY source_id LIMIT 50",
    "photometry_by_ids": f"SELECT source_id, round(W1mag, 5) AS W1mag, round(W2mag, 5) AS W2mag FROM {_A} WHERE source_id IN (SELECT cand_id * 7 FROM {duck('sky_b')})",
    "distance_shell": f"SELECT source_id FROM {duck('stars')} WHERE parallax BETWEEN 1000e0 / 30 AND 50 AND radial_velocity IS NOT NULL AND phot_g_mean_mag < 14",
    "spectra_arrays": f"SELECT spec_id AS source_id, any_value(label) AS label, CAST(count(*) AS INTEGER) AS n, round(sum(flux), 5) AS total, round(max(flux) FILTER (pix = 4), 5) AS fifth FROM {duck('spectra')} WHERE spec_id % 2 = 0 GROUP BY 1",
    "region_sources": f"""
SELECT source_id AS oid, count(*) AS n, round(quantile_cont(tiebreak % 17 / 10e0, 0.5), 5) AS ra, round(quantile_cont(tiebreak % 19 / 10e0, 0.5), 5) AS dec, (source_id % 4) || '_' || CASE WHEN source_id % 3 > 0 THEN CAST(source_id % 3 AS VARCHAR) ELSE 'x' END || '_1' AS channel
FROM {_C} WHERE tiebreak % 29 <> 0 GROUP BY source_id HAVING count(*) >= 60""",
    "field_tiles": f"""
WITH g AS (SELECT i AS tile, floor(i / 5e0) * 8e0 - 10e0 AS dec_lo, i % 5 AS x FROM range(25) r(i)), b AS (SELECT *, 8e0 / cos(radians(dec_lo + 4e0)) AS w FROM g)
SELECT source_id, min(tile) AS tile FROM {_A} a JOIN b ON ra BETWEEN x * w + 120e0 - w * 2.5e0 - 0.5e0 AND (x + 1) * w + 120e0 - w * 2.5e0 + 0.5e0 AND dec BETWEEN dec_lo - 0.5e0 AND dec_lo + 8.5e0 GROUP BY 1""",
    "object_classes": f"""
WITH k AS (SELECT *, upper(({list(KINDS)})[source_id % {len(KINDS)} + 1]) AS k, upper(coalesce(({[x or "" for x in SPECTRAL]})[source_id % {len(SPECTRAL)} + 1], '')) AS s0 FROM {_A}),
j AS (SELECT *, CASE WHEN s0 = 'NONE' THEN '' ELSE s0 END AS s FROM k)
SELECT source_id, CASE WHEN k = '' AND s = '' THEN 'unexamined' WHEN regexp_matches(k, 'CV|NOVA|AM CVN|AMCVN|NL') THEN 'interacting binary (CV)' WHEN regexp_matches(k, 'EB|ECL|ALGOL|BETA LYR|WUMA') THEN 'eclipsing binary'
  WHEN contains(s, '+M') OR contains(s, '+K') THEN 'WD+dwarf binary' WHEN regexp_matches(s, 'DAZ|DBZ|DZ') THEN 'metal-polluted WD (disk)' WHEN contains(k, '**') OR contains(k, 'SB') OR contains(k, 'BINARY') THEN 'binary'
  WHEN contains(k, 'WD') OR regexp_matches(s, '^D[ABCOQ]') THEN 'white dwarf (other)' WHEN k = '' THEN 'unexamined' ELSE lower(k) END AS object_class,
  CASE WHEN ruwe - 0.8e0 > 0.5e0 THEN 'quasar' WHEN pwd - 0.45e0 > 0.5e0 THEN 'galaxy' WHEN phot_g_mean_mag - 2 > 10 AND bp_rp < 1.5e0 THEN 'white_dwarf' WHEN phot_variable_flag = 'VARIABLE' THEN 'known_variable' WHEN ext_flg > 0 THEN 'non_single_star' ELSE 'clean' END AS shape_class FROM j""",
    "companion_reasons": f"""
WITH d AS (SELECT *, concat_ws(',', CASE WHEN ruwe > 1.4e0 THEN 'high_ruwe' END, CASE WHEN astrometric_excess_noise + 0.3e0 >= 1 AND parallax_over_error / 4 > 5 THEN 'excess_noise' END, CASE WHEN source_id % 14 > 10 THEN 'multi_peak' END, CASE WHEN ext_flg > 0 THEN 'non_single' END) AS reasons,
  coalesce(e_W2mag * e_W2mag, 0e0) AS q2, e_W1mag * e_W1mag AS q1, W1mag - W2mag AS d2 FROM {_A})
SELECT source_id, reasons, concat_ws(',', CASE WHEN d2 > 0.35e0 AND d2 / sqrt(q1 + q2 + 1e-6) > 3 THEN 'w1_w2' END, CASE WHEN d2 + 0.4e0 > 0.6e0 AND (d2 + 0.4e0) / sqrt(q1 + 16 * q2 + 1e-6) > 3 THEN 'w1_w3' END, CASE WHEN d2 + 0.7e0 > 0.9e0 AND (d2 + 0.7e0) / sqrt(2 * q1 + 1e-6) > 3 THEN 'w1_w4' END) AS red, reasons <> '' AS companion_flag FROM d""",
    "trend_verdicts": _BANDS
    + """,
p AS (SELECT source_id, 10 * max(slope) FILTER (band = 'g') AS o, max(slope) FILTER (band = 'r') AS r, max(slope_sigma) FILTER (band = 'r') AS z FROM ft GROUP BY 1),
b AS (SELECT source_id, r AS s, 4 * z AS z FROM p WHERE source_id % 4 > 0 AND r IS NOT NULL UNION ALL SELECT source_id, -r / 3, 5 * z FROM p WHERE source_id % 3 > 0 AND r IS NOT NULL),
q AS (SELECT p.source_id, count(b.s) AS n, bool_or(b.s < 0 AND b.z >= 2) AS dusty, bool_or(b.s > 0 AND b.z >= 2 AND b.s / o >= 0.3e0) AS gray, bool_or(b.s > 0 AND b.z >= 2 AND b.s / o BETWEEN 0.02e0 AND 0.15e0) AS law FROM p LEFT JOIN b USING (source_id) GROUP BY 1)
SELECT source_id, CASE WHEN o IS NULL OR o <= 0 OR n = 0 THEN 'insufficient_ir' WHEN dusty THEN 'ir_brightens_dusty' WHEN gray THEN 'ir_fades_gray_occulter' WHEN law THEN 'ir_fades_reddening_law' ELSE 'ir_flat_chromatic_fade' END AS counterpart,
  CASE WHEN 4 * z >= 5 AND abs(10 * r) >= 0.02e0 THEN printf('%s at %.3f mag/yr', CASE WHEN r < 0 THEN 'brightening' ELSE 'fading' END, abs(10 * r)) ELSE 'steady' END AS trend FROM p JOIN q USING (source_id)""",
    "band_verdicts": _BANDS
    + """,
q AS (SELECT source_id, band, 'fade' AS kind FROM ft WHERE slope > 0.005e0 UNION ALL SELECT source_id, band, 'rise' FROM ft WHERE slope < -0.005e0)
SELECT source_id, kind, count(*) AS n_bands, string_agg(band, ',' ORDER BY band) AS bands, CASE WHEN count(*) >= 2 THEN 'confirmed' ELSE 'needs_vetting' END AS verdict FROM q GROUP BY 1, 2""",
    "vet_verdicts": f"""
WITH d AS (SELECT *, CASE WHEN source_id % 10 <> 3 THEN W2mag END AS w2 FROM {_A}),
f AS (SELECT *, CASE WHEN coalesce(W1mag - w2 > 0.15e0, false) OR coalesce(Ksmag - 0.2e0 - w2 > 0.6e0, false) THEN 'ir_excess_dusty' WHEN source_id % 6 = 0 THEN 'known_variable' WHEN w2 IS NULL THEN 'no_ir_data' ELSE 'clean' END AS ir FROM d)
SELECT source_id, CASE WHEN ir <> 'clean' THEN ir
  WHEN source_id % 3 = 1 THEN CASE WHEN source_id % 8 = 0 OR abs(source_id % 9 - 4) / 20e0 < 0.08e0 THEN 'marginal_fade' WHEN bp_rp > 0.9e0 THEN 'active_dwarf_fade' WHEN source_id % 5 > 2 THEN 'clean_secular_fade' ELSE 'single_band_fade' END
  WHEN source_id % 3 = 2 THEN CASE WHEN source_id % 7 > 3 THEN 'clean_glint' ELSE 'chromatic_flare' END
  WHEN source_id % 4 < 2 OR source_id % 11 = 0 THEN 'single_band_unconfirmed' WHEN source_id % 11 >= 5 THEN 'clean_achromatic' ELSE 'single_band_artifact' END AS verdict FROM f""",
    "variability_shortlist": AXES + "SELECT source_id, n_axes FROM i3 WHERE n_axes >= 1 OR has_excess ORDER BY n_axes DESC, chi_W2 DESC NULLS LAST, source_id LIMIT 60",
    "field_sink": f"SELECT source_id, label, CASE WHEN source_id % 2 = 0 THEN 'A' ELSE 'B' END AS field FROM {_A} WHERE source_id % 2 = 0 OR teff > 6000",
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "stream_candidates": "SELECT event_id, user_id, round(value, 5) AS value FROM events WHERE value > 200",
    "stream_touched": "SELECT user_id, count(*) AS n, round(max(value), 5) AS top FROM events GROUP BY 1",
}
ORACLE_SQL["target_dossiers"] = (
    DIPS
    + _runs("5")
    + f""", s AS (SELECT DISTINCT source_id FROM fl), v AS (SELECT source_id, count(*) AS n, max(depth) AS d FROM ev WHERE n_epochs >= 2 GROUP BY 1), u AS (SELECT s.source_id, coalesce(n, 0) AS n, coalesce(d, 0e0) >= 0.3e0 AS df FROM s LEFT JOIN v USING (source_id))
SELECT a.source_id, u.n AS n_events, coalesce(df, false) OR (a.source_id % 4 = 0 AND W1mag - W2mag > 0.5e0) AS anomaly_flagged, CASE WHEN u.source_id IS NULL THEN 'no_data' ELSE 'ok' END AS coverage FROM {_A} a LEFT JOIN u USING (source_id)"""
)
_SHOWN = f"(SELECT * REPLACE (mag - CASE WHEN source_id % 2 = 0 AND mjd = min(mjd) OVER (PARTITION BY source_id) THEN 2e0 ELSE 0e0 END AS mag) FROM {_LONG})"
_TYPE = "CASE WHEN least(source_id % 3, source_id % 5 % 3) = 0 THEN 'dipper' WHEN least(source_id % 3, source_id % 5 % 3) = 1 THEN 'secular_fader' ELSE 'glint' END"
ORACLE_SQL["vet_run"] = f"""
WITH ca AS (SELECT source_id, total_change AS total, bp_rp / 2 AS bp_rp, {_TYPE} AS cand_type FROM ({_seasons(_LONG, "source_id")} {_fit("se", "source_id")} SELECT * FROM ft) JOIN (SELECT source_id, bp_rp FROM {_A}) USING (source_id)),
ph AS (SELECT source_id, W1mag, W2mag + CASE WHEN source_id % 4 = 0 THEN 0e0 ELSE 1e0 END AS w2, Ksmag FROM {_A} WHERE source_id % 17 > 0),
ir AS (SELECT ca.*, CASE WHEN coalesce(W1mag - w2 > 0.15e0, false) OR coalesce(Ksmag - w2 > 0.6e0, false) THEN 'ir_excess_dusty' WHEN ph.source_id IS NOT NULL AND source_id % 6 = 0 THEN 'known_variable' WHEN w2 IS NULL THEN 'no_ir_data' ELSE 'clean' END AS ir FROM ca LEFT JOIN ph USING (source_id)),
cu AS (SELECT s.*, cand_type, count(*) OVER (PARTITION BY source_id, band) AS n FROM {_SHOWN} s JOIN ir USING (source_id) WHERE ir IN ('clean', 'no_ir_data')),
db AS (SELECT source_id, band, quantile_cont(mag, 0.2) AS base FROM cu WHERE cand_type = 'dipper' AND n >= 20 GROUP BY 1, 2),
dp AS (SELECT source_id, band, mjd, tiebreak FROM cu JOIN db USING (source_id, band) WHERE 1e0 - pow(10e0, -0.4e0 * (mag - base)) >= 0.1e0 AND (mag - base) / (0.4e0 * ln(10e0) * magerr + 1e-9) >= 3),
nb AS (SELECT source_id, CAST(count(*) AS INTEGER) AS n_bands FROM db GROUP BY 1),
dn AS (SELECT source_id, band, count(*) AS k FROM dp GROUP BY 1, 2), rf AS (SELECT source_id, arg_min(band, struct_pack(a := -k, b := band)) AS ref, max(k) AS k FROM dn GROUP BY 1),
fc AS (SELECT rf.source_id, count(DISTINCT d.tiebreak) FILTER (o.mjd IS NOT NULL) / any_value(rf.k) AS frac FROM rf JOIN dp d ON d.source_id = rf.source_id AND d.band = ref LEFT JOIN dp o ON o.source_id = rf.source_id AND o.band <> ref AND abs(o.mjd - d.mjd) <= 2 GROUP BY 1),
fb AS (SELECT source_id, band, slope, slope_sigma FROM ({_seasons("cu0", "source_id, band").replace("WITH ", "WITH cu0 AS (SELECT * EXCLUDE (cand_type, n) FROM cu WHERE cand_type = 'secular_fader'), ", 1)} {_fit("se", "source_id, band")} SELECT * FROM ft)),
fs AS (SELECT g.source_id, g.slope > 0 AND r.slope > 0 AND g.slope_sigma > 2 AND r.slope_sigma > 2 AND greatest(g.slope, r.slope) / greatest(least(g.slope, r.slope), 1e-4) < 3 AS sec FROM fb g JOIN fb r ON g.source_id = r.source_id AND g.band = 'g' AND r.band = 'r'),
gb AS (SELECT source_id, band, arg_min(mjd, struct_pack(a := mag, b := mjd)) AS at_, pow(10e0, 0.4e0 * (quantile_cont(mag, 0.5) - min(mag))) - 1e0 AS amp FROM cu WHERE cand_type = 'glint' AND n >= 20 GROUP BY 1, 2),
gs AS (SELECT g.source_id, abs(g.at_ - r.at_) <= 1 AND g.amp >= 0.25e0 AND r.amp >= 0.25e0 AND greatest(g.amp, r.amp) / greatest(least(g.amp, r.amp), 1e-4) < 2 AS gl FROM gb g JOIN gb r ON g.source_id = r.source_id AND g.band = 'g' AND r.band = 'r')
SELECT source_id, cand_type, ir AS ir_verdict, round(frac, 4) AS frac_confirmed, coalesce(n_bands, 0) AS n_bands, coalesce(sec, false) AS secular_confirmed, coalesce(gl, false) AS glint_confirmed,
  CASE WHEN ir <> 'clean' THEN ir WHEN cand_type = 'secular_fader' THEN CASE WHEN abs(total) < 0.08e0 THEN 'marginal_fade' WHEN bp_rp > 0.9e0 THEN 'active_dwarf_fade' WHEN sec THEN 'clean_secular_fade' ELSE 'single_band_fade' END
  WHEN cand_type = 'glint' THEN CASE WHEN gl THEN 'clean_glint' ELSE 'chromatic_flare' END WHEN coalesce(n_bands, 0) < 2 OR frac IS NULL THEN 'single_band_unconfirmed' WHEN frac >= 0.5e0 THEN 'clean_achromatic' ELSE 'single_band_artifact' END AS verdict
FROM ir LEFT JOIN nb USING (source_id) LEFT JOIN fc USING (source_id) LEFT JOIN fs USING (source_id) LEFT JOIN gs USING (source_id)"""
