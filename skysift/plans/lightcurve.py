"""Registered queries over light curves, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.exprs import LN10_04
from skysift.operators import catalog, indicators
from skysift.operators import lightcurve as L
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import AXES, rounded

K = ["source_id"]
KB = ["source_id", "band"]


def _dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flag_dips(L.clean(bound(spark, sf_dir, "curves"), K), K)


def dip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.events(_dips(spark, sf_dir), K))


def dip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.dip_candidates(L.dip_summary(bound(spark, sf_dir, "curves"), K)), 6)


def dip_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.dip_periods(bound(spark, sf_dir, "curves"), K), 4)


def variability_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.periods(bound(spark, sf_dir, "curves"), K), 4)


def flash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.flash_summary(bound(spark, sf_dir, "long_curves"), K), 6)


def season_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.seasons(bound(spark, sf_dir, "long_curves"), K), 4)


def fade_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.fades(bound(spark, sf_dir, "long_curves"), K), 4)


def fade_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = bound(spark, sf_dir, "long_curves")
    sources = curves.groupBy("source_id").agg(L.median(F.col("mag")).alias("median_mag"), F.min_by("channel", F.struct("mjd", "tiebreak")).alias("channel"))
    fixed = L.common_mode(L.seasons(curves, K), sources, K, "channel")
    return rounded(L.fade_fit(fixed.drop("channel"), K).select("source_id", "slope", "slope_sigma", "total_change", "is_fader"), 4)


def shared_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.shared_epochs(_dips(spark, sf_dir), K))


def fractional_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.fractional_rms(bound(spark, sf_dir, "curves"), KB, 8))


def band_coincidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.band_coincidence(_dips(spark, sf_dir)))


def fade_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.fade_colours(L.fades(bound(spark, sf_dir, "long_curves"), KB)), 4)


def flash_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.flash_colours(bound(spark, sf_dir, "long_curves")))


def relative_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flux = bound(spark, sf_dir, "curves").withColumn("flux", F.when(F.col("tiebreak") % 10 == 0, -1.0).otherwise(F.col("mag") - 11.0))
    return rounded(L.relative_magnitude(flux.drop("mag"), K).select("source_id", "tiebreak", "mag"))


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over one field, with the control of shared nights."""
    curves = bound(spark, sf_dir, "curves")
    found = L.field_candidates(L.search(curves, K), L.shared_epochs(_dips(spark, sf_dir), K), K)
    c = F.col
    return rounded(found.select("source_id", c("dips.n_dips").alias("n_dips"), c("dips.is_candidate").alias("dip_candidate"), c("fade.is_fader").alias("is_fader"), c("flash.n_flashes").alias("n_flashes"), "shared_frac", "is_candidate"))


def shortlist_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter and period of the objects that an axis flags or that have an excess, as far as they have light curves."""
    scored = indicators.combine(indicators.evaluate(catalog.dust(catalog.analyze(bound(spark, sf_dir, "catalogue")))))
    chosen = scored.filter("n_axes >= 1 OR has_excess").select("source_id")
    return rounded(L.variability_table(bound(spark, sf_dir, "curves"), chosen), 4)


QUERIES = {f.__name__: f for f in (field_search, dip_events, dip_summary, dip_periods, variability_periods, shortlist_variability, flash_summary, season_medians, fade_fits, fade_detrended, shared_epochs, fractional_rms, band_coincidence, fade_colours, flash_colours, relative_magnitudes)}

_CURVES, _LONG = duck("curves"), duck("long_curves")


def _flag(curves: str, hit: str, base: str, depth: str, sig: str) -> str:
    return f"""
WITH e0 AS (SELECT * FROM {curves}),
e1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS nn FROM e0) WHERE nn >= 30),
st AS (SELECT source_id AS sid, quantile_cont(mag, {base}) AS base, quantile_cont(mag, 0.5) AS med FROM e1 GROUP BY 1),
e2 AS (SELECT *, {depth} AS depth, {sig} / ({LN10_04!r} * magerr + 1e-9) AS sig FROM e1 JOIN st ON sid = source_id),
fl AS (SELECT *, {hit} AS hit, row_number() OVER (PARTITION BY source_id ORDER BY mjd, tiebreak) AS rn FROM e2)"""


DIPS = _flag(_CURVES, "depth >= 0.05e0 AND sig >= 3", "0.2", "1e0 - pow(10e0, -0.4e0 * (mag - base))", "(mag - base)")


def _runs(gap: str) -> str:
    return f""",
r0 AS (SELECT *, CASE WHEN rn = lag(rn) OVER w + 1 AND mjd - lag(mjd) OVER w <= {gap} THEN 0 ELSE 1 END AS new_ FROM fl WHERE hit WINDOW w AS (PARTITION BY source_id ORDER BY mjd, tiebreak)),
r1 AS (SELECT *, sum(new_) OVER (PARTITION BY source_id ORDER BY mjd, tiebreak ROWS UNBOUNDED PRECEDING) AS event FROM r0),
ev AS (SELECT source_id, CAST(event AS BIGINT) AS event, min(mjd) AS first_mjd, max(mjd) AS last_mjd, count(*) AS n_epochs, max(depth) AS depth FROM r1 GROUP BY source_id, event)"""


_QUIET = """,
q0 AS (SELECT source_id AS qid, quantile_cont(mag, 0.5) AS qm FROM fl WHERE NOT hit GROUP BY 1),
q1 AS (SELECT qid, count(*) AS qn, quantile_cont(abs(mag - qm), 0.5) AS qmad, stddev_pop(mag) AS qstd, quantile_cont(magerr, 0.5) AS qerr FROM fl JOIN q0 ON qid = source_id WHERE NOT hit GROUP BY 1)"""


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1e0)"


def _seasons(curves: str, keys: str) -> str:
    return f"""
WITH e0 AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS nn, min(mjd) OVER (PARTITION BY {keys}) AS t0 FROM {curves}),
e1 AS (SELECT *, CAST(floor((mjd - t0) / 180e0) AS BIGINT) AS season FROM e0 WHERE nn >= 40),
m0 AS (SELECT {keys}, season, count(*) AS n, quantile_cont(mjd, 0.5) AS t, quantile_cont(mag, 0.5) AS m, stddev_pop(mag) AS std FROM e1 GROUP BY {keys}, season HAVING count(*) >= 3),
m1 AS (SELECT {keys}, season, n, t, m, std, 1.4826e0 * quantile_cont(abs(mag - m), 0.5) AS mad FROM m0 JOIN e1 USING ({keys}, season) GROUP BY ALL),
m2 AS (SELECT {keys}, season, n, t, m, 1e0 / pow(greatest(coalesce(CASE WHEN mad > 0 THEN mad WHEN std > 0 THEN std END / sqrt(n), 0.01e0), 1e-3), 2) AS weight, count(*) OVER (PARTITION BY {keys}) AS k FROM m1),
se AS (SELECT * FROM m2 WHERE k >= 3)"""


def _fit(source: str, keys: str) -> str:
    return f""",
f0 AS (SELECT *, (t - min(t) OVER (PARTITION BY {keys})) / 365.25e0 AS x, sign(m - lag(m) OVER (PARTITION BY {keys} ORDER BY season)) AS step FROM {source}),
f1 AS (SELECT {keys}, sum(weight) AS sw, sum(weight * x) AS sx, sum(weight * m) AS sy, sum(weight * x * x) AS sxx, sum(weight * x * m) AS sxy FROM f0 GROUP BY {keys}),
f2 AS (SELECT *, sw * sxx - sx * sx AS d, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM f1 WHERE sw * sxx - sx * sx > 0),
f3 AS (SELECT {keys}, slope, count(*) AS n_seasons, max(x) - min(x) AS baseline_yr, any_value(sw / d) AS var, sum(weight * pow(m - (sy - slope * sx) / sw - slope * x, 2)) AS chi2, sqrt(avg(pow(m - (sy - slope * sx) / sw - slope * x, 2))) AS rms_resid,
  avg(CASE WHEN step IS NOT NULL THEN CASE WHEN step = CASE WHEN slope = 0 THEN 1 ELSE sign(slope) END THEN 1e0 ELSE 0e0 END END) AS monotonic FROM f0 JOIN f2 USING ({keys}) GROUP BY {keys}, slope),
f4 AS (SELECT *, abs(slope) / sqrt(var * greatest(chi2 / greatest(n_seasons - 2, 1), 1e0)) AS slope_sigma, slope * baseline_yr AS total_change FROM f3),
ft AS (SELECT *, CASE WHEN slope > 0 THEN {_clip("(slope_sigma - 3) / 5e0")} * 0.4e0 + {_clip("abs(total_change) / 0.2e0")} * 0.35e0 + {_clip("(monotonic - 0.5e0) / 0.4e0")} * 0.25e0 ELSE 0e0 END AS score FROM f4)"""


_FT = "round(slope, 4) + 0e0 AS slope, round(slope_sigma, 4) + 0e0 AS slope_sigma, round(total_change, 4) + 0e0 AS total_change"
_FADER = "score >= 0.5e0 AND slope_sigma >= 4 AND abs(total_change) >= 0.08e0 AS is_fader"
ORACLE_SQL = {
    "dip_events": DIPS + _runs("5") + "SELECT source_id, event, round(first_mjd, 5) AS first_mjd, round(last_mjd, 5) AS last_mjd, n_epochs, round(depth, 5) AS depth FROM ev",
    "dip_summary": DIPS
    + _runs("5")
    + _QUIET
    + f""",
s0 AS (SELECT source_id, count(*) AS n_epochs, max(depth) AS max_depth, count(*) FILTER (hit) AS n_dips, (sum(greatest(mag - med, 0)) + 1e-9) / (sum(greatest(med - mag, 0)) + 1e-9) AS asymmetry FROM fl GROUP BY 1),
s1 AS (SELECT source_id AS vid, count(*) AS ne, max(depth) AS ed FROM ev WHERE n_epochs >= 2 GROUP BY 1),
s2 AS (SELECT *, coalesce(ne, 0) AS n_events, coalesce(ed, 0e0) AS event_depth, 0e0 AS period_power,
  coalesce(CASE WHEN qn >= 5 THEN {LN10_04!r} * sqrt(greatest(pow(CASE WHEN qmad > 0 THEN 1.4826e0 * qmad ELSE qstd END, 2) - qerr * qerr, 0e0)) ELSE 0e0 END, 0e0) AS out_rms FROM s0 LEFT JOIN s1 ON vid = source_id LEFT JOIN q1 ON qid = source_id)
SELECT source_id, n_epochs, round(max_depth, 6) AS max_depth, n_dips, round(asymmetry, 6) AS asymmetry, n_events, round(event_depth, 6) AS event_depth, round(out_rms, 6) AS out_rms, period_power, round(n_dips / n_epochs, 6) AS duty,
  round({_clip("(event_depth - 0.05e0) / 0.15e0")} * 0.34e0 + {_clip("n_events / 6e0")} * {_clip("(40 - n_events) / 28e0")} * 0.18e0 + {_clip("(asymmetry - 1) / 3e0")} * 0.18e0 + 0.15e0 + {_clip("1 - out_rms / 0.05e0")} * 0.15e0, 6) AS score,
  event_depth >= 0.1e0 AND n_events BETWEEN 1 AND 20 AND n_dips >= 3 AND out_rms <= 0.05e0 AND asymmetry >= 1.5e0 AS is_candidate FROM s2""",
    "dip_periods": DIPS
    + """,
y AS (SELECT source_id, mjd, greatest(depth, 0e0) AS y FROM fl),
a0 AS (SELECT source_id, count(*) AS n, min(mjd) AS t0, max(mjd) - min(mjd) AS span, avg(y) AS my, max(y) AS top FROM y GROUP BY 1),
gr AS (SELECT *, 1e0 / least(span / 2, 200e0) AS f0, 1e0 / span / 5e0 AS df FROM a0 WHERE span >= 4 AND top > 0),
fr AS (SELECT source_id, n, t0, my, f0 + df * i AS f FROM (SELECT *, unnest(range(1 + CAST(round_even((10e0 - f0) / df, 0) AS BIGINT))) AS i FROM gr)),
tm AS (SELECT fr.source_id, f, n, cos(2e0 * pi() * f * (mjd - t0)) AS co, sin(2e0 * pi() * f * (mjd - t0)) AS si, y - my AS y FROM fr JOIN y USING (source_id)),
su AS (SELECT source_id, f, avg(co) AS mc, avg(si) AS ms, avg(co * y) AS yc, avg(si * y) AS ys, avg(co * co) AS c2, avg(si * si) AS s2, avg(co * si) AS cs2, avg(y * y) AS yy FROM tm GROUP BY 1, 2),
dd AS (SELECT *, c2 - mc * mc AS cc, s2 - ms * ms AS ss, cs2 - mc * ms AS cs FROM su),
pw AS (SELECT source_id, f, CASE WHEN cc * ss - cs * cs > 1e-12 THEN (yc * (yc * ss - ys * cs) + ys * (ys * cc - yc * cs)) / (cc * ss - cs * cs) / yy ELSE 0e0 END AS power FROM dd),
bp AS (SELECT source_id, 1e0 / arg_max(f, power) AS best, max(power) AS power FROM pw GROUP BY 1)
SELECT a0.source_id, round(best, 4) AS best_period, round(coalesce(power, 0e0), 4) AS period_power FROM a0 LEFT JOIN bp USING (source_id)""",
    "flash_summary": _flag(_LONG, "depth >= 0.3e0 AND sig >= 5", "0.5", "pow(10e0, 0.4e0 * greatest(base - mag, 0e0)) - 1e0", "(base - mag)")
    + _runs("2")
    + _QUIET
    + f""",
s0 AS (SELECT source_id, count(*) AS n_epochs, max(depth) AS max_brighten, max(sig) AS brighten_sigma, count(*) FILTER (hit) AS n_flash_epochs FROM fl GROUP BY 1),
s1 AS (SELECT source_id AS vid, count(*) AS ne FROM ev GROUP BY 1),
s2 AS (SELECT *, coalesce(ne, 0) AS n_flashes, coalesce(CASE WHEN qn >= 5 THEN {LN10_04!r} * CASE WHEN qmad > 0 THEN 1.4826e0 * qmad ELSE qstd END ELSE 0e0 END, 0e0) AS out_rms FROM s0 LEFT JOIN s1 ON vid = source_id LEFT JOIN q1 ON qid = source_id)
SELECT source_id, n_epochs, round(max_brighten, 6) AS max_brighten, round(brighten_sigma, 6) AS brighten_sigma, n_flash_epochs, n_flashes, round(out_rms, 6) AS out_rms,
  CASE WHEN n_flashes BETWEEN 1 AND 4 THEN round({_clip("(max_brighten - 0.3e0) / 0.7e0")} * 0.4e0 + {_clip("n_flashes * 1e0")} * {_clip("(6 - n_flashes) / 5e0")} * 0.2e0 + {_clip("(brighten_sigma - 5) / 15e0")} * 0.2e0 + {_clip("1 - out_rms / 0.06e0")} * 0.2e0, 6) ELSE 0e0 END AS score FROM s2""",
    "season_medians": _seasons(_LONG, "source_id") + "SELECT source_id, season, n, round(t, 4) AS t, round(m, 4) AS m, round(weight, 4) AS weight FROM se",
    "fade_fits": _seasons(_LONG, "source_id") + _fit("se", "source_id") + f"SELECT source_id, {_FT}, n_seasons, round(baseline_yr, 4) AS baseline_yr, round(rms_resid, 4) AS rms_resid, round(coalesce(monotonic, 0e0), 4) AS monotonic, round(score, 4) + 0e0 AS score, {_FADER} FROM ft",
    "fade_detrended": _seasons(_LONG, "source_id")
    + f""",
so AS (SELECT source_id, quantile_cont(mag, 0.5) AS median_mag, arg_min(channel, struct_pack(a := mjd, b := tiebreak)) AS channel FROM {_LONG} GROUP BY 1),
o0 AS (SELECT se.*, channel, m - median_mag AS o FROM se JOIN so USING (source_id)),
oc AS (SELECT channel, season, quantile_cont(o, 0.5) AS own FROM o0 GROUP BY 1, 2 HAVING count(*) >= 5),
oa AS (SELECT season, quantile_cont(o, 0.5) AS al FROM o0 GROUP BY 1 HAVING count(*) >= 5),
sd AS (SELECT source_id, season, t, m - coalesce(own, al, 0e0) AS m, weight FROM o0 LEFT JOIN oc USING (channel, season) LEFT JOIN oa USING (season))"""
    + _fit("sd", "source_id")
    + f"SELECT source_id, {_FT}, {_FADER} FROM ft",
    "shared_epochs": DIPS
    + """,
b AS (SELECT DISTINCT source_id, CAST(round_even(mjd / 0.5e0, 0) AS BIGINT) AS bin FROM fl WHERE depth >= 0.1e0),
l AS (SELECT greatest(5, ceil(count(DISTINCT source_id) * 0.02e0)) AS lim FROM b),
h AS (SELECT bin, count(*) >= any_value(lim) AS bad FROM b, l GROUP BY bin)
SELECT source_id, count(*) AS n_bins, round(avg(CAST(bad AS INTEGER)), 5) AS shared_frac FROM b JOIN h USING (bin) GROUP BY 1""",
    "fractional_rms": f"""
WITH e0 AS (SELECT * FROM {_CURVES}),
m AS (SELECT source_id, band, count(*) AS n, quantile_cont(mag, 0.5) AS med, stddev_pop(mag) AS std FROM e0 GROUP BY 1, 2),
d AS (SELECT source_id, band, 1.4826e0 * quantile_cont(abs(mag - med), 0.5) AS mad FROM e0 JOIN m USING (source_id, band) GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN mad > 0 THEN mad ELSE std END AS sigma FROM e0 JOIN m USING (source_id, band) JOIN d USING (source_id, band)),
s AS (SELECT source_id, band, count(*) FILTER (ok) AS n_kept, stddev_samp(mag) FILTER (ok) AS s, quantile_cont(magerr, 0.5) FILTER (ok) AS e FROM (SELECT *, n >= 8 AND (sigma = 0 OR abs(mag - med) <= 4e0 * sigma) AS ok FROM k) GROUP BY 1, 2)
SELECT source_id, band, n_kept, CASE WHEN n_kept >= 8 THEN round({LN10_04!r} * sqrt(greatest(s * s - e * e, 0e0)), 5) END AS frac_rms FROM s""",
    "band_coincidence": DIPS
    + """,
d AS (SELECT source_id, band, mjd, tiebreak FROM fl WHERE hit),
n AS (SELECT source_id, band, count(*) AS n FROM d GROUP BY 1, 2),
r AS (SELECT source_id, arg_max(band, struct_pack(a := n, b := band)) AS ref_band, max(n) AS n_ref FROM n GROUP BY 1),
x AS (SELECT DISTINCT d.source_id, d.tiebreak FROM d JOIN r ON r.source_id = d.source_id AND d.band = ref_band JOIN d o ON o.source_id = d.source_id AND o.band <> ref_band AND abs(o.mjd - d.mjd) <= 2)
SELECT r.source_id, ref_band, n_ref, round(count(x.tiebreak) / any_value(n_ref), 5) AS coincident FROM r LEFT JOIN x USING (source_id) GROUP BY r.source_id, ref_band, n_ref""",
    "fade_colours": _seasons(_LONG, "source_id, band")
    + _fit("se", "source_id, band")
    + """,
p AS (SELECT source_id, max(slope) FILTER (band = 'g') AS gs, max(slope) FILTER (band = 'r') AS rs, max(slope_sigma) FILTER (band = 'g') AS gg, max(slope_sigma) FILTER (band = 'r') AS rr FROM ft GROUP BY 1)
SELECT source_id, round(gs, 4) + 0e0 AS g_slope, round(rs, 4) + 0e0 AS r_slope, CASE WHEN gs IS NOT NULL AND rs IS NOT NULL THEN gs > 0 AND rs > 0 AND gg > 2 AND rr > 2 AND greatest(gs, rs) / least(gs, rs) < 3 END AS achromatic FROM p""",
    "flash_colours": f"""
WITH o AS (SELECT source_id, band, min(mag) AS mn, quantile_cont(mag, 0.5) AS med, arg_min(mjd, struct_pack(a := mag, b := mjd)) AS at_ FROM {_LONG} GROUP BY 1, 2),
a AS (SELECT *, pow(10e0, 0.4e0 * (med - mn)) - 1e0 AS amp FROM o),
p AS (SELECT source_id, max(at_) FILTER (band = 'g') AS ga, max(at_) FILTER (band = 'r') AS ra, max(amp) FILTER (band = 'g') AS gm, max(amp) FILTER (band = 'r') AS rm FROM a GROUP BY 1)
SELECT source_id, round(gm, 5) + 0e0 AS g_amp, round(rm, 5) + 0e0 AS r_amp, coalesce(abs(ga - ra) <= 1 AND gm >= 0.25e0 AND rm >= 0.25e0 AND greatest(gm, rm) / least(gm, rm) < 2, false) AS achromatic FROM p""",
    "relative_magnitudes": f"""
WITH f AS (SELECT source_id, tiebreak, mag - 11e0 AS flux FROM {_CURVES} WHERE tiebreak % 10 <> 0 AND mag > 11), m AS (SELECT source_id, quantile_cont(flux, 0.5) AS med FROM f GROUP BY 1)
SELECT source_id, tiebreak, round(-2.5e0 * log10(flux / med), 5) + 0e0 AS mag FROM f JOIN m USING (source_id)""",
}
_PERIODS = f"""
WITH e0 AS (SELECT source_id, mjd, mag AS y, 1e0 / (magerr * magerr) AS w FROM {_CURVES}),
a0 AS (SELECT source_id, count(*) AS n, min(mjd) AS t0, max(mjd) - min(mjd) AS span, sum(w) AS sw, sum(w * y) / sum(w) AS my, stddev_pop(y) AS sd FROM e0 GROUP BY 1),
vt AS (SELECT source_id, sum(w * pow(mjd - t0, 2)) / any_value(sw) - pow(sum(w * (mjd - t0)) / any_value(sw), 2) AS spread, sum(w * pow(y - my, 2)) / any_value(sw) AS yy FROM e0 JOIN a0 USING (source_id) GROUP BY 1),
gr AS (SELECT *, 1e0 / least(span / 2, 100e0) AS f0, 1e0 / span / 5e0 AS df FROM a0 WHERE span >= 0.2e0 AND n >= 20 AND sd > 0),
fr AS (SELECT source_id, n, t0, my, sw, i, f0 + df * i AS f FROM (SELECT *, unnest(range(1 + CAST(round_even((10e0 - f0) / df, 0) AS BIGINT))) AS i FROM gr)),
su AS (SELECT source_id, f, sum(w * cos(2e0 * pi() * f * (mjd - t0))) / any_value(sw) AS mc, sum(w * sin(2e0 * pi() * f * (mjd - t0))) / any_value(sw) AS ms, sum(w * (y - my) * cos(2e0 * pi() * f * (mjd - t0))) / any_value(sw) AS yc, sum(w * (y - my) * sin(2e0 * pi() * f * (mjd - t0))) / any_value(sw) AS ys,
  sum(w * pow(cos(2e0 * pi() * f * (mjd - t0)), 2)) / any_value(sw) AS c2, sum(w * cos(2e0 * pi() * f * (mjd - t0)) * sin(2e0 * pi() * f * (mjd - t0))) / any_value(sw) AS cs2 FROM fr JOIN e0 USING (source_id) GROUP BY 1, 2),
dd AS (SELECT *, c2 - mc * mc AS cc, 1e0 - c2 - ms * ms AS ss, cs2 - mc * ms AS cs FROM su),
pw AS (SELECT source_id, f, least(abs(f - greatest(1, round_even(f, 0))), abs(f - greatest(1, round_even(f / 1.0027379e0, 0)) * 1.0027379e0)) < 0.02e0 AS day, cc * ss - cs * cs AS d,
  CASE WHEN cc * ss - cs * cs > 1e-12 THEN (yc * (yc * ss - ys * cs) + ys * (ys * cc - yc * cs)) / (cc * ss - cs * cs) / yy ELSE 0e0 END AS power, sqrt(pow(yc * ss - ys * cs, 2) + pow(ys * cc - yc * cs, 2)) AS ab FROM dd JOIN vt USING (source_id)),
pk AS (SELECT source_id, arg_max(struct_pack(f := f, power := power, amp := CASE WHEN d > 1e-12 THEN ab / d ELSE 0e0 END), CASE WHEN day THEN -1e0 ELSE power END) AS b, arg_max(day, power) AS alias, max(f) AS fmax FROM pw GROUP BY 1),
fa AS (SELECT source_id, b, alias, n - 1 AS nh, n - 3 AS nk, fmax * sqrt(4e0 * pi() * spread) AS width FROM pk JOIN a0 USING (source_id) JOIN vt USING (source_id)),
ls AS (SELECT a0.source_id, 1e0 / b.f AS period, b.power AS power, CASE WHEN b.power >= 1 THEN 0e0 ELSE 1e0 - (1e0 - pow(1e0 - b.power, 0.5e0 * nk)) * exp(-sqrt(2e0 / nh) * exp(lgamma(nh / 2e0) - lgamma((nh - 1) / 2e0)) * width * pow(1e0 - b.power, 0.5e0 * (nk - 1)) * sqrt(0.5e0 * nh * b.power)) END AS fap, b.amp AS amplitude, coalesce(alias, false) AS alias FROM a0 LEFT JOIN fa USING (source_id))"""
_LS = "round(period, 4) AS period, round(power, 4) AS power, round(fap, 4) + 0e0 AS fap, round(amplitude, 4) AS amplitude, alias"
ORACLE_SQL["variability_periods"] = _PERIODS + f" SELECT source_id, {_LS} FROM ls"
ORACLE_SQL["shortlist_variability"] = (
    AXES
    + _PERIODS.replace("\nWITH e0 AS", ", e0 AS", 1)
    + f""",
rm AS (SELECT source_id, count(*) AS n, quantile_cont(y, 0.5) AS med, stddev_pop(y) AS std FROM e0 GROUP BY 1),
rd AS (SELECT source_id, 1.4826e0 * quantile_cont(abs(y - med), 0.5) AS mad FROM e0 JOIN rm USING (source_id) GROUP BY 1),
rk AS (SELECT *, n >= 8 AND abs(y - med) <= 4e0 * CASE WHEN mad > 0 THEN mad ELSE std END AS ok FROM e0 JOIN rm USING (source_id) JOIN rd USING (source_id)),
rs AS (SELECT source_id, any_value(n) AS n_epochs, count(*) FILTER (ok) AS kept, stddev_samp(y) FILTER (ok) AS s, quantile_cont(1e0 / sqrt(w), 0.5) FILTER (ok) AS e FROM rk GROUP BY 1)
SELECT source_id, n_epochs, CASE WHEN kept >= 8 THEN round({LN10_04!r} * sqrt(greatest(s * s - e * e, 0e0)), 4) END AS frac_rms, {_LS} FROM rs JOIN ls USING (source_id) WHERE source_id IN (SELECT source_id FROM i3 WHERE n_axes >= 1 OR has_excess)"""
)
