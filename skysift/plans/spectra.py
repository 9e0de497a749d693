"""Registered queries over spectra, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions import lines as K
from skysift.functions.tables import shared_folder
from skysift.operators import shape as H
from skysift.operators import spectra as S
from skysift.plans.bindings import bound, duck
from skysift.plans.catalog import rounded
from skysift.plans.tables import limit_sql
from skysift.streaming import twins

c = F.col


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound(spark, sf_dir, "spectra")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_arrays(_pixels(spark, sf_dir), "wave", "flux", "ivar")


def spectrum_continuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.continuum(_pixels(spark, sf_dir), 21).select("spec_id", "pix", "continuum"))


def bad_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("mask", F.when((c("spec_id") * 7 + c("pix")) % 23 == 0, 1).otherwise(0))
    return S.bad_pixels(p).groupBy("spec_id").agg(F.count_if("bad").alias("n_bad"))


def _with_widths(pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spectra of one angstrom a pixel with a mask, and the widths of their releases' lines."""
    p = pixels.withColumn("wave", c("wave") / 50.0 + 4000.0).withColumn("mask", F.when((c("spec_id") * 7 + c("pix")) % 97 == 0, 1).otherwise(0))
    n = c("spec_id") % 4
    releases = p.filter("pix = 0").select("spec_id", F.when(n == 0, "DESI-DR1").when(n == 1, "SDSS-DR16").when(n == 2, "BOSS-DR16").otherwise("other").alias("release"))
    return p, S.spread_sigma(p, releases)


def _surveyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _with_widths(_pixels(spark, sf_dir))


def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search with each spectrum's own line width and bad pixels left out."""
    return rounded(S.search(*_surveyed(spark, sf_dir), 4.0, 31).withColumn("reason", S.reject_reason()), 4)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.classified(*_surveyed(spark, sf_dir), 2.5, 31)


RUN = ("spec_id", "pix", "wavelength", "score", "n_survivors", "n_lines", "hunt_rank")


def spectra_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of a whole run: search, rejections, recurrence cut, rank."""
    return rounded(S.run_candidates(_classified(spark, sf_dir), 0.5, 3).select(*RUN), 4)


def spectra_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_totals(_classified(spark, sf_dir), 0.5, 3)


def spectra_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, widths = _surveyed(spark, sf_dir)
    searched = p.select("spec_id").distinct().agg(F.count(F.lit(1)).alias("n_searched"))
    return rounded(S.run_summary(S.classified(p, widths, 2.5, 31), searched, 0.5, 3), 6)


def stream_line_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates from a stream of spectra."""
    path = shared_folder(spark)
    rows = twins.stream(spark, f"{sf_dir}/embeddings.parque[t]", spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema)

    def search(batch: DataFrame) -> DataFrame:
        pixels = batch.select(c("vec_id").alias("spec_id"), F.posexplode("embedding").alias("pix", "x")).select("spec_id", "pix", (c("pix") * 50.0 + 4000.0).alias("wave"), (c("x").cast("double") + 1.0).alias("flux"), F.lit(100.0).alias("ivar"))
        return S.classified(*_with_widths(pixels), 2.5, 31)

    twins.line_run(rows, search, f"{path}/out", f"{path}/state").awaitTermination()
    return rounded(S.run_candidates(twins.read_lines(spark, f"{path}/out")[0], 0.5, 3).select(*RUN), 4)


def absorption_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.find_lines(_pixels(spark, sf_dir), 1.5, 4.0, 31, absorption=True)
    return rounded(S.with_snippets(found.withColumn("reason", S.absorption_reason()), _arrays(spark, sf_dir), 5).withColumn("n_win", F.size("win_flux")).drop("win_wave", "win_flux"), 4)


def line_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _pixels(spark, sf_dir).withColumns({"flux": (c("flux") - 1.0) * 0.02 + 1.0, "ivar": c("ivar") * 100.0, "wave": (c("wave") - 4000.0) / 50.0 + 5200.0})
    return rounded(S.recovery(flat))


def spread_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("wave", c("wave") / 50.0 + 4000.0)
    n = c("spec_id") % 4
    releases = p.filter("pix = 0").select("spec_id", F.when(n == 0, "DESI-DR1").when(n == 1, "SDSS-DR16").when(n == 2, "BOSS-DR16").otherwise("other").alias("release"))
    return rounded(S.spread_sigma(p, releases))


def line_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    targets = p.select("spec_id").distinct().withColumn("wavelength", 4200.0 + (c("spec_id") % 40) * 60.0)
    return rounded(S.excess_at(p, targets, 60.0, 600.0), 4)


def shape_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.feature_scan(_pixels(spark, sf_dir), 2.5), 4)


def line_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifiers over lines with shapes made from the given table."""
    n = c("spec_id") * 7 + c("line_no") * 13
    shaped = bound(spark, sf_dir, "lines").withColumns({"width_ratio": 0.5 + n % 13 / 10.0, "n_pix": n % 9, "fwhm": 1.5 + n % 11, "ivar_ratio": 0.45 + n % 10 / 10.0, "min_adjacent": 0.1 - n % 17 / 40.0, "asymmetry": 1.0 + n % 20 / 6.0})
    return shaped.select("spec_id", "line_no", "significance", S.reject_reason(F.lit(0.001)).alias("emission"), S.absorption_reason(F.lit(0.001)).alias("absorption"))


def colour_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = H.colour_bins(bound(spark, sf_dir, "catalogue").select("source_id", (c("bp_rp") + c("source_id") % 7 / 100.0).alias("colour")), "colour")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first"), F.max("source_id").alias("last"))


def shape_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.locus(H.normalized(_pixels(spark, sf_dir))), 7)


def shape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = H.normalized(_pixels(spark, sf_dir))
    return rounded(H.scores(H.deviations(p, H.locus(p))), 4)


def shape_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = H.normalized(_pixels(spark, sf_dir))
    return H.reliability(H.scores(H.deviations(p, H.locus(p))))


def _shape_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spectra whose colours follow their labels, some unknown; every eleventh has a bump and every thirteenth is steeper."""
    k = c("spec_id")
    bump = F.when((k % 11 == 0) & c("pix").between(30, 32), 3.0).otherwise(0.0)
    p = _pixels(spark, sf_dir).withColumn("flux", c("flux") + bump + F.when(k % 13 == 0, c("pix") / 40.0).otherwise(0.0))
    meta = p.filter("pix = 0").select(
        "spec_id", F.when(k % 29 > 0, c("label") + (k * 37 % 101) / 100.0).alias("colour"), (k % 5 / 4.0 - 0.4).alias("quasar"), (k % 7 / 6.0 - 0.4).alias("galaxy"),
        (8.0 + k % 6).alias("abs_g"), F.when(k % 3 == 0, "VARIABLE").otherwise("NOT_AVAILABLE").alias("variable"), (k % 4 == 0).cast("int").alias("non_single"),
    )
    return H.shape_run(p, meta, 4.0, confident=400, most=0.5)


def shape_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomalies of a whole run, with class and rank."""
    return rounded(_shape_run(spark, sf_dir)[0], 4)


def shape_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_shape_run(spark, sf_dir)[1], 6)


QUERIES = {f.__name__: f for f in (shape_run, shape_summary, spectrum_continuum, bad_pixels, line_search, spectra_run, spectra_totals, spectra_summary, stream_line_run, absorption_search, line_reasons, line_injection, spread_widths, colour_bin_counts, shape_scan, line_confirmation, shape_locus, shape_scores, shape_reliability)}

_P = duck("spectra")
_SHAPE = f"""
WITH s0 AS (SELECT spec_id, pix, label, flux / sum(abs(flux)) OVER (PARTITION BY spec_id) AS flux FROM {_P}),
m AS (SELECT label, pix, quantile_cont(flux, 0.5) AS med, count(*) AS n FROM s0 GROUP BY 1, 2),
d AS (SELECT label, pix, any_value(med) AS med, any_value(n) AS n, 1.4826e0 * quantile_cont(abs(flux - med), 0.5) AS sc FROM s0 JOIN m USING (label, pix) GROUP BY 1, 2),
t AS (SELECT label, quantile_cont(sc, 0.5) AS ty FROM d WHERE sc > 0 GROUP BY 1),
gm AS (SELECT pix, quantile_cont(flux, 0.5) AS gmed FROM s0 GROUP BY 1),
gd AS (SELECT pix, any_value(gmed) AS gmed, 1.4826e0 * quantile_cont(abs(flux - gmed), 0.5) AS gs FROM s0 JOIN gm USING (pix) GROUP BY 1),
lo AS (SELECT label AS bin, pix, CASE WHEN n < 3 THEN gmed ELSE med END AS med, CASE WHEN n < 3 THEN gs WHEN sc > 0 THEN sc ELSE ty END AS scale FROM d LEFT JOIN t USING (label) JOIN gd USING (pix)),
z AS (SELECT spec_id, s0.pix, (flux - med) / scale AS z FROM s0 JOIN lo ON lo.bin = s0.label AND lo.pix = s0.pix),
k AS (SELECT spec_id, count(*) AS n, sqrt(avg(z * z)) AS rms, max(abs(z)) AS peak, arg_max(pix, struct_pack(a := abs(z), b := -pix)) AS at_ FROM z GROUP BY 1),
w AS (SELECT spec_id, max(pix) FILTER (abs(z) <= peak / 2e0 AND pix < at_) AS l, min(pix) FILTER (abs(z) <= peak / 2e0 AND pix > at_) AS h FROM z JOIN k USING (spec_id) GROUP BY 1),
q AS (SELECT rms FROM k WHERE rms <= (SELECT quantile_cont(rms, 0.9) FROM k)),
u AS (SELECT quantile_cont(rms, 0.5) AS um FROM q), v AS (SELECT any_value(um) AS um, 1.4826e0 * quantile_cont(abs(rms - um), 0.5) AS us FROM q, u),
sc AS (SELECT spec_id, rms, (rms - um) / us AS global_sigma, peak, at_ AS pix, coalesce(h, n) - coalesce(l, -1) - 1 AS width, at_ >= 8 AND at_ < n - 8 AS interior, l IS NOT NULL AND h IS NOT NULL AS bounded FROM k JOIN w USING (spec_id), v),
sr AS (SELECT *, bounded AND interior AND width BETWEEN 2 AND 5 AS narrow FROM sc),
sa AS (SELECT *, global_sigma >= 8 OR peak >= 6 AS is_anomaly FROM sr)
"""


def _any(lines: tuple[float, ...], tolerance: float, stretch: float = 1.0) -> str:
    return f"len(list_filter([{', '.join(f'{w!r}e0' for w in lines)}], lambda x: abs(wavelength - x * {stretch!r}e0) <= {tolerance!r}e0)) > 0"


_BANDS = " OR ".join(f"wavelength BETWEEN {a} AND {b}" for a, b in K.TELLURIC)
_SHAPES = lambda widest: f"WHEN wr < 0.6e0 THEN 'cosmic_ray' WHEN wr > {widest}e0 THEN 'resolved_line' WHEN np < 2 THEN 'single_pixel' WHEN fw < 2 THEN 'unresolved_spike'"
_EMISSION_CASE = f"CASE {_SHAPES(1.6)} WHEN iv < 0.5e0 THEN 'sky_residual' WHEN mn < -0.3e0 THEN 'oversubtraction_residual' WHEN asy > 4 THEN 'asymmetric_profile' WHEN {_any(K.SKY, 1.5)} THEN 'sky_line' WHEN {_BANDS} THEN 'telluric' WHEN {_any(K.EMISSION, 3.0)} THEN 'astrophysical_line' END"
_ABSORPTION_CASE = f"CASE {_SHAPES(1.8)} WHEN mn < -0.3e0 THEN 'emission_flanked' WHEN asy > 4 THEN 'asymmetric_profile' WHEN {_any(K.SKY, 2.0)} THEN 'sky_line' WHEN {_BANDS} THEN 'telluric' WHEN {_any(K.STELLAR, 3.0)} THEN 'stellar_line' WHEN {_any(K.INTERSTELLAR, 2.0)} THEN 'ism_line' WHEN {_any(K.DIFFUSE, 4.0)} THEN 'diffuse_band' END"


def _search(source: str, snr_min: float, window: int, keys: str = "spec_id", absorption: bool = False, own: bool = False) -> str:
    """CTEs that end in ln: the lines of all spectra of 64 pixels in a source with keys, pix, wave, flux, ivar (and sg, their width). Needs WITH RECURSIVE."""
    half = min(window, 63) // 2
    sg, widest = ("sg", 5) if own else ("1.5e0", 6)
    reach = f"greatest(1, CAST(ceil(4e0 * {sg}) AS BIGINT))"
    total = " + ".join(f"CASE WHEN {reach} >= {abs(x)} THEN lag(sn, {x}, 0e0) OVER w * exp(-0.5e0 * pow({x} / {sg}, 2)) / nm ELSE 0e0 END" for x in range(-widest, widest + 1))
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    trough = "WHERE lv > 0 AND ex < 0.95e0 * lv" if absorption else ""
    forest = "QUALIFY count(*) OVER (PARTITION BY " + keys + ") <= 25" if absorption else ""
    return f"""
p0 AS (SELECT {keys}, pix, wave, flux, ivar{", sg" if own else ""}, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
o0 AS (SELECT {keys}, pix, n, unnest(range(pix - {half}, pix + {half + 1})) AS q FROM p0),
r0 AS (SELECT {keys}, pix, CASE WHEN q < 0 THEN -q WHEN q > n - 1 THEN 2 * (n - 1) - q ELSE q END AS q FROM o0),
k0 AS (SELECT {mine}, a.pix, quantile_cont(b.flux, 0.5) AS lv FROM r0 a JOIN p0 b ON {same} AND b.pix = a.q GROUP BY ALL),
e0 AS (SELECT p0.*, lv, {"lv - flux" if absorption else "flux - lv"} AS ex FROM p0 JOIN k0 USING ({keys}, pix)),
n0 AS (SELECT *, ex * sqrt(ivar) AS sn, sqrt(list_sum(list_transform(range(-{reach}, {reach} + 1), lambda x: exp(-pow(x / {sg}, 2))))) AS nm FROM e0),
s0 AS (SELECT *, {total} AS st, wave - lag(wave) OVER w AS dw FROM n0 WINDOW w AS (PARTITION BY {keys} ORDER BY pix)),
m0 AS (SELECT *, arg_max(pix, struct_pack(a := st, b := -pix)) OVER (PARTITION BY {keys} ORDER BY pix ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS j, lag(st) OVER w AS ls, lead(st) OVER w AS rs FROM s0 WINDOW w AS (PARTITION BY {keys} ORDER BY pix)),
c0 AS (SELECT {keys}, pix, j, min(pix) OVER (PARTITION BY {keys} ORDER BY pix RANGE BETWEEN 4 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, row_number() OVER (PARTITION BY {keys} ORDER BY pix) AS o FROM m0 WHERE st >= {snr_min} AND st >= ls AND st >= rs AND pix BETWEEN 1 AND n - 2),
t0 AS (SELECT {keys}, pix, j, nx FROM c0 WHERE o = 1 UNION ALL SELECT {mine.replace("a.", "b.")}, b.pix, b.j, b.nx FROM t0 a JOIN c0 b ON {same} AND b.pix = a.nx),
k2 AS (SELECT {mine}, a.pix AS i, b.pix AS j, wave AS wavelength, st AS significance, ex AS amp, lv, ivar AS own, n{", sg" if own else ""} FROM t0 a JOIN m0 b ON {same} AND b.pix = a.j),
k1 AS (SELECT * FROM (SELECT *, amp AS ex FROM k2) {trough} {forest}),
g0 AS (SELECT {mine}, a.i, a.j, wavelength, significance, amp, a.lv, own, a.n, {"a.sg" if own else "1.5e0 AS sg"}, b.pix - a.j AS x, b.pix, greatest(b.ex, 0e0) AS li, b.ex, b.sn, b.ivar, b.dw FROM k1 a JOIN m0 b ON {same}),
h0 AS (SELECT {keys}, i, j, wavelength, significance, amp, lv, own, n, sg, sum(li) FILTER (abs(x) <= ceil(4e0 * sg)) AS a0, sum(li * x) FILTER (abs(x) <= ceil(4e0 * sg)) AS a1, sum(li * x * x) FILTER (abs(x) <= ceil(4e0 * sg)) AS a2,
  count(*) FILTER (abs(x) <= ceil(4e0 * sg) AND sn > 1) AS np, max(pix) FILTER (x < 0 AND ex < 0.5e0 * amp) AS l, min(pix) FILTER (x > 0 AND ex < 0.5e0 * amp) AS r, min(ex) FILTER (abs(x) BETWEEN 1 AND 3) AS le,
  coalesce(sum(li) FILTER (x BETWEEN -3 AND -1), 0e0) + 1e-9 AS bl, coalesce(sum(li) FILTER (x BETWEEN 1 AND 3), 0e0) + 1e-9 AS rd, sum(li) FILTER (abs(pix - i) <= 3) AS fl, quantile_cont(ivar, 0.5) FILTER (abs(x) <= 150) AS ty, quantile_cont(dw, 0.5) AS step FROM g0 GROUP BY ALL),
ln AS (SELECT *, CASE WHEN a0 > 0 THEN sqrt(greatest(a2 / a0 - pow(a1 / a0, 2), 0e0)) / sg ELSE 'NaN'::DOUBLE END AS wr, CAST(CASE WHEN amp > 0 THEN coalesce(r, n) - coalesce(l, -1) - 1 ELSE 0 END AS DOUBLE) AS fw, CASE WHEN lv <> 0 THEN fl * step / lv ELSE 'NaN'::DOUBLE END AS ew,
  CASE WHEN amp > 0 THEN le / amp ELSE 0e0 END AS mn, CASE WHEN amp > 0 THEN greatest(bl / rd, rd / bl) ELSE 1e0 END AS asy, CASE WHEN ty > 0 THEN own / ty ELSE 1e0 END AS iv FROM h0)"""


_MASKED = f"""
sw AS (SELECT spec_id, pix, wave / 50e0 + 4000e0 AS wave, flux, ivar, (spec_id * 7 + pix) % 97 = 0 OR flux = 0 AS bad, spec_id % 4 AS rel FROM {_P}),
sv AS (SELECT spec_id, pix, wave, flux, CASE WHEN bool_or(bad) OVER (PARTITION BY spec_id ORDER BY pix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) THEN 0e0 ELSE ivar END AS ivar,
  CASE WHEN rel = 3 THEN 1e0 ELSE greatest(0.6e0, 4112e0 / CASE WHEN rel = 0 THEN 3000e0 ELSE 2000e0 END / 2.3548e0) END AS sg FROM sw)"""
_LINE = "spec_id, CAST(j AS INTEGER) AS pix, round(wavelength, 4) AS wavelength, round(significance, 4) AS significance, round(wr, 4) AS width_ratio, round(amp, 4) + 0e0 AS amplitude, fw AS fwhm, CAST(np AS INTEGER) AS n_pix, round(ew, 4) + 0e0 AS ew, round(mn, 4) + 0e0 AS min_adjacent, round(asy, 4) AS asymmetry, round(iv, 4) AS ivar_ratio"
_STEPS = "".join(f", q{k + 1} AS (SELECT *, x * p{k} - (n * n - {k * k}) * {k * k / (4.0 * k * k - 1)!r}e0 / (n * n) * p{k - 1} AS p{k + 1} FROM q{k})" for k in range(1, 6))
_SCAN = f"""
WITH q1 AS (SELECT *, 1e0 AS p0, x AS p1, least(6, greatest(3, floor(n / 15))) AS deg FROM (SELECT spec_id, pix, flux, CAST(count(*) OVER (PARTITION BY spec_id) AS DOUBLE) AS n, (2 * pix - (n - 1)) / n AS x FROM {_P})){_STEPS},
f AS (SELECT *, {", ".join(f"sum(flux * p{k}) OVER w / sum(p{k} * p{k}) OVER w AS c{k}" for k in range(7))} FROM q6 WINDOW w AS (PARTITION BY spec_id)),
e AS (SELECT spec_id, pix, flux, n, flux - ({" + ".join(f"CASE WHEN deg >= {k} THEN c{k} * p{k} ELSE 0e0 END" for k in range(7))}) AS rest FROM f),
m AS (SELECT spec_id, quantile_cont(rest, 0.5) AS md, quantile_cont(abs(flux), 0.5) AS fm FROM e GROUP BY 1),
s AS (SELECT spec_id, greatest(1.4826e0 * quantile_cont(abs(rest - md), 0.5), 1e-3 * any_value(fm) + 1e-9) AS sc FROM e JOIN m USING (spec_id) GROUP BY 1),
z AS (SELECT spec_id, pix, n, rest / sc AS z, max(rest / sc) OVER (PARTITION BY spec_id ORDER BY pix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM e JOIN s USING (spec_id)),
a AS (SELECT spec_id, pix AS j, z AS sigma FROM z WHERE n >= 19 AND pix BETWEEN 8 AND n - 9 AND z >= 2.5e0 AND z = top),
d AS (SELECT spec_id, j, sigma, max(pix) FILTER (pix < j AND z <= sigma / 2e0) AS l, min(pix) FILTER (pix > j AND z <= sigma / 2e0) AS r FROM a JOIN z USING (spec_id) GROUP BY 1, 2, 3)
SELECT spec_id, CAST(j AS INTEGER) AS pix, round(sigma, 4) AS sigma, CAST(r - l - 1 AS INTEGER) AS width FROM d WHERE r - l - 1 BETWEEN 2 AND 5 QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY j) = 1"""
_PUT = f"""
WITH RECURSIVE w0 AS (SELECT spec_id, pix, (wave - 4000e0) / 50e0 + 5200e0 AS wave, (flux - 1e0) * 0.02e0 + 1e0 AS flux, ivar * 100e0 AS ivar, count(*) OVER (PARTITION BY spec_id) AS nn, unnest([8e0, 15e0, 50e0]) AS snr FROM {_P}),
w1 AS (SELECT *, ((spec_id % 2147483648) * 2654435761 + CAST(snr * 40503 AS BIGINT)) % greatest(nn - 16, 1) + 8 AS place FROM w0),
w2 AS (SELECT *, max(ivar) FILTER (pix = place) OVER (PARTITION BY spec_id, snr) AS own_ FROM w1),
w3 AS (SELECT spec_id, snr, place, pix, wave, ivar, flux + snr / sqrt(1.5e0 * sqrt(pi())) / sqrt(own_) * exp(-0.5e0 * pow((pix - place) / 1.5e0, 2)) AS flux FROM w2)"""
ORACLE_SQL = {
    "line_search": f"WITH RECURSIVE {_MASKED}, {_search('sv', 4.0, 31, own=True)} SELECT {_LINE}, {_EMISSION_CASE} AS reason FROM ln",
    "absorption_search": f"WITH RECURSIVE {_search(_P, 4.0, 31, absorption=True)} SELECT {_LINE}, {_ABSORPTION_CASE} AS reason, CAST(least(j + 5, n - 1) - greatest(j - 5, 0) + 1 AS INTEGER) AS n_win FROM ln",
    "line_injection": f"""{_PUT}, {_search("w3", 7.0, 101, "spec_id, snr")},
ok AS (SELECT spec_id, snr, j FROM ln WHERE {_EMISSION_CASE} IS NULL),
ht AS (SELECT t.spec_id, t.snr, coalesce(bool_or(abs(ok.j - place) <= 2.5e0), false) AS h FROM (SELECT DISTINCT spec_id, snr, place FROM w3) t LEFT JOIN ok ON ok.spec_id = t.spec_id AND ok.snr = t.snr GROUP BY 1, 2)
SELECT snr, count(*) AS n, round(avg(CAST(h AS DOUBLE)), 5) AS recovered FROM ht GROUP BY 1""",
    "shape_scan": _SCAN,
    "spread_widths": f"""WITH s AS (SELECT spec_id, pix, wave / 50e0 + 4000e0 AS wave, count(*) OVER (PARTITION BY spec_id) AS n FROM {_P}), d AS (SELECT *, abs(wave - lag(wave) OVER (PARTITION BY spec_id ORDER BY pix)) AS dw FROM s),
o AS (SELECT spec_id, quantile_cont(dw, 0.5) AS step, max(wave) FILTER (pix = n // 2) AS mid, CASE spec_id % 4 WHEN 0 THEN 3000e0 WHEN 1 THEN 2000e0 WHEN 2 THEN 2000e0 END AS r FROM d GROUP BY 1)
SELECT spec_id, round(CASE WHEN r IS NOT NULL AND step > 0 THEN greatest(mid / r / 2.3548e0 / step, 0.6e0) ELSE 1e0 END, 5) AS sigma FROM o""",
    "colour_bin_counts": f"""WITH s AS (SELECT source_id, bp_rp + source_id % 7 / 100e0 AS colour FROM {duck("catalogue")}), k AS (SELECT greatest(1, least(24, count(colour) // 40)) AS b FROM s),
v AS (SELECT list(colour ORDER BY colour) AS cs FROM s WHERE colour IS NOT NULL), h AS (SELECT cs, (len(cs) - 1) * i / CAST(b AS DOUBLE) AS hh FROM v, (SELECT b, unnest(range(1, b)) AS i FROM k)),
e AS (SELECT list_distinct(list(cs[CAST(floor(hh) AS INTEGER) + 1] + (hh - floor(hh)) * (cs[CAST(ceil(hh) AS INTEGER) + 1] - cs[CAST(floor(hh) AS INTEGER) + 1]))) AS ed FROM h)
SELECT bin, count(*) AS n, min(source_id) AS first, max(source_id) AS last FROM (SELECT source_id, CASE WHEN colour IS NOT NULL THEN CAST(len(list_filter(ed, lambda x: colour >= x)) AS INTEGER) END AS bin FROM s, e) GROUP BY 1""",
    "line_reasons": f"""
WITH l AS (SELECT *, spec_id * 7 + line_no * 13 AS n FROM {duck("lines")}),
s AS (SELECT *, 0.5e0 + n % 13 / 10e0 AS wr, n % 9 AS np, 1.5e0 + n % 11 AS fw, 0.45e0 + n % 10 / 10e0 AS iv, 0.1e0 - n % 17 / 40e0 AS mn, 1e0 + n % 20 / 6e0 AS asy FROM l)
SELECT spec_id, line_no, significance, CASE {_SHAPES(1.6)} WHEN iv < 0.5e0 THEN 'sky_residual' WHEN mn < -0.3e0 THEN 'oversubtraction_residual' WHEN asy > 4 THEN 'asymmetric_profile' WHEN {_any(K.SKY, 1.5)} THEN 'sky_line' WHEN {_BANDS} THEN 'telluric' WHEN {_any(K.EMISSION, 3.0, 1.001)} THEN 'astrophysical_line' END AS emission,
  CASE {_SHAPES(1.8)} WHEN mn < -0.3e0 THEN 'emission_flanked' WHEN asy > 4 THEN 'asymmetric_profile' WHEN {_any(K.SKY, 2.0)} THEN 'sky_line' WHEN {_BANDS} THEN 'telluric' WHEN {_any(K.STELLAR, 3.0, 1.001)} THEN 'stellar_line' WHEN {_any(K.INTERSTELLAR, 2.0)} THEN 'ism_line' WHEN {_any(K.DIFFUSE, 4.0)} THEN 'diffuse_band' END AS absorption FROM s""",
    "spectrum_continuum": f"""
WITH p AS (SELECT spec_id, pix, flux, count(*) OVER (PARTITION BY spec_id) AS n FROM {_P}),
o AS (SELECT p.spec_id, p.pix, unnest(range(p.pix - 10, p.pix + 11)) AS q, n FROM p),
r AS (SELECT spec_id, pix, CASE WHEN q < 0 THEN -q WHEN q > n - 1 THEN 2 * (n - 1) - q ELSE q END AS q FROM o)
SELECT r.spec_id, r.pix, round(quantile_cont(p.flux, 0.5), 5) AS continuum FROM r JOIN p ON p.spec_id = r.spec_id AND p.pix = r.q GROUP BY 1, 2""",
    "bad_pixels": f"""
WITH p AS (SELECT spec_id, pix, (flux IS NULL OR flux = 0 OR ivar <= 0 OR (spec_id * 7 + pix) % 23 = 0) AS b FROM {_P}),
w AS (SELECT spec_id, bool_or(b) OVER (PARTITION BY spec_id ORDER BY pix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bad FROM p) SELECT spec_id, count(*) FILTER (bad) AS n_bad FROM w GROUP BY 1""",
    "line_confirmation": f"""
WITH d AS (SELECT *, 4200e0 + (spec_id % 40) * 60e0 AS wavelength FROM {_P}), n AS (SELECT *, abs(wave - wavelength) AS d FROM d WHERE abs(wave - wavelength) <= 600),
o AS (SELECT spec_id, wavelength, quantile_cont(flux, 0.5) FILTER (d > 60) AS level, stddev_pop(flux) FILTER (d > 60) AS noise, max(flux) FILTER (d <= 60) AS top FROM n GROUP BY 1, 2)
SELECT spec_id, wavelength, round(level, 4) + 0e0 AS level, round(noise, 4) AS noise, round((top - level) / noise, 4) + 0e0 AS peak, coalesce((top - level) / noise >= 4, false) AS present FROM o""",
    "shape_locus": _SHAPE + "SELECT bin, pix, round(med, 7) + 0e0 AS med, round(scale, 7) AS scale FROM lo",
    "shape_scores": _SHAPE + "SELECT spec_id, round(rms, 4) AS rms, round(global_sigma, 4) + 0e0 AS global_sigma, round(peak, 4) AS peak, pix, width, interior, bounded, narrow, is_anomaly FROM sa",
    "shape_reliability": _SHAPE + "SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS n_anomalies, count(*) >= 1500 AND count(*) FILTER (is_anomaly) / count(*) <= 0.15e0 AS reliable FROM sa",
}
_RUN = f"""
WITH RECURSIVE {_MASKED}, {_search("sv", 2.5, 31, own=True)},
cl AS (SELECT *, {_EMISSION_CASE} AS reason, count(*) OVER (PARTITION BY spec_id) AS n_lines FROM ln),
ca AS (SELECT *, count(*) OVER (PARTITION BY spec_id) AS n_survivors, CAST(round_even(wavelength / 0.5e0, 0) AS BIGINT) AS bin FROM cl WHERE reason IS NULL),
sc AS (SELECT *, least(greatest(0.45e0 * (1e0 - exp(-greatest(significance, 0e0) / 10e0)) + 0.35e0 * exp(-pow((CASE WHEN isfinite(wr) THEN wr ELSE 1e0 END - 1e0) / 0.25e0, 2) / 2e0) + 0.2e0 / n_survivors, 0e0), 1e0) AS score FROM ca),
rc AS (SELECT * FROM sc WHERE bin NOT IN (SELECT bin FROM sc GROUP BY bin HAVING count(DISTINCT spec_id) >= 3))"""
ORACLE_SQL["spectra_run"] = ORACLE_SQL["stream_line_run"] = _RUN + " SELECT spec_id, CAST(j AS INTEGER) AS pix, round(wavelength, 4) AS wavelength, round(score, 4) AS score, n_survivors, n_lines, round(score / (1e0 + 0.15e0 * (n_lines - 1)), 4) AS hunt_rank FROM rc"
ORACLE_SQL["spectra_totals"] = _RUN + " SELECT reason, count(*) AS n FROM cl WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'survives', count(*) FROM rc HAVING count(*) > 0 UNION ALL SELECT 'recurrent_artifact', (SELECT count(*) FROM sc) - (SELECT count(*) FROM rc) WHERE (SELECT count(*) FROM sc) > (SELECT count(*) FROM rc)"
_ONE = "su AS (SELECT (SELECT count(DISTINCT spec_id) FROM sw) AS n, (SELECT count(*) FROM rc) AS k)"
ORACLE_SQL["spectra_summary"] = _RUN + f", {_ONE}, " + limit_sql("su") + "SELECT n AS n_searched, k AS n_candidates, point, upper_limit FROM lim"
_XP = f"""
b0 AS (SELECT spec_id, pix, flux + CASE WHEN spec_id % 11 = 0 AND pix BETWEEN 30 AND 32 THEN 3e0 ELSE 0e0 END + CASE WHEN spec_id % 13 = 0 THEN pix / 40e0 ELSE 0e0 END AS f, label FROM {_P}),
b1 AS (SELECT spec_id, pix, f / sum(abs(f)) OVER (PARTITION BY spec_id) AS flux, CASE WHEN spec_id % 29 > 0 THEN label + (spec_id * 37 % 101) / 100e0 END AS colour FROM b0),
cs AS (SELECT spec_id, any_value(colour) AS colour FROM b1 GROUP BY 1), nb AS (SELECT greatest(1, least(24, count(colour) // 40)) AS bins, list(colour ORDER BY colour) FILTER (colour IS NOT NULL) AS v FROM cs),
ed AS (SELECT list(DISTINCT (ceil(pos) - pos) * v[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * v[CAST(ceil(pos) AS BIGINT) + 1] + CASE WHEN pos = floor(pos) THEN v[CAST(pos AS BIGINT) + 1] ELSE 0e0 END) AS inner_ FROM (SELECT v, unnest(range(1, bins)) / CAST(bins AS DOUBLE) * (len(v) - 1) AS pos FROM nb)),
bn AS (SELECT b1.*, CASE WHEN colour IS NOT NULL THEN len(list_filter(inner_, lambda e: colour >= e)) END AS bin FROM b1, ed),
md AS (SELECT bin, pix, quantile_cont(flux, 0.5) AS med, count(*) AS n FROM bn WHERE bin IS NOT NULL GROUP BY 1, 2), ms AS (SELECT bin, pix, any_value(med) AS med, any_value(n) AS n, 1.4826e0 * quantile_cont(abs(flux - med), 0.5) AS sc FROM bn JOIN md USING (bin, pix) GROUP BY 1, 2),
mt AS (SELECT bin, quantile_cont(sc, 0.5) AS ty FROM ms WHERE sc > 0 GROUP BY 1),
zz AS (SELECT spec_id, pix, (flux - med) / CASE WHEN sc > 0 THEN sc ELSE coalesce(ty, 1e-6) END AS z FROM bn JOIN ms USING (bin, pix) LEFT JOIN mt USING (bin)),
zk AS (SELECT spec_id, count(*) AS n, sqrt(avg(z * z)) AS rms, max(abs(z)) AS peak, arg_max(pix, struct_pack(a := abs(z), b := -pix)) AS at_ FROM zz GROUP BY 1),
zw AS (SELECT spec_id, max(pix) FILTER (abs(z) <= peak / 2e0 AND pix < at_) AS l, min(pix) FILTER (abs(z) <= peak / 2e0 AND pix > at_) AS h FROM zz JOIN zk USING (spec_id) GROUP BY 1),
zq AS (SELECT rms FROM zk WHERE rms <= (SELECT quantile_cont(rms, 0.9) FROM zk)), zu AS (SELECT quantile_cont(rms, 0.5) AS um FROM zq), zv AS (SELECT any_value(um) AS um, greatest(1.4826e0 * quantile_cont(abs(rms - um), 0.5), 1e-9) AS us FROM zq, zu),
an AS (SELECT k.*, (rms - um) / us AS gs, coalesce(h, n) - coalesce(l, -1) - 1 AS width, l IS NOT NULL AND h IS NOT NULL AND at_ >= 8 AND at_ < n - 8 AND coalesce(h, n) - coalesce(l, -1) - 1 BETWEEN 2 AND 5 AS narrow, colour FROM zk k JOIN zw USING (spec_id) JOIN cs USING (spec_id), zv WHERE (rms - um) / us >= 8 OR peak >= 4),
ac AS (SELECT *, CASE WHEN spec_id % 5 / 4e0 - 0.4e0 > 0.5e0 THEN 'quasar' WHEN spec_id % 7 / 6e0 - 0.4e0 > 0.5e0 THEN 'galaxy' WHEN 8 + spec_id % 6 > 10 AND colour < 1.5e0 THEN 'white_dwarf' WHEN spec_id % 3 = 0 THEN 'known_variable' WHEN spec_id % 4 = 0 THEN 'non_single_star' ELSE 'clean' END AS class FROM an)"""
ORACLE_SQL["shape_run"] = f"""WITH {_XP}, rk AS (SELECT spec_id, CAST(row_number() OVER (ORDER BY narrow DESC, greatest(gs, peak) DESC, spec_id) AS INTEGER) AS rank FROM ac WHERE class = 'clean')
SELECT spec_id, class, rank, round(gs, 4) AS global_sigma, round(peak, 4) AS peak, at_ AS pix, width, narrow FROM ac LEFT JOIN rk USING (spec_id)"""
ORACLE_SQL["shape_summary"] = f"""WITH RECURSIVE {_XP}, su AS (SELECT (SELECT count(*) FROM cs) AS n, count(*) FILTER (class = 'clean') AS k, count(*) AS n_anomalies, count(*) FILTER (class = 'clean' AND narrow AND peak >= 4) AS n_narrow_clean FROM ac), {limit_sql("su")}
SELECT n AS n_searched, n_anomalies, k AS n_clean, n_narrow_clean, n >= 400 AND n_anomalies / n <= 0.5e0 AS reliable, point, upper_limit FROM lim"""
