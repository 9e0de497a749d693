"""Spectral lines in pixels: continuum, masks, matched filter, peaks, classification, injection and recovery.

Everything works on the long form, one row for each pixel, pix counting from 0 without gaps. The filter is a sum
of lagged pixels, whose weights follow each spectrum's own line width; peaks are taken from the left by a fold over the
few local maxima of a spectrum; and their shapes come from an equi-join of the peaks with the pixels of their own
spectrum, so that all of it is windows, joins and grouped aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.lines import DIFFUSE, EMISSION, INTERSTELLAR, SKY, STELLAR, TELLURIC
from skysift.functions.tables import let_workers_import, written
from skysift.operators.limits import occurrence_limit
from skysift.operators.triage import recurrent_bins

c = F.col
#: Resolving power of each release's spectrographs.
RESOLUTION = {"DESI": 3000.0, "SDSS": 2000.0, "BOSS": 2000.0}


#: Values of all windows that are held at once.
WINDOW_VALUES = 4_000_000


def _half(n: int, window: int) -> int:
    return (min(window, n if n % 2 else n - 1) - 1) // 2


def _median_of_rows(pix: list[int], flux: list[float | None], window: int) -> list[float | None]:
    """The median about each pixel where some have no flux or pixels don't count from 0: of the rows within reach, nulls first and NaN last."""
    n, out = len(pix), []
    h = _half(n, window)
    rows = list(zip(pix, flux)) + [(-q, f) for q, f in zip(pix, flux) if 1 <= q <= h] + [(2 * (n - 1) - q, f) for q, f in zip(pix, flux) if n - 1 - h <= q <= n - 2]
    rows.sort(key=lambda x: x[0])
    rank = lambda f: (0, 0.0) if f is None else (2, 0.0) if f != f else (1, f)
    own = np.array([q for q, _ in rows])
    for q in pix:
        near = sorted((f for _, f in rows[np.searchsorted(own, q - h) : np.searchsorted(own, q + h, "right")]), key=rank)
        out.append(near[len(near) // 2])
    return out


def running_medians(pix: pa.Array, flux: pa.Array, window: int) -> pa.Array:
    """The running median of each list of fluxes, spectra of the same length together."""
    sizes = np.diff(pix.offsets.to_numpy())
    begins, places, values = pix.offsets.to_numpy()[:-1], pix.values, flux.values
    out: list = [None] * len(pix)
    if places.null_count + values.null_count:
        regular = np.zeros(len(pix), dtype=bool)
    else:
        places, values = places.to_numpy(), values.to_numpy()
        regular = np.array([n > 0 and places[a] == 0 and places[a + n - 1] == n - 1 and bool((np.diff(places[a : a + n]) == 1).all()) for a, n in zip(begins, sizes)], dtype=bool)
    for i in np.flatnonzero(~regular):
        out[i] = _median_of_rows(pix[i].as_py(), flux[i].as_py(), window)
    for n in np.unique(sizes[regular]).tolist():
        h, some = _half(n, window), np.flatnonzero(regular & (sizes == n))
        step = max(1, WINDOW_VALUES // (n * (2 * h + 1)))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            padded = np.pad(values[begins[part][:, None] + np.arange(n)], ((0, 0), (h, h)), mode="reflect")
            middle = np.partition(np.lib.stride_tricks.sliding_window_view(padded, 2 * h + 1, axis=1), h, axis=-1)[..., h]
            for i, row in zip(part, middle):
                out[i] = row
    return pa.array(out, pa.list_(pa.float64()))


def continuum(pixels: DataFrame, window: int = 101, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Add continuum: the running median over an odd window of pixels, mirrored at both ends.

    The window is clipped to the spectrum's length. A spectrum is one row while its medians are taken.
    """

    def medians(pix: pa.Array, flux: pa.Array) -> pa.Array:
        return running_medians(pix, flux, window)

    let_workers_import(pixels.sparkSession)
    rest = [x for x in pixels.columns if x not in keys]
    one = pixels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pix", *(x for x in rest if x != "pix")))).alias("_p"))
    field = lambda name, kind: F.transform("_p", lambda x: x[name].cast(kind))
    one = one.withColumn("_c", F.arrow_udf(medians, "array<double>")(field("pix", "bigint"), field("flux", "double")))
    rows = one.select(*keys, F.explode(F.arrays_zip("_p", "_c")).alias("_x"))
    of = {x: c(x) if x in keys else c("_x._p")[x].alias(x) for x in pixels.columns}
    return rows.select(*of.values(), c("_x._c").alias("continuum"))


def bad_pixels(pixels: DataFrame, reach: int = 2, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """Add bad: unusable flux or inverse variance, or a survey mask, within reach pixels."""
    w = Window.partitionBy(*keys).orderBy("pix").rowsBetween(-reach, reach)
    mask = c("mask") if "mask" in pixels.columns else F.lit(0)
    bad = c("flux").isNull() | F.isnan("flux") | (c("flux") == 0) | c("ivar").isNull() | (c("ivar") <= 0) | (F.coalesce(mask, F.lit(0)) != 0)
    return pixels.withColumn("bad", F.max(bad.cast("int")).over(w) == 1)


def to_arrays(pixels: DataFrame, *columns: str) -> DataFrame:
    """One row for each spectrum with its pixels as arrays in order."""
    packed = F.array_sort(F.collect_list(F.struct("pix", *columns)))
    one = pixels.groupBy("spec_id").agg(packed.alias("_p"))
    field = lambda n: F.transform("_p", lambda x: x[n]).alias(n)
    return one.select("spec_id", *map(field, columns))


def spread_sigma(pixels: DataFrame, releases: DataFrame) -> DataFrame:
    """(spec_id, sigma): width of an unresolved line in pixels, from the resolving power of the spectrum's release.

    releases: (spec_id, release). It is taken at the middle pixel, is at least 0.6, and 1 where the release or
    the dispersion isn't known.
    """
    step = F.abs(c("wave") - F.lag("wave").over(Window.partitionBy("spec_id").orderBy("pix")))
    one = pixels.select("spec_id", "pix", "wave", step.alias("_d"), F.count(F.lit(1)).over(Window.partitionBy("spec_id")).alias("_n"))
    one = one.groupBy("spec_id").agg(F.percentile("_d", F.lit(0.5)).alias("_step"), F.max(F.when(c("pix") == F.floor(c("_n") / 2), c("wave"))).alias("_mid"))
    power = F.lit(None).cast("double")
    for name, value in RESOLUTION.items():
        power = F.when(c("release").startswith(name), F.lit(value)).otherwise(power)
    sigma = c("_mid") / power / 2.3548 / F.when(c("_step") > 0, c("_step"))
    return one.join(releases.select("spec_id", "release"), "spec_id", "left").select("spec_id", F.when(sigma.isNotNull(), F.greatest(sigma, F.lit(0.6))).otherwise(1.0).alias("sigma"))


def kernel(sigma: float) -> list[float]:
    """Gaussian weights with a sum of squares of 1, four sigma to each side."""
    half = max(1, math.ceil(4 * sigma))
    raw = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-half, half + 1)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw]


def _own_width(p: DataFrame, sigma: float | DataFrame) -> tuple[DataFrame, int]:
    """Rows with _sigma, _reach (four sigma) and _norm (root of the sum of squared weights), and the widest reach.

    sigma is one width, or a table (spec_id, sigma), where spectra that it doesn't hold have a width of 1.
    """
    if not isinstance(sigma, DataFrame):
        reach = max(1, math.ceil(4 * sigma))
        norm = math.sqrt(sum(math.exp(-((x / sigma) ** 2)) for x in range(-reach, reach + 1)))
        return p.withColumns({"_sigma": F.lit(float(sigma)), "_reach": F.lit(reach), "_norm": F.lit(norm)}), reach
    own = sigma.select("spec_id", c("sigma").alias("_sigma"))
    widest = own.agg(F.max("_sigma")).first()[0]
    out = p.join(own, "spec_id", "left").withColumn("_sigma", F.coalesce("_sigma", F.lit(1.0)))
    out = out.withColumn("_reach", F.greatest(F.lit(1), F.ceil(c("_sigma") * 4).cast("int")))
    square = lambda total, x: total + F.exp(-F.pow(x / c("_sigma"), 2))
    norm = F.sqrt(F.aggregate(F.sequence(-c("_reach"), c("_reach")), F.lit(0.0), square))
    return out.withColumn("_norm", norm), max(4, math.ceil(4 * (widest or 1.0)))


def filtered(pixels: DataFrame, sigma: float | DataFrame, window: int, absorption: bool, keys: Sequence[str]) -> DataFrame:
    """Spectra of five pixels or more with n, continuum, excess over (or under) it, pixel_snr, and strength, the matched filter's output.

    sigma is the lines' width in pixels: one for all, or a table (spec_id, sigma).
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("pix")
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    p = pixels.select(*keys, "pix", "wave", "ivar", F.when(finite("flux"), c("flux")).otherwise(0.0).alias("flux"), (finite("flux") & finite("ivar") & (c("ivar") > 0)).alias("good"))
    p = continuum(p.withColumn("n", F.count(F.lit(1)).over(whole)).filter("n >= 5"), window, keys)
    p = p.withColumn("excess", c("continuum") - c("flux") if absorption else c("flux") - c("continuum"))
    p = p.withColumn("pixel_snr", F.when(c("good"), c("excess") * F.sqrt("ivar")).otherwise(0.0))
    p, widest = _own_width(p, sigma)
    strength = F.lit(0.0)
    for x in range(-widest, widest + 1):
        term = F.lag("pixel_snr", x, 0.0).over(order) * (F.exp(F.pow(x / c("_sigma"), 2) * -0.5) / c("_norm"))
        strength = strength + F.when(c("_reach") >= abs(x), term).otherwise(0.0)
    return p.withColumn("strength", strength)


def peaks(p: DataFrame, snr_min: float, apart: int, keys: Sequence[str]) -> DataFrame:
    """(keys, from_pix, at): the peaks of a filtered spectrum, taken from the left.

    A peak begins at an inner pixel that reaches snr_min and isn't exceeded by its two neighbours; it is refined to the
    greatest value within ``apart`` pixels (the first of equals), and the next peak begins beyond those. A fold over
    a spectrum's local maxima, in order, keeps the ones that are begun.
    """
    order = Window.partitionBy(*keys).orderBy("pix")
    best = F.max_by("pix", F.struct("strength", -c("pix"))).over(order.rowsBetween(-apart, apart))
    top = (c("strength") >= snr_min) & (c("strength") >= F.lag("strength").over(order)) & (c("strength") >= F.lead("strength").over(order)) & c("pix").between(1, c("n") - 2)
    maxima = p.select(*keys, "pix", best.alias("at"), top.alias("_top")).filter("_top")
    listed = maxima.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(c("pix").cast("int").alias("pix"), c("at").cast("int").alias("at")))).alias("_m"))
    none = F.array().cast("array<struct<pix:int,at:int>>")
    step = lambda s, x: F.when(x.pix >= s.after, F.struct((x.pix + (apart + 1)).alias("after"), F.concat(s.got, F.array(x)).alias("got"))).otherwise(s)
    kept = F.aggregate("_m", F.struct(F.lit(1).alias("after"), none.alias("got")), step, lambda s: s.got)
    return listed.select(*keys, F.explode(kept).alias("_k")).select(*keys, c("_k.pix").alias("from_pix"), "_k.at")


def search(pixels: DataFrame, widths: DataFrame, snr_min: float = 8.0, window: int = 101, absorption: bool = False) -> DataFrame:
    """find_lines() with the width of each spectrum's own lines (spec_id, sigma) and pixels near bad ones left out."""
    good = bad_pixels(pixels).withColumn("ivar", F.when(c("bad"), 0.0).otherwise(c("ivar")))
    return find_lines(good, widths, snr_min, window, absorption)


def find_lines(pixels: DataFrame, sigma: float | DataFrame = 1.5, snr_min: float = 8.0, window: int = 101, absorption: bool = False, forest: int = 25, apart: int = 3, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """(keys, line columns): peaks() of the matched filter with their shapes.

    Troughs of nearly the whole continuum, or without one, are no absorption lines, and spectra with a forest of those
    are left out.
    """
    order = Window.partitionBy(*keys).orderBy("pix")
    p = filtered(pixels, sigma, window, absorption, keys).withColumn("_step", c("wave") - F.lag("wave").over(order))
    p = written(p.select(*keys, "pix", "wave", "ivar", "n", "continuum", "excess", "pixel_snr", "strength", "_step", "_sigma", "_reach"))
    found = peaks(p, snr_min, apart, keys).withColumnRenamed("at", "pix").join(p, [*keys, "pix"])
    peak = found.select(*keys, "from_pix", c("pix").alias("at"), c("wave").alias("wavelength"), c("strength").alias("significance"), c("excess").alias("amplitude"), c("continuum").alias("level"), c("ivar").alias("own"), "n", "_sigma", "_reach")
    if absorption:
        peak = peak.filter((c("level") > 0) & (c("amplitude") < c("level") * 0.95))
        peak = peak.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(c("_many") <= forest).drop("_many")
    x, light = c("pix") - c("at"), F.greatest("excess", F.lit(0.0))
    inside, low = F.abs(x) <= F.greatest("_reach", F.lit(2)), c("excess") < c("amplitude") * 0.5
    near = peak.join(p.select(*keys, "pix", "excess", "pixel_snr", "ivar", "_step"), list(keys))
    one = near.groupBy(*peak.columns).agg(
        F.sum(F.when(inside, light)).alias("s0"),
        F.sum(F.when(inside, light * x)).alias("s1"),
        F.sum(F.when(inside, light * x * x)).alias("s2"),
        F.count_if(inside & (c("pixel_snr") > 1)).cast("int").alias("n_pix"),
        F.max(F.when((x < 0) & low, c("pix"))).alias("left"),
        F.min(F.when((x > 0) & low, c("pix"))).alias("right"),
        F.min(F.when(F.abs(x).between(1, 3), c("excess"))).alias("least"),
        (F.coalesce(F.sum(F.when(x.between(-3, -1), light)), F.lit(0.0)) + 1e-9).alias("blue"),
        (F.coalesce(F.sum(F.when(x.between(1, 3), light)), F.lit(0.0)) + 1e-9).alias("red"),
        F.sum(F.when(F.abs(c("pix") - c("from_pix")) <= apart, light)).alias("flux"),
        F.percentile(F.when((F.abs(x) <= 150) & (c("ivar") >= 0) & ~F.isnan("ivar"), c("ivar")), F.lit(0.5)).alias("typical"),
        F.percentile("_step", F.lit(0.5)).alias("step"),
    )
    up = c("amplitude") > 0
    spread = F.greatest(c("s2") / c("s0") - F.pow(c("s1") / c("s0"), 2), F.lit(0.0))
    return one.select(
        *keys,
        c("at").cast("int").alias("pix"),
        "wavelength",
        "significance",
        F.when(c("s0") > 0, F.sqrt(spread) / c("_sigma")).otherwise(float("nan")).alias("width_ratio"),
        "amplitude",
        F.when(up, F.coalesce("right", "n") - F.coalesce("left", F.lit(-1)) - 1).otherwise(0).cast("double").alias("fwhm"),
        "n_pix",
        F.when(c("level") != 0, c("flux") * c("step") / c("level")).otherwise(float("nan")).alias("ew"),
        F.when(up, c("least") / c("amplitude")).otherwise(0.0).alias("min_adjacent"),
        F.when(up, F.greatest(c("blue") / c("red"), c("red") / c("blue"))).otherwise(1.0).alias("asymmetry"),
        F.when(c("typical") > 0, c("own") / c("typical")).otherwise(1.0).alias("ivar_ratio"),
    )


def _near(w: Column, lines: tuple[float, ...], tolerance: float, stretch: Column | None = None) -> Column:
    table = F.array(*map(F.lit, lines))
    return F.exists(table, lambda x: F.abs(w - (x if stretch is None else x * stretch)) <= tolerance)


def _telluric(w: Column) -> Column:
    inside = F.lit(False)
    for low, high in TELLURIC:
        inside = inside | w.between(low, high)
    return inside


def _shape_reason(widest: float) -> Column:
    """Rejections by width and sampling that both searches share."""
    wide = ~F.isnan("width_ratio") & (c("width_ratio") > widest)
    return F.when(c("width_ratio") < 0.6, "cosmic_ray").when(wide, "resolved_line").when(c("n_pix") < 2, "single_pixel").when(c("fwhm") < 2, "unresolved_spike")


def reject_reason(redshift: Column | None = None) -> Column:
    """The first reason why an emission line is no candidate, else NULL."""
    w, stretch = c("wavelength"), 1.0 + (F.lit(0.0) if redshift is None else F.coalesce(redshift, F.lit(0.0)))
    return (
        _shape_reason(1.6)
        .when(c("ivar_ratio") < 0.5, "sky_residual")
        .when(c("min_adjacent") < -0.30, "oversubtraction_residual")
        .when(c("asymmetry") > 4, "asymmetric_profile")
        .when(_near(w, SKY, 1.5), "sky_line")
        .when(_telluric(w), "telluric")
        .when(_near(w, EMISSION, 3.0, stretch), "astrophysical_line")
    )


def absorption_reason(redshift: Column | None = None) -> Column:
    """The same for an absorption line; stellar lines move with the star, interstellar ones and bands do not."""
    w, stretch = c("wavelength"), 1.0 + (F.lit(0.0) if redshift is None else F.coalesce(redshift, F.lit(0.0)))
    return (
        _shape_reason(1.8)
        .when(c("min_adjacent") < -0.30, "emission_flanked")
        .when(c("asymmetry") > 4, "asymmetric_profile")
        .when(_near(w, SKY, 2.0), "sky_line")
        .when(_telluric(w), "telluric")
        .when(_near(w, STELLAR, 3.0, stretch), "stellar_line")
        .when(_near(w, INTERSTELLAR, 2.0), "ism_line")
        .when(_near(w, DIFFUSE, 4.0), "diffuse_band")
    )


def line_score(significance: Column, width_ratio: Column, n_survivors: Column) -> Column:
    """How much a line looks like a laser's, 0 to 1: strong, as wide as the instrument's profile (an unknown width counts as such), alone."""
    width = F.coalesce(F.when(F.abs(width_ratio) < float("inf"), width_ratio), F.lit(1.0))
    fit = F.exp(F.pow((width - 1.0) / 0.25, 2) * -0.5)
    strong = 1.0 - F.exp(-F.greatest(significance, F.lit(0.0)) / 10.0)
    return F.least(F.greatest(strong * 0.45 + fit * 0.35 + F.lit(0.20) / F.greatest(n_survivors, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def candidates(lines: DataFrame, reason: Column | None = None) -> DataFrame:
    """Surviving lines with n_survivors of their spectrum and score."""
    kept = lines.withColumn("reason", reject_reason() if reason is None else reason).filter("reason IS NULL").withColumn("n_survivors", F.count(F.lit(1)).over(Window.partitionBy("spec_id")))
    return kept.drop("reason").withColumn("score", line_score(c("significance"), c("width_ratio"), c("n_survivors")))


def reasons(lines: DataFrame, reason: Column | None = None) -> DataFrame:
    return lines.groupBy(F.coalesce(reject_reason() if reason is None else reason, F.lit("survives")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def classified(pixels: DataFrame, widths: DataFrame, snr_min: float = 8.0, window: int = 101, absorption: bool = False) -> DataFrame:
    """search() with reason (NULL for survivors) and n_lines, the lines of the spectrum; what a run keeps of a part of its spectra."""
    lines = search(pixels, widths, snr_min, window, absorption).withColumn("reason", absorption_reason() if absorption else reject_reason())
    return lines.withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("spec_id")))


def run_candidates(lines: DataFrame, width: float = 2.0, least: int = 3) -> DataFrame:
    """The candidates of classified() lines: survivors with their score, less those whose wavelength recurs in many spectra, with hunt_rank, best first."""
    kept = recurrent_bins(candidates(lines, c("reason")), width, least)
    return kept.withColumn("hunt_rank", c("score") / ((c("n_lines") - 1) * 0.15 + 1.0)).orderBy(F.desc("hunt_rank"), "spec_id", "pix")


def run_totals(lines: DataFrame, width: float = 2.0, least: int = 3) -> DataFrame:
    """(reason, n): how many of classified() lines each rejection took, the recurrence cut (recurrent_artifact) and the candidates (survives) included."""
    left = run_candidates(lines, width, least).agg(F.count(F.lit(1)).alias("_left"))
    counts = reasons(lines, c("reason"))
    split = F.when(c("reason") == "survives", F.array(F.struct(F.lit("survives").alias("reason"), c("_left").alias("n")), F.struct(F.lit("recurrent_artifact").alias("reason"), (c("n") - c("_left")).alias("n"))))
    rows = F.coalesce(split, F.array(F.struct("reason", "n")))
    return counts.join(F.broadcast(left), F.lit(True)).select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


def run_summary(lines: DataFrame, n_searched: DataFrame, width: float = 2.0, least: int = 3) -> DataFrame:
    """(n_searched, n_candidates, point, upper_limit): the run's occurrence limit. ``n_searched`` is a row with that number."""
    k = run_candidates(lines, width, least).agg(F.count(F.lit(1)).alias("n_candidates"))
    one = n_searched.join(F.broadcast(k), F.lit(True)).withColumn("_n", F.greatest("n_searched", F.lit(1)))
    return occurrence_limit(one, "n_candidates", "_n").select("n_searched", "n_candidates", "point", "upper_limit")


def injected(pixels: DataFrame, strengths: tuple[float, ...] = (8.0, 15.0, 50.0), sigma: float = 1.5, margin: int = 8) -> DataFrame:
    """Each spectrum once for each strength, with a Gaussian line of that matched-filter S/N at a pixel (column at) chosen by its id."""
    p = pixels.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("spec_id"))).withColumn("snr", F.explode(F.array(*map(F.lit, strengths))))
    number = F.pmod(c("spec_id"), F.lit(2147483648)) * 2654435761 + (c("snr") * 40503).cast("bigint")
    p = p.withColumn("at", (F.pmod(number, F.greatest(c("_n") - 2 * margin, F.lit(1))) + margin).cast("int"))
    own = F.max(F.when(c("pix") == c("at"), c("ivar"))).over(Window.partitionBy("spec_id", "snr"))
    amplitude = c("snr") / math.sqrt(sigma * math.sqrt(math.pi)) / F.sqrt(own)
    return p.withColumn("flux", c("flux") + amplitude * F.exp(F.pow((c("pix") - c("at")) / sigma, 2) * -0.5)).drop("_n")


def recovery(pixels: DataFrame, strengths: tuple[float, ...] = (8.0, 15.0, 50.0), sigma: float = 1.5, within: float = 2.5) -> DataFrame:
    """(snr, n, recovered): share of injected lines that the search and the classifier give back."""
    put = injected(pixels, strengths, sigma)
    found = find_lines(put, sigma, 7.0, keys=("spec_id", "snr")).filter(reject_reason().isNull()).select("spec_id", "snr", c("pix").alias("_found"))
    places = put.filter(c("pix") == c("at")).select("spec_id", "snr", "at")
    hit = places.join(found, ["spec_id", "snr"], "left").withColumn("_hit", F.coalesce(F.abs(c("_found") - c("at")) <= within, F.lit(False)))
    return hit.groupBy("spec_id", "snr").agg(F.bool_or("_hit").alias("h")).groupBy("snr").agg(F.count(F.lit(1)).alias("n"), F.avg(c("h").cast("double")).alias("recovered"))


def excess_at(pixels: DataFrame, targets: DataFrame, inner: float = 4.0, outer: float = 60.0) -> DataFrame:
    """(spec_id, wavelength, level, noise, peak, present): excess of other spectra at given wavelengths.

    targets: (spec_id, wavelength). The join is on the spectrum; only pixels in reach stay.
    """
    near = targets.join(pixels, "spec_id").withColumn("_d", F.abs(c("wave") - c("wavelength"))).filter(c("_d") <= outer)
    side = F.when(c("_d") > inner, c("flux"))
    one = near.groupBy("spec_id", "wavelength").agg(F.percentile(side, F.lit(0.5)).alias("level"), F.stddev_pop(side).alias("noise"), F.max(F.when(c("_d") <= inner, c("flux"))).alias("_top"))
    one = one.withColumn("peak", F.try_divide(c("_top") - c("level"), c("noise")))
    return one.select("spec_id", "wavelength", "level", "noise", "peak", F.coalesce(c("peak") >= 4, F.lit(False)).alias("present"))


def with_snippets(found: DataFrame, spectra: DataFrame, reach: int = 40) -> DataFrame:
    """Add win_wave and win_flux: the spectrum around each line."""
    low = F.greatest(c("pix") - reach, F.lit(0)) + 1
    size = c("pix") + reach + 2 - low
    cut = found.join(spectra.select("spec_id", "wave", "flux"), "spec_id")
    return cut.withColumns({"win_wave": F.slice("wave", low, size), "win_flux": F.slice("flux", low, size)}).drop("wave", "flux")
