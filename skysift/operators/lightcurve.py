"""Light curves: dips, fades, flashes, field controls and periodograms.

Input is a long table with source keys, mjd, mag, magerr and a tiebreak that makes the order of epochs total.
All detectors share one shuffle by the source keys: statistics of a source are window aggregates over that
partitioning, and events are gaps and islands in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.exprs import LN10_04, clip
from skysift.functions.quantiles import quantiles
from skysift.functions.tables import let_workers_import, written

c = F.col
MAD = 1.4826
#: Rows of a task that sorts epochs by source.
TASK_ROWS = 1 << 20


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def clean(df: DataFrame, keys: Sequence[str], min_epochs: int = 30) -> DataFrame:
    """Finite epochs of sources with enough of them; bad errors become the median of the source's good ones."""
    w = Window.partitionBy(*keys)
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < 1e300)
    df = df.filter(finite("mjd") & finite("mag"))
    good = F.when(finite("magerr") & (c("magerr") > 0), c("magerr"))
    df = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_e": F.percentile(good, F.lit(0.5)).over(w)}).filter(c("_n") >= min_epochs)
    return df.withColumn("magerr", F.coalesce(good, c("_e"), F.lit(0.02))).drop("_n", "_e")


def flag_dips(df: DataFrame, keys: Sequence[str], depth_min: float = 0.05, k_sigma: float = 3.0) -> DataFrame:
    """Add base (bright state), depth, sig and hit for each epoch."""
    base = F.percentile(c("mag"), F.lit(0.2)).over(Window.partitionBy(*keys))
    df = df.withColumn("base", base)
    drop = c("mag") - c("base")
    df = df.withColumns({"depth": 1.0 - F.pow(F.lit(10.0), drop * -0.4), "sig": drop / (c("magerr") * LN10_04 + 1e-9)})
    return df.withColumn("hit", (c("depth") >= depth_min) & (c("sig") >= k_sigma))


def flag_flashes(df: DataFrame, keys: Sequence[str], bright_min: float = 0.30, k_sigma: float = 5.0) -> DataFrame:
    """The same for brightenings over the median."""
    df = df.withColumn("base", F.percentile(c("mag"), F.lit(0.5)).over(Window.partitionBy(*keys)))
    rise = c("base") - c("mag")
    df = df.withColumns({"depth": F.pow(F.lit(10.0), F.greatest(rise, F.lit(0.0)) * 0.4) - 1.0, "sig": rise / (c("magerr") * LN10_04 + 1e-9)})
    return df.withColumn("hit", (c("depth") >= bright_min) & (c("sig") >= k_sigma))


def events(flagged: DataFrame, keys: Sequence[str], gap_days: float = 5.0) -> DataFrame:
    """One row for each run of flagged epochs; a run ends where an epoch isn't flagged or the gap is longer."""
    order = Window.partitionBy(*keys).orderBy("mjd", "tiebreak")
    numbered = flagged.withColumn("_row", F.row_number().over(order)).filter("hit")
    new = F.coalesce((c("_row") != F.lag("_row").over(order) + 1) | (c("mjd") - F.lag("mjd").over(order) > gap_days), F.lit(True))
    runs = numbered.withColumn("_new", new.cast("int")).withColumn("event", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "event").agg(F.min("mjd").alias("first_mjd"), F.max("mjd").alias("last_mjd"), F.count(F.lit(1)).alias("n_epochs"), F.max("depth").alias("depth"))


def quiet_rms(flagged: DataFrame, keys: Sequence[str], subtract_errors: bool = True) -> DataFrame:
    """Fractional scatter of the epochs that aren't flagged, 0 for fewer than five."""
    w = Window.partitionBy(*keys)
    q = flagged.filter(~c("hit")).withColumn("_m", F.percentile(c("mag"), F.lit(0.5)).over(w))
    q = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), median(F.abs(c("mag") - c("_m"))).alias("_mad"), F.stddev_pop("mag").alias("_std"), median(c("magerr")).alias("_err"))
    sigma = F.when(c("_mad") > 0, c("_mad") * MAD).otherwise(c("_std"))
    if subtract_errors:
        sigma = F.sqrt(F.greatest(sigma * sigma - c("_err") * c("_err"), F.lit(0.0)))
    return q.select(*keys, F.when(c("_n") >= 5, sigma * LN10_04).otherwise(0.0).alias("out_rms"))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def dip_summary(df: DataFrame, keys: Sequence[str], min_epochs: int = 30, power: DataFrame | None = None, depth_min: float = 0.05) -> DataFrame:
    """One row for each source: counts, depths, asymmetry, quietness, score. power: (keys, period_power), else 0."""
    flagged = flag_dips(clean(df, keys, min_epochs), keys, depth_min)
    flagged = flagged.withColumn("_med", F.percentile(c("mag"), F.lit(0.5)).over(Window.partitionBy(*keys)))
    faint, bright = F.greatest(c("mag") - c("_med"), F.lit(0.0)), F.greatest(c("_med") - c("mag"), F.lit(0.0))
    one = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_epochs"), F.max("depth").alias("max_depth"), F.count_if("hit").alias("n_dips"), ((F.sum(faint) + 1e-9) / (F.sum(bright) + 1e-9)).alias("asymmetry"))
    valid = events(flagged, keys).filter(c("n_epochs") >= 2).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.max("depth").alias("event_depth"))
    out = _joined(_joined(one, valid, keys), quiet_rms(flagged, keys), keys)
    out = _joined(out, power, keys) if power is not None else out.withColumn("period_power", F.lit(0.0))
    zero = F.lit(0.0)
    out = out.withColumns({"n_events": F.coalesce("n_events", F.lit(0).cast("bigint")), "event_depth": F.coalesce("event_depth", zero), "out_rms": F.coalesce("out_rms", zero), "period_power": F.coalesce("period_power", zero), "duty": c("n_dips") / c("n_epochs")})
    score = (
        clip((c("event_depth") - depth_min) / 0.15, 0.0, 1.0) * 0.34
        + clip(c("n_events") / 6.0, 0.0, 1.0) * clip((40 - c("n_events")) / 28.0, 0.0, 1.0) * 0.18
        + clip((c("asymmetry") - 1.0) / 3.0, 0.0, 1.0) * 0.18
        + clip(1.0 - c("period_power") / 0.5, 0.0, 1.0) * 0.15
        + clip(1.0 - c("out_rms") / 0.05, 0.0, 1.0) * 0.15
    )
    return out.withColumn("score", clip(score, 0.0, 1.0))


def dip_candidates(summary: DataFrame) -> DataFrame:
    """Add is_candidate."""
    return summary.withColumn("is_candidate", (c("event_depth") >= 0.10) & c("n_events").between(1, 20) & (c("n_dips") >= 3) & (c("out_rms") <= 0.05) & (c("asymmetry") >= 1.5) & (c("period_power") <= 0.4))


def flash_summary(df: DataFrame, keys: Sequence[str], min_epochs: int = 30, max_events: int = 4, bright_min: float = 0.30, k_sigma: float = 5.0) -> DataFrame:
    """One row for each source: brightest epoch, events, quietness, score (0 for none or too many events)."""
    flagged = flag_flashes(clean(df, keys, min_epochs), keys, bright_min, k_sigma)
    one = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_epochs"), F.max("depth").alias("max_brighten"), F.max("sig").alias("brighten_sigma"), F.count_if("hit").alias("n_flash_epochs"))
    n = events(flagged, keys, 2.0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_flashes"))
    out = _joined(_joined(one, n, keys), quiet_rms(flagged, keys, subtract_errors=False), keys)
    out = out.withColumns({"n_flashes": F.coalesce("n_flashes", F.lit(0).cast("bigint")), "out_rms": F.coalesce("out_rms", F.lit(0.0))})
    score = (
        clip((c("max_brighten") - bright_min) / 0.7, 0.0, 1.0) * 0.4
        + clip(c("n_flashes").cast("double"), 0.0, 1.0) * clip((max_events + 2 - c("n_flashes")) / float(max_events + 1), 0.0, 1.0) * 0.2
        + clip((c("brighten_sigma") - k_sigma) / 15.0, 0.0, 1.0) * 0.2
        + clip(1.0 - c("out_rms") / 0.06, 0.0, 1.0) * 0.2
    )
    return out.withColumn("score", F.when(c("n_flashes").between(1, max_events), clip(score, 0.0, 1.0)).otherwise(0.0))


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by keys to as many tasks as their number asks for, so that what a task sorts stays the same at any size."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
    return df.repartition(tasks, *keys)


def seasons(df: DataFrame, keys: Sequence[str], min_epochs: int = 40, min_seasons: int = 3, days: float = 180.0) -> DataFrame:
    """(keys, season, t, m, weight): medians of each source's seasons with at least three epochs."""
    w = Window.partitionBy(*keys)
    df = dealt(df.filter(c("mjd").isNotNull() & c("mag").isNotNull()).select(*keys, "mjd", "mag"), keys)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_t0": F.min("mjd").over(w)}).filter(c("_n") >= min_epochs)
    df = df.withColumn("season", F.floor((c("mjd") - c("_t0")) / days))
    df = df.withColumn("_m", F.percentile(c("mag"), F.lit(0.5)).over(Window.partitionBy(*keys, "season")))
    s = df.groupBy(*keys, "season").agg(F.count(F.lit(1)).alias("n"), median(c("mjd")).alias("t"), F.first("_m").alias("m"), (median(F.abs(c("mag") - c("_m"))) * MAD).alias("_mad"), F.stddev_pop("mag").alias("_std"))
    s = s.filter("n >= 3")
    error = F.when(c("_mad") > 0, c("_mad")).otherwise(F.when(c("_std") > 0, c("_std"))) / F.sqrt("n")
    s = s.withColumn("weight", 1.0 / F.pow(F.greatest(F.coalesce(error, F.lit(0.01)), F.lit(1e-3)), 2))
    return s.withColumn("_k", F.count(F.lit(1)).over(w)).filter(c("_k") >= min_seasons).select(*keys, "season", "n", "t", "m", "weight")


def fade_fit(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted line through season medians: slope per year, its sigma, change, monotonic share, score."""
    w = Window.partitionBy(*keys)
    s = s.withColumn("x", (c("t") - F.min("t").over(w)) / 365.25)
    S = {n: F.sum(e).over(w) for n, e in {"_w": c("weight"), "_x": c("weight") * c("x"), "_y": c("weight") * c("m"), "_xx": c("weight") * c("x") * c("x"), "_xy": c("weight") * c("x") * c("m")}.items()}
    s = s.withColumns(S).withColumn("_d", c("_w") * c("_xx") - c("_x") * c("_x")).filter(c("_d") > 0)
    s = s.withColumn("slope", (c("_w") * c("_xy") - c("_x") * c("_y")) / c("_d"))
    s = s.withColumns({"_r": c("m") - (c("_y") - c("slope") * c("_x")) / c("_w") - c("slope") * c("x"), "_step": F.signum(c("m") - F.lag("m").over(w.orderBy("season")))})
    sign = F.when(c("slope") == 0, 1.0).otherwise(F.signum("slope"))
    one = s.groupBy(*keys, "slope", (c("_w") / c("_d")).alias("_var")).agg(
        F.count(F.lit(1)).alias("n_seasons"), F.sum(c("weight") * c("_r") * c("_r")).alias("_chi2"), (F.max("x") - F.min("x")).alias("baseline_yr"),
        F.sqrt(F.avg(c("_r") * c("_r"))).alias("rms_resid"), F.avg(F.when(c("_step").isNotNull(), (c("_step") == sign).cast("double"))).alias("monotonic"),
    )
    error = F.sqrt(c("_var") * F.greatest(c("_chi2") / F.greatest(c("n_seasons") - 2, F.lit(1)), F.lit(1.0)))
    one = one.withColumns({"slope_sigma": F.abs("slope") / error, "total_change": c("slope") * c("baseline_yr"), "monotonic": F.coalesce("monotonic", F.lit(0.0))})
    score = clip((c("slope_sigma") - 3.0) / 5.0, 0.0, 1.0) * 0.4 + clip(F.abs("total_change") / 0.20, 0.0, 1.0) * 0.35 + clip((c("monotonic") - 0.5) / 0.4, 0.0, 1.0) * 0.25
    one = one.withColumn("score", F.when(c("slope") > 0, clip(score, 0.0, 1.0)).otherwise(0.0)).drop("_var", "_chi2")
    return one.withColumn("is_fader", (c("score") >= 0.5) & (c("slope_sigma") >= 4.0) & (F.abs("total_change") >= 0.08))


def fades(df: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return fade_fit(seasons(df, keys, **options), keys)


def common_mode(s: DataFrame, medians: DataFrame, keys: Sequence[str], channel: str, least: int = 5) -> DataFrame:
    """Season medians less the drift that a channel's sources share (else all sources', else none)."""
    rows = s.join(medians, list(keys)).withColumn("_off", c("m") - c("median_mag"))
    per = rows.groupBy(channel, "season").agg(median(c("_off")).alias("_own"), F.count(F.lit(1)).alias("_n")).filter(c("_n") >= least).drop("_n")
    every = rows.groupBy("season").agg(median(c("_off")).alias("_all"), F.count(F.lit(1)).alias("_n")).filter(c("_n") >= least).drop("_n")
    fixed = rows.join(per, [channel, "season"], "left").join(every, "season", "left")
    return fixed.withColumn("m", c("m") - F.coalesce("_own", "_all", F.lit(0.0))).select(*s.columns, channel)


def shared_epochs(flagged: DataFrame, keys: Sequence[str], depth_min: float = 0.10, bin_days: float = 0.5, least: int = 5, share: float = 0.02) -> DataFrame:
    """(keys, n_bins, shared_frac): share of a source's dip nights on which too many sources dip at once."""
    bins = flagged.filter(c("depth") >= depth_min).select(*keys, F.rint(c("mjd") / bin_days).cast("bigint").alias("bin")).distinct()
    n = bins.select(*keys).distinct().agg(F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) * share)).alias("limit"))
    bad = bins.groupBy("bin").agg(F.count(F.lit(1)).alias("hits")).join(F.broadcast(n), F.lit(True)).select("bin", (c("hits") >= c("limit")).alias("bad"))
    return bins.join(bad, "bin").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bins"), F.avg(c("bad").cast("double")).alias("shared_frac"))


def fractional_rms(df: DataFrame, keys: Sequence[str], min_epochs: int = 8) -> DataFrame:
    """Scatter after a four-sigma clip, less the median error in quadrature; NULL with too few epochs left."""
    w = Window.partitionBy(*keys)
    d = df.filter(c("mag").isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(w), "_m": F.percentile(c("mag"), F.lit(0.5)).over(w)})
    d = d.withColumns({"_mad": F.percentile(F.abs(c("mag") - c("_m")), F.lit(0.5)).over(w) * MAD, "_std": F.stddev_pop("mag").over(w)})
    sigma = F.when(c("_mad") > 0, c("_mad")).otherwise(c("_std"))
    kept = (c("_n") >= min_epochs) & ((sigma == 0) | (F.abs(c("mag") - c("_m")) <= sigma * 4.0))
    one = d.withColumn("_k", kept).groupBy(*keys).agg(F.count_if("_k").alias("n_kept"), F.stddev_samp(F.when(c("_k"), c("mag"))).alias("_s"), median(F.when(c("_k"), c("magerr"))).alias("_e"))
    rms = F.sqrt(F.greatest(c("_s") * c("_s") - F.coalesce(c("_e") * c("_e"), F.lit(0.0)), F.lit(0.0))) * LN10_04
    return one.select(*keys, "n_kept", F.when(c("n_kept") >= min_epochs, rms).alias("frac_rms"))


def relative_magnitude(df: DataFrame, keys: Sequence[str], flux: str = "flux") -> DataFrame:
    """Positive fluxes as magnitudes relative to the source's median flux."""
    df = df.filter(c(flux) > 0)
    return df.withColumn("mag", F.log10(c(flux) / F.percentile(c(flux), F.lit(0.5)).over(Window.partitionBy(*keys))) * -2.5)


def band_coincidence(flagged: DataFrame, source: str = "source_id", band: str = "band", days: float = 2.0, bands: Sequence[str] = ()) -> DataFrame:
    """Share of the dips in a source's reference band (the one with most) that another band confirms within days.

    Of bands with as many dips the first of ``bands`` is the reference, or the last by name.

    Dips are dealt into bins of that width, so the interval join is an equi-join on neighbouring bins.
    """
    dips = flagged.filter("hit").select(source, band, "mjd", "tiebreak")
    counts = dips.groupBy(source, band).agg(F.count(F.lit(1)).alias("n"))
    ref = counts.groupBy(source).agg(F.max_by(c(band), F.struct(c("n"), -F.array_position(F.array(*map(F.lit, bands)), c(band)) if bands else F.lit(0), c(band))).alias("ref_band"), F.max("n").alias("n_ref"))
    d = dips.join(ref, source).withColumn("bin", F.floor(c("mjd") / days))
    own = d.filter(c(band) == c("ref_band")).select(source, "ref_band", "n_ref", "mjd", "tiebreak", F.explode(F.array(c("bin") - 1, c("bin"), c("bin") + 1)).alias("bin"))
    other = d.filter(c(band) != c("ref_band")).select(source, "bin", c("mjd").alias("mjd2"))
    met = own.join(other, [source, "bin"]).filter(F.abs(c("mjd") - c("mjd2")) <= days).select(source, "tiebreak").distinct().groupBy(source).agg(F.count(F.lit(1)).alias("n_met"))
    return ref.join(met, source, "left").select(source, "ref_band", "n_ref", (F.coalesce("n_met", F.lit(0)) / c("n_ref")).alias("coincident"))


def fade_colours(band_fades: DataFrame, source: str = "source_id", bands: tuple[str, str] = ("g", "r")) -> DataFrame:
    """Whether a fade has the same sense and strength in two bands: (source, slopes, achromatic)."""
    a, b = bands
    p = band_fades.groupBy(source).pivot("band", list(bands)).agg(F.first("slope").alias("slope"), F.first("slope_sigma").alias("sigma"))
    up = (c(f"{a}_slope") > 0) & (c(f"{b}_slope") > 0) & (c(f"{a}_sigma") > 2) & (c(f"{b}_sigma") > 2)
    ratio = F.greatest(f"{a}_slope", f"{b}_slope") / F.greatest(F.least(f"{a}_slope", f"{b}_slope"), F.lit(1e-4))
    return p.select(source, c(f"{a}_slope"), c(f"{b}_slope"), F.when(c(f"{a}_slope").isNotNull() & c(f"{b}_slope").isNotNull(), up & (ratio < 3)).alias("achromatic"))


def flash_colours(df: DataFrame, source: str = "source_id", bands: tuple[str, str] = ("g", "r"), days: float = 1.0) -> DataFrame:
    """Brightest epoch of two bands: together within days, both bright and alike in amplitude."""
    a, b = bands
    med = F.percentile(c("mag"), F.lit(0.5))
    one = df.groupBy(source, "band").agg(F.min("mag").alias("_min"), med.alias("_med"), F.min_by("mjd", F.struct("mag", "mjd")).alias("at"))
    one = one.withColumn("amp", F.pow(F.lit(10.0), (c("_med") - c("_min")) * 0.4) - 1.0)
    p = one.groupBy(source).pivot("band", list(bands)).agg(F.first("at").alias("at"), F.first("amp").alias("amp"))
    ratio = F.greatest(f"{a}_amp", f"{b}_amp") / F.greatest(F.least(f"{a}_amp", f"{b}_amp"), F.lit(1e-4))
    ok = (F.abs(c(f"{a}_at") - c(f"{b}_at")) <= days) & (c(f"{a}_amp") >= 0.25) & (c(f"{b}_amp") >= 0.25) & (ratio < 2)
    return p.select(source, f"{a}_amp", f"{b}_amp", F.coalesce(ok, F.lit(False)).alias("achromatic"))


def trig_sums(t: np.ndarray, y: np.ndarray, weight: np.ndarray, freq: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Sums over epochs that a periodogram is made of, six rows: w cos, w sin, w y cos, w y sin, w cos cos, w cos sin. Sums of parts add up.

    ``freq`` are evenly spaced. A phase is that of its chunk's first frequency plus that of its place in the chunk, so that sines are
    taken for one chunk and for the chunks' beginnings, and products of matrices give the rest.
    """
    step = (freq[-1] - freq[0]) / max(len(freq) - 1, 1)
    inside, begins = step * np.arange(min(chunk, len(freq))), freq[::chunk]
    wave, double = (np.zeros((len(inside), k * len(begins)), dtype=complex) for k in (2, 1))
    for at in range(0, len(t), chunk):
        s, w, wy = (x[at : at + chunk] for x in (t, weight, weight * y))
        turn = np.exp(2j * np.pi * s[:, None] * begins)
        place = np.exp(2j * np.pi * inside[:, None] * s)
        wave += place @ np.concatenate([turn * w[:, None], turn * wy[:, None]], axis=1)
        double += (place * place) @ (turn * turn * w[:, None])
    one, two, twice = (x.T.reshape(-1)[: len(freq)] for x in (wave[:, : len(begins)], wave[:, len(begins) :], double))
    return np.stack([one.real, one.imag, two.real, two.imag, (weight.sum() + twice.real) / 2, twice.imag / 2])


def sinusoid(sums: np.ndarray, w: float, wy: float, wyy: float) -> tuple[np.ndarray, np.ndarray]:
    """Floating-mean power (1 is a perfect sinusoid) and amplitude at each frequency, from trig_sums() and the sums of w, w y and w y y."""
    mean, yy = wy / w, wyy / w - (wy / w) ** 2
    mc, ms, yc, ys, c2, cs = sums / w
    yc, ys, cc, ss, cs = yc - mean * mc, ys - mean * ms, c2 - mc**2, 1 - c2 - ms**2, cs - mc * ms
    d = cc * ss - cs**2
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (yc * ss - ys * cs) / d, (ys * cc - yc * cs) / d
        return np.where(d > 1e-12, (a * yc + b * ys) / yy, 0.0), np.where(d > 1e-12, np.hypot(a, b), 0.0)


def lomb_scargle(t: np.ndarray, y: np.ndarray, weight: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floating-mean power and amplitude at each frequency."""
    y = y - (weight * y).sum() / weight.sum()
    return sinusoid(trig_sums(t - t.min(), y, weight, freq), weight.sum(), (weight * y).sum(), (weight * y * y).sum())


def grid(span: float, slowest: float, fastest: float = 0.1, per_peak: int = 5) -> np.ndarray:
    low, step = 1.0 / min(span / 2, slowest), 1.0 / span / per_peak
    return low + step * np.arange(1 + int(round((1.0 / fastest - low) / step)))


def false_alarm(power: float, n: int, fastest: float, t: np.ndarray, weight: np.ndarray) -> float:
    """Upper bound on the chance that noise alone peaks so high up to a frequency (extreme-value theory of the periodogram)."""
    w = weight / weight.sum()
    return noise_peak(power, n, fastest, (w * t * t).sum() - (w * t).sum() ** 2)


def noise_peak(power: float, n: int, fastest: float, spread: float) -> float:
    """false_alarm() from the weighted variance of the times."""
    from math import exp, lgamma, pi, sqrt

    nh, nk = n - 1, n - 3
    if power >= 1:
        return 0.0
    single = (1 - power) ** (0.5 * nk)
    gamma = sqrt(2 / nh) * exp(lgamma(nh / 2) - lgamma((nh - 1) / 2))
    tau = gamma * fastest * sqrt(4 * pi * spread) * (1 - power) ** (0.5 * (nk - 1)) * sqrt(0.5 * nh * power)
    return float(1 - (1 - single) * exp(-tau))


#: A source of up to so many epochs is one group. The periodogram of one with more is built up from sums over parts of its epochs.
WHOLE = 20_000
#: Frequencies whose sums travel together, and into how many parts the merging of a source's sums is dealt at first.
BLOCK, PARTS = 512, 32
#: A task holds the sums of so many large sources at a time.
HELD = 16


def _large(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of sources that are one group, and those of sources with more epochs (None if there are none)."""
    let_workers_import(df.sparkSession)
    big = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > WHOLE).select(*keys))
    if big.isEmpty():
        return df, None
    return df.join(big, list(keys), "left_anti"), df.join(big, list(keys), "left_semi")


def _level(df: DataFrame, keys: Sequence[str], column: str, at: float, name: str) -> DataFrame:
    """Rows with a quantile of their source's values, found by distributed selection."""
    level = written(quantiles(df, keys, column, [at]).select(*keys, c("q")[0].alias(name)))
    return df.join(level, list(keys), "left")


def _clean_large(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """clean() of sources with very many epochs."""
    finite = lambda x: c(x).isNotNull() & ~F.isnan(x) & (F.abs(c(x)) < 1e300)
    df = written(df.filter(finite("mjd") & finite("mag")).withColumn("_good", F.when(finite("magerr") & (c("magerr") > 0), c("magerr"))))
    return _level(df, keys, "_good", 0.5, "_e").withColumn("magerr", F.coalesce("_good", "_e", F.lit(0.02))).drop("_good", "_e")


def _peaks(rows: DataFrame, keys: Sequence[str], slowest: float, peak, found: str) -> DataFrame:
    """For sources with very many epochs, the best of ``peak(freq, power, amplitude, n, spread, fastest)`` over blocks of frequencies.

    rows: (keys, mjd, y, w). Each task adds up the sums of the epochs that it has; these are merged by block of frequencies.
    ``peak`` returns a frame with the columns ``found``, of which each source's row of the largest ``rank`` is taken.
    """
    names, types = list(keys), dict(rows.dtypes)
    sums = {"n": F.count(F.lit(1)), "t0": F.min("mjd"), "span": F.max("mjd") - F.min("mjd"), "sw": F.sum("w"), "swy": F.sum(c("w") * c("y")), "swyy": F.sum(c("w") * c("y") * c("y")), "swt": F.sum(c("w") * c("mjd")), "swtt": F.sum(c("w") * c("mjd") * c("mjd"))}
    one = written(rows.groupBy(*names).agg(*(x.alias(k) for k, x in sums.items())))
    schema = ", ".join(f"{k} {types[k]}" for k in names)
    cells = ", ".join(f"s{i} array<double>" for i in range(6))

    def partial(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() % PARTS, {}

        def out():
            for key, total in held.items():
                blocks = range(0, total.shape[1], BLOCK)
                yield pd.DataFrame([(*key, part, at // BLOCK, *total[:, at : at + BLOCK]) for at in blocks], columns=[*names, "part", "block", *(f"s{i}" for i in range(6))])
            held.clear()

        for batch in batches:
            for key, some in batch.groupby(names, sort=False):
                freq = grid(some["span"].iloc[0], slowest)
                mean = some["swy"].iloc[0] / some["sw"].iloc[0]
                got = trig_sums((some["mjd"] - some["t0"]).to_numpy(), some["y"].to_numpy() - mean, some["w"].to_numpy(), freq)
                held[key] = held[key] + got if key in held else got
                if len(held) > HELD:
                    yield from out()
        yield from out()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(**{f"s{i}": [np.sum(np.stack(pdf[f"s{i}"]), axis=0)] for i in range(6)})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        r, total = pdf.iloc[0], merged(pdf)
        freq = grid(r["span"], slowest)
        here = freq[r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
        mean = r["swy"] / r["sw"]
        power, amplitude = sinusoid(np.stack([total[f"s{i}"].iloc[0] for i in range(6)]), r["sw"], 0.0, r["swyy"] - r["sw"] * mean * mean)
        rows = peak(here, power, amplitude, int(r["n"]), r["swtt"] / r["sw"] - (r["swt"] / r["sw"]) ** 2, freq[-1])
        return pd.concat([pd.concat([pdf[names].head(1)] * len(rows), ignore_index=True), rows], axis=1)

    fine = one.filter((c("span") > 0) & (c("sw") > 0))
    parts = rows.join(fine.select(*names, "t0", "span", "sw", "swy"), names).mapInPandas(partial, f"{schema}, part int, block int, {cells}")
    once = parts.groupBy(*names, "part", "block").applyInPandas(merged, f"{schema}, part int, block int, {cells}")
    blocks = once.join(fine, names).groupBy(*names, "block").applyInPandas(best, f"{schema}, {found}, rank double, freq double, kind string")
    return written(blocks)


def dip_periods(df: DataFrame, keys: Sequence[str], min_epochs: int = 30) -> DataFrame:
    """(keys, best_period, period_power) of the dips; power 0 where there is nothing to fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mjd", "y"])
        t, y = pdf["mjd"].to_numpy(), pdf["y"].to_numpy()
        best, power = None, 0.0
        if len(t) >= min_epochs and np.ptp(t) >= 4 and y.any():
            freq = grid(np.ptp(t), 200.0)
            p, _ = lomb_scargle(t, y, np.ones(len(t)), freq)
            best, power = 1.0 / freq[p.argmax()], p.max()
        return pdf[list(keys)].head(1).assign(best_period=best, period_power=power)

    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    depth = F.greatest("depth", F.lit(0.0)).alias("y")
    small, large = _large(df, keys)
    flagged = flag_dips(clean(small, keys, min_epochs), keys).select(*keys, "mjd", depth)
    out = flagged.groupBy(*keys).applyInPandas(run, f"{schema}, best_period double, period_power double")
    if large is None:
        return out

    def peak(freq, power, amplitude, n, spread, fastest):
        i = power.argmax()
        return pd.DataFrame({"power": [power[i]], "rank": [power[i]], "freq": [freq[i]], "kind": [""]})

    rows = _level(_clean_large(large, keys), keys, "mag", 0.2, "base")
    rows = written(rows.select(*keys, "mjd", F.greatest(1.0 - F.pow(F.lit(10.0), (c("mag") - c("base")) * -0.4), F.lit(0.0)).alias("y"), F.lit(1.0).alias("w")))
    fit = rows.groupBy(*keys).agg((F.max("y") > 0).alias("_any"), (F.max("mjd") - F.min("mjd") >= 4).alias("_long"))
    found = _peaks(rows.join(fit.filter("_any AND _long").select(*keys), list(keys), "left_semi"), keys, 200.0, peak, "power double")
    top = found.groupBy(*keys).agg(F.max_by(F.struct("freq", "power"), F.struct("rank", -c("freq"))).alias("b"))
    wide = fit.select(*keys).join(top, list(keys), "left")
    return out.union(wide.select(*keys, (1.0 / c("b.freq")).alias("best_period"), F.coalesce("b.power", F.lit(0.0)).alias("period_power")))


def _days_apart(freq: np.ndarray) -> np.ndarray:
    """Distance of frequencies from the nearest whole number of cycles in a solar or sidereal day."""
    return np.minimum(np.abs(freq - np.maximum(1, np.rint(freq))), np.abs(freq - np.maximum(1, np.rint(freq / 1.0027379)) * 1.0027379))


def periods(df: DataFrame, keys: Sequence[str], min_epochs: int = 20, tolerance: float = 0.02) -> DataFrame:
    """(keys, period, power, fap, amplitude, alias) with peaks at multiples of the day masked; NULL with few epochs."""

    def run(table: pa.Table) -> pa.Table:
        t, m, e = (table.column(x).to_numpy().astype(float) for x in ("mjd", "mag", "magerr"))
        order = np.lexsort((m, t))
        t, m, e = t[order], m[order], e[order]
        found, alias = [None] * 4, False
        if len(t) >= min_epochs and np.ptp(t) >= 0.2 and m.std() != 0:
            freq, weight = grid(np.ptp(t), 100.0), 1.0 / e**2
            p, amp = lomb_scargle(t, m, weight, freq)
            days = _days_apart(freq)
            i = np.where(days < tolerance, -1.0, p).argmax()
            found, alias = [1.0 / freq[i], p[i], false_alarm(p[i], len(t), freq.max(), t - t.min(), weight), amp[i]], bool(days[p.argmax()] < tolerance)
        columns = [*table.select(list(keys)).slice(0, 1).columns, *(pa.array([x], pa.float64()) for x in found), pa.array([alias])]
        return pa.Table.from_arrays(columns, names=[*keys, "period", "power", "fap", "amplitude", "alias"])

    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    small, large = _large(df, keys)
    rows = clean(small, keys, 1).select(*keys, "mjd", "mag", "magerr")
    out = rows.groupBy(*keys).applyInArrow(run, f"{schema}, period double, power double, fap double, amplitude double, alias boolean")
    if large is None:
        return out

    def peak(freq, power, amplitude, n, spread, fastest):
        masked = np.where(_days_apart(freq) < tolerance, -1.0, power)
        at = [masked.argmax(), power.argmax()]
        fap = [noise_peak(power[i], n, fastest, spread) for i in at]
        return pd.DataFrame({"power": power[at], "fap": fap, "amplitude": amplitude[at], "rank": [masked[at[0]], power[at[1]]], "freq": freq[at], "kind": ["own", "any"]})

    rows = written(_clean_large(large, keys).select(*keys, "mjd", c("mag").alias("y"), F.pow("magerr", F.lit(-2.0)).alias("w")))
    fit = rows.groupBy(*keys).agg((F.max("y") > F.min("y")).alias("_any"), (F.max("mjd") - F.min("mjd") >= 0.2).alias("_long"))
    found = _peaks(rows.join(fit.filter("_any AND _long").select(*keys), list(keys), "left_semi"), keys, 100.0, peak, "power double, fap double, amplitude double")
    top = lambda kind: found.filter(c("kind") == kind).groupBy(*keys).agg(F.max_by(F.struct("freq", "power", "fap", "amplitude"), F.struct("rank", -c("freq"))).alias(kind))
    wide = fit.select(*keys).join(top("own"), list(keys), "left").join(top("any"), list(keys), "left")
    f = c("any.freq")
    near = lambda day: F.abs(f - F.greatest(F.rint(f / day), F.lit(1.0)) * day) < tolerance
    wide = wide.select(*keys, (1.0 / c("own.freq")).alias("period"), "own.power", "own.fap", "own.amplitude", F.coalesce(near(1.0) | near(1.0027379), F.lit(False)).alias("alias"))
    return out.union(wide)


def variability_table(curves: DataFrame, shortlist: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, n_epochs, frac_rms, period, power, fap, amplitude, alias) of the listed sources that have epochs."""
    epochs = written(curves.join(shortlist.select(key).distinct(), key, "left_semi"))
    n = epochs.groupBy(key).agg(F.count_if(F.abs("mag") < float("inf")).alias("n_epochs"))
    rms = fractional_rms(epochs, [key]).select(key, "frac_rms")
    return n.join(rms, key, "left").join(periods(epochs, [key]), key, "left").withColumn("alias", F.coalesce("alias", F.lit(False)))


def search(df: DataFrame, keys: Sequence[str], power: DataFrame | None = None) -> DataFrame:
    """All three detectors, one row for each source that any of them takes: structs dips, fade and flash."""
    parts = {"dips": dip_candidates(dip_summary(df, keys, power=power)), "fade": fades(df, keys), "flash": flash_summary(df, keys)}
    out = None
    for name, part in parts.items():
        packed = part.select(*keys, F.struct(*(x for x in part.columns if x not in keys)).alias(name))
        out = packed if out is None else out.join(packed, list(keys), "full")
    return out


def field_candidates(found: DataFrame, shared: DataFrame, keys: Sequence[str], least: int = 10, most_shared: float = 0.5) -> DataFrame:
    """Add is_candidate: a dip candidate whose dips mostly fall on nights of its own. Fields of fewer than least sources aren't controlled."""
    n = found.agg(F.count(F.lit(1)).alias("_sources"))
    d = found.join(shared, list(keys), "left").join(F.broadcast(n), F.lit(True))
    shared_night = (c("_sources") >= least) & (F.coalesce("shared_frac", F.lit(0.0)) >= most_shared)
    return d.withColumn("is_candidate", F.coalesce(c("dips.is_candidate"), F.lit(False)) & ~shared_night).drop("_sources")
