"""Independent anomaly axes and their combination.

An axis is a function from parameters to (score, flag, available) columns; users may add their own to the
registry, and everything stays one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions import exprs as X
from skysift.params import DEFAULT, Params

c = F.col
Axis = tuple[Column, Column, Column]


def predicted_uv(band: str) -> Column:
    return c("sed_scale") * X.model_jy(c("teff"), band)


def uv_deficit_sigma(p: Params) -> Column:
    """The larger deficit of the two bands in units of its error."""
    deficits = []
    for band in ("NUV", "FUV"):
        observed, predicted = X.flux_jy(c(f"{band}mag"), band), predicted_uv(band)
        error = F.coalesce(X.flux_error_jy(c(f"{band}mag"), c(f"e_{band}mag"), band), observed * 0.2)
        deficits.append((predicted - observed) / F.hypot(error, predicted * p.uv_sys_frac))
    return F.greatest(*deficits)


def nuv_deficit() -> Column:
    predicted = predicted_uv("NUV")
    return X.clip(F.try_divide(predicted - X.flux_jy(c("NUVmag"), "NUV"), predicted), 0.0, 1.0)


def ir_excess(p: Params) -> Axis:
    return X.logistic(c("chi_W2"), 5.0, 2.0), c("has_excess"), c("chi_W2").isNotNull()


def uv_deficit(p: Params) -> Axis:
    s = uv_deficit_sigma(p)
    return X.logistic(s, p.uv_sigma_min, 1.5), s >= p.uv_sigma_min, s.isNotNull()


def energy_balance(p: Params) -> Axis:
    ratio = F.try_divide(nuv_deficit(), c("tau"))
    flag = ratio.between(p.balance_lo, p.balance_hi) & (c("tau") >= p.balance_min) & (nuv_deficit() >= p.balance_min)
    return F.when(ratio > 0, X.clip(1.0 - F.abs(F.log10(ratio)), 0.0, 1.0)), flag, ratio.isNotNull()


def periodicity(p: Params) -> Axis:
    fap = c("ztf_ls_fap")
    score = F.when(fap > 0, X.logistic(-F.log10(fap), 3.0, 1.0))
    return score, (fap <= p.fap_max) & (c("ztf_ls_amp_mag") >= p.ls_amp_min), fap.isNotNull()


def optical_variability(p: Params) -> Axis:
    rms, named = c("ztf_frac_rms"), F.coalesce(F.upper("phot_variable_flag").startswith("VARIABLE"), F.lit(False))
    score = F.coalesce(X.logistic(rms, p.optical_rms_min, p.optical_rms_min), F.when(named, 0.6))
    return score, X.true_or_false(rms >= p.optical_rms_min) | named, rms.isNotNull() | named


def ir_variability(p: Params) -> Axis:
    rms = c("neowise_w1_frac_rms")
    return X.logistic(rms, p.ir_rms_min, p.ir_rms_min), rms >= p.ir_rms_min, rms.isNotNull()


def tangential_speed() -> Column:
    return F.when(c("parallax") > 0, F.hypot("pmra", "pmdec") * 4.74 / c("parallax"))


def kinematic(p: Params) -> Axis:
    v = tangential_speed()
    return X.logistic(v, p.vtan_hi, 60.0), v >= p.vtan_hi, v.isNotNull()


#: Names, axes and weights in the order of the suite.
SUITE: tuple[tuple[str, Callable[[Params], Axis], float], ...] = (
    ("ir_excess", ir_excess, 1.0),
    ("uv_deficit", uv_deficit, 1.5),
    ("energy_balance", energy_balance, 3.0),
    ("periodicity", periodicity, 2.5),
    ("optical_variability", optical_variability, 2.0),
    ("ir_variability", ir_variability, 2.0),
    ("kinematic", kinematic, 0.3),
)


def evaluate(df: DataFrame, p: Params = DEFAULT, suite: tuple = SUITE) -> DataFrame:
    """Add a struct (score, flag, available) for each axis."""
    made = {}
    for name, axis, _ in suite:
        score, flag, available = axis(p)
        made[name] = F.struct(score.alias("score"), X.true_or_false(flag).alias("flag"), X.true_or_false(available).alias("available"))
    return df.withColumns(made)


def combine(df: DataFrame, p: Params = DEFAULT, suite: tuple = SUITE) -> DataFrame:
    """Add n_axes, axes_flagged, multimodal_score (an absent axis counts as 0) and multimodal_candidate."""
    total = sum(w for _, _, w in suite)
    flags = F.array_compact(F.array(*(F.when(c(f"{n}.flag"), F.lit(n)) for n, _, _ in suite)))
    score = sum((F.coalesce(c(f"{n}.score"), F.lit(0.0)) * w for n, _, w in suite), F.lit(0.0)) / total
    df = df.withColumn("_flags", flags)
    return df.withColumns({"n_axes": F.size("_flags"), "axes_flagged": F.array_join("_flags", ","), "multimodal_score": score, "multimodal_candidate": F.size("_flags") >= p.min_axes}).drop("_flags")


def summary(combined: DataFrame, suite: tuple = SUITE) -> DataFrame:
    """(axis, n_flagged, n_available) and the counts of objects on two or three axes, from one aggregate."""
    one = combined.agg(
        *(F.count_if(f"{n}.flag").alias(f"f_{n}") for n, _, _ in suite), *(F.count_if(f"{n}.available").alias(f"a_{n}") for n, _, _ in suite),
        F.count_if(c("n_axes") >= 2).alias("two"), F.count_if(c("n_axes") >= 3).alias("three"), F.count(F.lit(1)).alias("n"),
    )
    rows = [F.struct(F.lit(n).alias("axis"), c(f"f_{n}").alias("n_flagged"), c(f"a_{n}").alias("n_available")) for n, _, _ in suite]
    rows += [F.struct(F.lit(n).alias("axis"), c(k).alias("n_flagged"), c("n").alias("n_available")) for n, k in (("two_or_more", "two"), ("three_or_more", "three"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
