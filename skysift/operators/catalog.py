"""Catalogue tables: photosphere fit, infrared excess, contamination funnel, dust and anomaly score.

One narrow plan up to the counts: every step adds columns. Missing values are NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.quantiles import quantiles
from skysift.functions import exprs as X
from skysift.params import DEFAULT, Params

c = F.col
#: Temperatures tried for the dust, from coldest to hottest.
DUST_GRID, DUST_LOW, DUST_HIGH = 600, 80.0, 2500.0


def fit_scale(bands: tuple[str, ...], teff: Column) -> Column:
    """Weighted least-squares scale of a black body over the bands that are present; NULL if none is."""
    num = den = F.lit(0.0)
    for b in bands:
        mag, error = c(f"{b}mag"), F.coalesce(c(f"e_{b}mag"), F.lit(0.05))
        flux, model = X.flux_jy(mag, b), X.model_jy(teff, b)
        weight = F.try_divide(F.lit(1.0), F.pow(X.flux_error_jy(mag, error, b), 2))
        num = num + F.coalesce(weight * flux * model, F.lit(0.0))
        den = den + F.coalesce(weight * model * model, F.lit(0.0))
    return F.when(den > 0, num / den)


def predict(df: DataFrame, anchors: tuple[str, ...] = ("J", "H", "Ks"), fallback: tuple[str, ...] = ("RP", "BP", "G")) -> DataFrame:
    """Add sed_scale, sed_anchor and predicted flux and magnitude in W1 and W2."""
    df = X.held(df, {"_near": fit_scale(anchors, c("teff")), "_wide": fit_scale(fallback, c("teff"))})
    df = df.withColumns({"sed_scale": F.coalesce("_near", "_wide"), "sed_anchor": F.when(c("_near").isNotNull(), "nir").when(c("_wide").isNotNull(), "gaia").otherwise("none")}).drop("_near", "_wide")
    df = X.held(df, {f"{b}_pred_jy": c("sed_scale") * X.model_jy(c("teff"), b) for b in ("W1", "W2")})
    return df.withColumns({f"{b}_pred_mag": X.magnitude(c(f"{b}_pred_jy"), b) for b in ("W1", "W2")})


def excess(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add observed and excess fluxes, their significances, and has_excess."""
    floor = X.LN10_04 * p.sys_floor_mag
    error = {b: F.coalesce(c(f"e_{b}mag"), F.lit(0.1)) for b in ("W1", "W2")}
    df = df.withColumns({f"{b}_obs_jy": X.flux_jy(c(f"{b}mag"), b) for b in error})
    df = df.withColumns({f"{b}_excess_jy": c(f"{b}_obs_jy") - c(f"{b}_pred_jy") for b in error})
    sigma = {b: F.hypot(X.flux_error_jy(c(f"{b}mag"), e, b), F.abs(c(f"{b}_pred_jy")) * floor) for b, e in error.items()}
    df = X.held(df, {f"chi_{b}": F.try_divide(c(f"{b}_excess_jy"), s) for b, s in sigma.items()})
    colour = (c("W1mag") - c("W2mag")) - (c("W1_pred_mag") - c("W2_pred_mag"))
    df = df.withColumn("color_excess", colour)
    df = df.withColumn("chi_color", c("color_excess") / F.sqrt(error["W1"] * error["W1"] + error["W2"] * error["W2"] + F.lit(2 * p.sys_floor_mag**2)))
    chosen = ((c("chi_W1") >= p.chi_w1_min) | (c("chi_W2") >= p.chi_w2_min)) & (c("W2_excess_jy") > 0) & (c("chi_color") >= p.chi_color_min)
    return df.withColumn("has_excess", X.true_or_false(chosen))


def _first_index(holds: Callable[[Column], Column], known: Column) -> Column:
    """The first index of the dust grid from which a condition holds, by bisection; DUST_GRID if it never does, NULL where known is NULL."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(DUST_GRID).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        ok = holds(mid)
        return F.when(s.lo >= s.hi, s).otherwise(F.struct(F.when(ok, s.lo).otherwise(mid + 1).alias("lo"), F.when(ok, mid).otherwise(s.hi).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(DUST_GRID.bit_length())), start, step, lambda s: s.lo)
    return F.when(known.isNotNull(), found)


def dust(df: DataFrame) -> DataFrame:
    """Add t_dust_k and tau, from the ratio of the two excess fluxes; NULL unless both are positive."""
    f1, f2 = c("W1_excess_jy"), c("W2_excess_jy")
    step = (DUST_HIGH - DUST_LOW) / (DUST_GRID - 1)
    t_of = lambda i: i * step + DUST_LOW
    ratio = lambda i: X.planck(t_of(i), "W1") / X.planck(t_of(i), "W2")
    df = X.held(df, {"_want": F.when((f1 > 0) & (f2 > 0), f1 / f2)})
    gap = lambda i: F.abs(ratio(i) - c("_want"))
    # the ratio grows with the temperature: the nearest one stands at either side of the place where it passes
    df = X.held(df, {"_past": _first_index(lambda i: ratio(i) > c("_want"), c("_want"))})
    below, above = F.greatest(c("_past") - 1, F.lit(0)), F.least(c("_past"), F.lit(DUST_GRID - 1))
    df = X.held(df, {"_gap": F.least(gap(below), gap(above))})
    # equal gaps: the coldest
    best = t_of(_first_index(lambda i: (i >= c("_past")) | (gap(i) <= c("_gap")), c("_want")))
    df = X.held(df, {"t_dust_k": F.when(F.isnan("_want") | (c("_want") == float("inf")), F.lit(DUST_LOW)).when(c("_want").isNotNull(), best)}).drop("_want", "_past", "_gap")
    omega = f1 / X.model_jy(c("t_dust_k"), "W1")
    return X.held(df, {"tau": F.when(c("sed_scale") > 0, F.try_divide(omega * F.pow("t_dust_k", 4), c("sed_scale") * F.pow("teff", 4)))})


def astrometry_ok(p: Params) -> Column:
    """Missing figures pass."""
    cuts = [c("ruwe") <= p.ruwe_max, c("parallax_over_error") >= p.parallax_snr_min, c("astrometric_excess_noise") <= p.excess_noise_max]
    return F.coalesce(cuts[0], F.lit(True)) & F.coalesce(cuts[1], F.lit(True)) & F.coalesce(cuts[2], F.lit(True))


def w2_snr() -> Column:
    return F.try_divide(F.lit(1.0), c("e_W2mag") * X.LN10_04)


def photometry_ok(p: Params) -> Column:
    good = ("A", "B")
    ok = (F.substring("cc_flags", 1, 2) == "00") & F.substring("ph_qual", 1, 1).isin(*good) & F.substring("ph_qual", 2, 1).isin(*good)
    ok = ok & (c("ext_flg") <= p.ext_flag_max) & (c("W1mag") >= p.w1_saturation) & (F.coalesce(w2_snr(), F.lit(99.0)) >= p.w2_snr_min)
    return X.true_or_false(ok)


def crowding_ok(p: Params) -> Column:
    agree = F.coalesce(F.abs(c("W1mag") - c("W1mag_unwise")) * X.LN10_04 <= p.unwise_frac_max, F.lit(True))
    return X.true_or_false((c("n_wise_neighbours") <= p.max_neighbours) & (F.coalesce(c("gaia_nn_arcsec"), F.lit(1e9)) >= p.neighbour_radius) & agree)


def wise_offset(p: Params) -> Column:
    """Arcsec between the optical position at the infrared epoch and the infrared position."""
    dt = p.epoch_infrared - p.epoch_optical
    east = (c("ra_wise") - c("ra")) * 3.6e6 * F.cos(F.radians("dec")) - c("pmra") * dt
    north = (c("dec_wise") - c("dec")) * 3.6e6 - c("pmdec") * dt
    return F.hypot(east, north) / 1000.0


def pm_sigma() -> Column:
    """Difference of proper motions in units of its error."""
    east = (c("pmra") - c("pmra_wise")) / F.hypot(F.coalesce(c("pmra_error"), F.lit(1.0)), F.coalesce(c("e_pmra_wise"), F.lit(50.0)))
    north = (c("pmdec") - c("pmdec_wise")) / F.hypot(F.coalesce(c("pmdec_error"), F.lit(1.0)), F.coalesce(c("e_pmdec_wise"), F.lit(50.0)))
    return F.hypot(east, north)


def comoving_ok(p: Params) -> Column:
    return X.true_or_false(wise_offset(p) <= p.offset_max) & F.coalesce(pm_sigma() <= p.pm_sigma_max, F.lit(True))


def galactic_ok(p: Params) -> Column:
    return X.true_or_false(c("W1mag") - c("W2mag") < p.agn_colour) & ~F.coalesce(c("is_qso"), F.lit(False))


#: The funnel's stages in order; users may pass their own.
FUNNEL: tuple[tuple[str, Callable[[Params], Column]], ...] = (
    ("astrometry", astrometry_ok),
    ("wise_quality", photometry_ok),
    ("crowding", crowding_ok),
    ("comovement", comoving_ok),
    ("extragalactic", galactic_ok),
)


def funnel(df: DataFrame, p: Params = DEFAULT, stages: tuple = FUNNEL) -> DataFrame:
    """Add reject_reason (the first stage that fails, or empty) and clean."""
    reason = F.lit("")
    for name, ok in reversed(stages):
        reason = F.when(~ok(p), F.lit(name)).otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("clean", c("reject_reason") == "")


def funnel_counts(df: DataFrame, stages: tuple = FUNNEL) -> DataFrame:
    """(step, stage, n): survivors after each stage, from one aggregate."""
    names = [name for name, _ in stages]
    place = F.coalesce(F.array_position(F.array(*map(F.lit, names)), c("reject_reason")), F.lit(0))
    left = [F.count(F.lit(1)).alias("n0"), *(F.count_if((place == 0) | (place > i + 1)).alias(f"n{i + 1}") for i in range(len(names)))]
    one = df.agg(*left)
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), c(f"n{i}").alias("n")) for i, s in enumerate(["input", *names])))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def diagnostics(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quantiles of the co-movement figures and failures of each of its tests."""
    d = df.select(wise_offset(p).alias("offset"), pm_sigma().alias("pm"))
    failed = d.agg(F.count_if(c("offset") > p.offset_max).alias("fail_offset"), F.count_if(c("pm") > p.pm_sigma_max).alias("fail_pm"))
    for name in ("offset", "pm"):
        q = quantiles(d, [], name, [0.5, 0.9]).select(c("q")[0].alias(f"{name}_median"), c("q")[1].alias(f"{name}_p90"))
        failed = failed.join(F.broadcast(q), F.lit(True))
    return failed.select("offset_median", "offset_p90", "pm_median", "pm_p90", "fail_offset", "fail_pm")


def in_locus(p: Params) -> Column:
    return X.true_or_false(c("t_dust_k").between(p.t_dust_min, p.t_dust_max) & c("tau").between(p.tau_min, p.tau_max))


def calibrate_locus(control: DataFrame, q: float = 0.95) -> DataFrame:
    """Central-q quantiles of temperature and tau of a control table."""
    at = [(1 - q) / 2, (1 + q) / 2]
    one = quantiles(control, [], "t_dust_k", at, "t").join(F.broadcast(quantiles(control, [], "tau", at, "u")), F.lit(True))
    return one.select(c("t")[0].alias("t_dust_min"), c("t")[1].alias("t_dust_max"), c("u")[0].alias("tau_min"), c("u")[1].alias("tau_max"))


def anomaly(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add in_locus, anomaly_score and is_candidate."""
    known, known_t = F.coalesce(c("known_disk"), F.lit(False)), c("t_dust_k").isNotNull() & c("tau").isNotNull()
    df = df.withColumn("in_locus", in_locus(p))
    outside = F.when(known_t & ~c("in_locus"), 0.5).otherwise(0.0)
    score = outside + F.coalesce(X.clip(c("tau") / p.tau_swarm, 0.0, 1.0), F.lit(0.0)) * 0.3 + 0.2
    return df.withColumns({"anomaly_score": F.when(known, 0.0).otherwise(score), "is_candidate": ~known & ~c("in_locus") & known_t})


def analyze(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Vetted catalogue: photosphere, excess and funnel."""
    return funnel(excess(predict(df), p), p)


def candidates(vetted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Clean sources with an excess, with dust, score and rank order."""
    return anomaly(dust(vetted.filter("clean AND has_excess")), p).filter("is_candidate").orderBy(F.desc("anomaly_score"), "source_id")


def label_rates(vetted: DataFrame) -> DataFrame:
    """Share of each label's sources that survive the funnel."""
    return vetted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(c("clean").cast("double")).alias("kept_rate"))
