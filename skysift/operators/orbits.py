"""Astrometric accelerations and orbits with unseen companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.exprs import KMS_PER_MASYR_KPC, absolute_magnitude, clip, held

c = F.col
#: Fixed values (SI): gravity, solar mass, astronomical unit, year.
GRAVITY, SUN, AU, YEAR = 6.674e-11, 1.989e30, 1.496e11, 3.156e7
#: Systems whose dark companion is published.
KNOWN_DARK = (4373465352415301632, 5870569352746779008, 4318465066420528000)


def single_star_ceiling(steps: int = 4000, exponent: float = 3.5) -> float:
    """The largest mass-ratio function that one main-sequence companion reaches."""
    best = 0.0
    for i in range(steps):
        q = 1e-3 + (1 - 1e-3) * i / (steps - 1)
        light = q**exponent
        best = max(best, (1 + q) ** (1 / 3) * (q / (1 + q) - light / (1 + light)))
    return best


CEILING = single_star_ceiling()


def accelerations(df: DataFrame, separation_au: float = 3.0) -> DataFrame:
    """Add total, significance, distance, SI acceleration, implied mass, absolute magnitudes and dark."""
    total = F.hypot("accel_ra", "accel_dec")
    error = F.nullif(F.hypot("accel_ra_error", "accel_dec_error"), F.lit(0.0))
    df = df.withColumns({"accel_total": total, "significance": total / error, "dist_pc": F.when(c("parallax") > 0, 1000.0 / c("parallax")), "abs_g": absolute_magnitude(c("phot_g_mean_mag"), c("parallax"))})
    df = df.withColumn("accel_si", F.when(c("parallax") > 0, c("accel_total") / c("parallax") * (KMS_PER_MASYR_KPC * 1e3 / YEAR)))
    df = df.withColumn("implied_mass", c("accel_si") * ((separation_au * AU) ** 2 / GRAVITY / SUN))
    df = df.withColumn("companion_abs_g", F.when(c("implied_mass") > 0, 4.8 - F.log10("implied_mass") * 8.0))
    return df.withColumn("dark", F.coalesce(c("companion_abs_g") < c("abs_g") + 0.5, F.lit(False)))


def rank_accelerations(df: DataFrame, least: float = 20.0, farthest: float = 500.0) -> DataFrame:
    """Significant and near ones with rank_score; the strongest acceleration is a broadcast scalar."""
    d = df.filter((c("significance") >= least) & (c("dist_pc") <= farthest))
    top = d.agg(F.max(F.abs("accel_si")).alias("_top"))
    score = F.least(c("significance"), F.lit(200.0)) / 200.0 * clip(F.abs("accel_si") / c("_top"), 0.0, 1.0) * clip(1.0 - c("dist_pc") / farthest, 0.0, 1.0)
    return d.join(F.broadcast(top), F.lit(True)).withColumn("rank_score", score).drop("_top").orderBy(F.desc("rank_score"), "source_id")


def companion_mass(f: Column, m1: Column, steps: int = 60) -> Column:
    """The positive root of m^3 = f (m1 + m)^2, by Newton steps from above inside the row."""
    start = F.greatest(f * 4.0, F.cbrt(f * m1 * m1) * 2.0, F.lit(1e-3))
    step = lambda m, _: m - (m * m * m - f * (m1 + m) * (m1 + m)) / (m * m * 3.0 - f * (m1 + m) * 2.0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def orbits(df: DataFrame) -> DataFrame:
    """Add photocentre axis, mass function, masses, mass-ratio function, class and compact."""
    u = (c("a_ti") * c("a_ti") + c("b_ti") * c("b_ti") + c("f_ti") * c("f_ti") + c("g_ti") * c("g_ti")) / 2.0
    v = c("a_ti") * c("g_ti") - c("b_ti") * c("f_ti")
    df = df.withColumn("a0_mas", F.sqrt(u + F.sqrt(F.greatest(u * u - v * v, F.lit(0.0)))))
    df = df.withColumns({"period_yr": c("period") / 365.25, "abs_g": absolute_magnitude(c("phot_g_mean_mag"), c("parallax")), "dist_pc": F.when(c("parallax") > 0, 1000.0 / c("parallax"))})
    axis = F.when(c("parallax") > 0, c("a0_mas") / c("parallax"))
    df = df.withColumns({"mass_function": F.pow(axis, 3) / (c("period_yr") * c("period_yr")), "m1": clip(F.pow(F.lit(10.0), (4.8 - c("abs_g")) / 8.0), 0.1, 20.0)})
    df = held(df, {"m2": companion_mass(c("mass_function"), c("m1")), "amrf": axis * F.pow(c("period_yr"), -2.0 / 3.0) * F.pow(c("m1"), -1.0 / 3.0)})
    df = df.withColumn("triage_class", F.when(c("amrf") > CEILING * 2 ** (1 / 3), 3).when(c("amrf") > CEILING, 2).otherwise(1))
    return df.withColumn("compact", F.coalesce((c("m2") >= 3.0) & (c("triage_class") >= 2), F.lit(False)))


def rank_dark(df: DataFrame, lightest: float = 3.0, heaviest: float = 25.0, farthest: float = 1000.0, ruwe_min: float = 3.0) -> DataFrame:
    """Massive unseen companions: unknown first, then class, then score."""
    d = df.filter(c("m2").between(lightest, heaviest) & (c("dist_pc") <= farthest) & (c("ruwe") >= ruwe_min) & (c("triage_class") >= 2))
    d = d.withColumn("known", c("source_id").isin(*KNOWN_DARK))
    score = clip(c("m2") / 15.0, 0.0, 1.0) * clip(1.0 - c("dist_pc") / farthest, 0.0, 1.0) * F.when(c("triage_class") >= 3, 1.0).otherwise(0.5) * F.when(c("known"), 0.2).otherwise(1.0)
    return d.withColumn("rank_score", score).orderBy("known", F.desc("triage_class"), F.desc("rank_score"), "source_id")


def without_orbits(accelerated: DataFrame, orbit_rows: DataFrame) -> DataFrame:
    return accelerated.join(orbit_rows.select("source_id"), "source_id", "left_anti")


def top(df: DataFrame, column: str, n: int, key: str = "source_id") -> DataFrame:
    """The n largest, ties to the smaller key."""
    return df.orderBy(F.desc(column), key).limit(n)


def rank_within(df: DataFrame, group: str, column: str, key: str = "source_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(column), key)))
