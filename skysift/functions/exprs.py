"""Column expressions for photometry and astrometry; all compile into generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Effective wavelength (micron) and zero point (Jy) of each band.
BANDS = {
    "FUV": (0.1542, 3631.0),
    "NUV": (0.2274, 3631.0),
    "G": (0.6730, 3228.75),
    "BP": (0.5320, 3552.01),
    "RP": (0.7970, 2554.95),
    "J": (1.235, 1594.0),
    "H": (1.662, 1024.0),
    "Ks": (2.159, 666.7),
    "W1": (3.3526, 309.540),
    "W2": (4.6028, 171.787),
    "W3": (11.5608, 31.674),
    "W4": (22.0883, 8.363),
}
#: Planck, light speed and Boltzmann constants (SI).
PLANCK, LIGHT, BOLTZMANN = 6.62607015e-34, 2.99792458e8, 1.380649e-23
LN10_04 = 0.4 * math.log(10.0)
#: Fixed value: km/s for one mas/yr at one kpc.
KMS_PER_MASYR_KPC = 4.740857


def frequency(band: str) -> float:
    return LIGHT / (BANDS[band][0] * 1e-6)


def flux_jy(mag: Column, band: str) -> Column:
    return F.lit(BANDS[band][1]) * F.pow(F.lit(10.0), mag * -0.4)


def magnitude(flux: Column, band: str) -> Column:
    """NULL for fluxes that aren't positive."""
    return F.when(flux > 0, F.log10(flux / BANDS[band][1]) * -2.5)


def flux_error_jy(mag: Column, error: Column, band: str) -> Column:
    return flux_jy(mag, band) * error * LN10_04


def planck(temperature: Column, band: str) -> Column:
    nu = frequency(band)
    return F.lit(2.0 * PLANCK * nu**3 / LIGHT**2) / F.expm1(F.lit(PLANCK * nu / BOLTZMANN) / temperature)


def model_jy(temperature: Column, band: str) -> Column:
    """Flux of a black body of unit solid angle over pi."""
    return planck(temperature, band) * (math.pi * 1e26)


def logistic(x: Column, centre: float, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp((F.lit(centre) - x) / scale))


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def absolute_magnitude(g: Column, parallax: Column) -> Column:
    return F.when(parallax > 0, g + F.log10(parallax / 100.0) * 5.0)


def separation_arcsec(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    """Small-angle separation; right ascensions meet at 360."""
    d = F.abs(ra - ra0)
    d = F.least(d, 360.0 - d)
    return F.hypot(d * F.cos(F.radians(dec0)), dec - dec0) * 3600.0


def true_or_false(condition: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once for each row: later filters and projections don't repeat their expressions."""
    made = F.struct(*(x.alias(n) for n, x in columns.items()))
    return df.drop(*columns).withColumn("_held", F.explode(F.array(made))).select("*", "_held.*").drop("_held")
