"""Occurrence limits, completeness sweeps, budgets and histograms over result tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.quantiles import quantiles
from skysift.functions import exprs as X
from skysift.operators import catalog
from skysift.params import DEFAULT, Params

c = F.col
BISECTIONS = 60


def poisson_mean_limit(k: Column, confidence: float = 0.95) -> Column:
    """Upper limit on a Poisson mean after k events: where the chance of k or fewer has fallen to 1 - confidence."""

    def at_most(mu: Column) -> Column:
        # log-space terms stay finite for large k
        term = lambda i: F.exp(-mu + i * F.log(mu) - log_factorial(i))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda s, i: s + term(i))

    def step(s: Column, _: Column) -> Column:
        mid = (s.low + s.high) / 2
        over = at_most(mid) > 1 - confidence
        return F.struct(F.when(over, mid).otherwise(s.low).alias("low"), F.when(over, s.high).otherwise(mid).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), (k + F.sqrt(k + 1.0) * 6 + 10.0).cast("double").alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step, lambda s: (s.low + s.high) / 2)
    return F.when(k == 0, F.lit(-math.log(1 - confidence))).otherwise(found)


def log_factorial(i: Column) -> Column:
    """ln i!, by Stirling's series from 8 on."""
    x = i.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(i < 8, F.log(F.factorial(F.least(i, F.lit(8)).cast("int")).cast("double"))).otherwise(series)


def occurrence_limit(df: DataFrame, k: str, n: str, completeness: float = 1.0, p: Params = DEFAULT) -> DataFrame:
    """Add point (k / n) and upper_limit; both NULL where n isn't positive."""
    return df.withColumns({"point": F.when(c(n) > 0, c(k) / c(n)), "upper_limit": F.when(c(n) > 0, poisson_mean_limit(c(k), p.confidence) / (c(n) * max(completeness, 1e-6)))})


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values clipped to [low, high]."""
    width = (high - low) / bins
    b = F.least(F.floor((X.clip(c(column), low, high) - low) / width), F.lit(bins - 1)).cast("int")
    return df.filter(c(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def completeness(df: DataFrame, temperatures: tuple[float, ...] = (150.0, 300.0, 500.0, 800.0, 1200.0), taus: tuple[float, ...] = (0.003, 0.01, 0.03, 0.1, 0.3), p: Params = DEFAULT) -> DataFrame:
    """(t_dust, tau, n, recovered): share of sources whose injected excess passes the selection, per grid cell.

    The grid is an array constant that each source row is exploded by; only counts are shuffled.
    """
    cells = F.array(*(F.struct(F.lit(t).alias("t_dust"), F.lit(u).alias("u")) for t in temperatures for u in taus))
    base = catalog.predict(df).filter(c("sed_scale").isNotNull())
    rows = base.withColumn("cell", F.explode(cells))
    omega = c("cell.u") * c("sed_scale") * F.pow(c("teff") / c("cell.t_dust"), 4)
    for b in ("W1", "W2"):
        rows = rows.withColumn(f"{b}mag", X.magnitude(c(f"{b}_pred_jy") + omega * X.model_jy(c("cell.t_dust"), b), b))
    found = catalog.excess(rows, p)
    return found.groupBy(c("cell.t_dust").alias("t_dust"), c("cell.u").alias("tau")).agg(F.count(F.lit(1)).alias("n"), F.avg(c("has_excess").cast("double")).alias("recovered"))


def forecast(cells: DataFrame, sample: float, p: Params = DEFAULT) -> DataFrame:
    """Add n_eff and limit (NULL where nothing is recovered) for a sample of that size."""
    n = c("recovered") * sample
    return cells.withColumns({"n_eff": n, "limit": F.when(n > 0, F.lit(-math.log(1 - p.confidence)) / n)})


def least_tau(cells: DataFrame) -> DataFrame:
    """(t_dust, tau_min): the least tau of each temperature that is recovered at least half the time."""
    return cells.groupBy("t_dust").agg(F.min(F.when(c("recovered") >= 0.5, c("tau"))).alias("tau_min"))


def headline(forecasted: DataFrame) -> DataFrame:
    """The cell with the smallest limit."""
    return forecasted.filter(c("limit").isNotNull()).orderBy("limit", "t_dust", "tau").limit(1)


def removal(df: DataFrame, years: float = 10.0, tolerance: float = 1.0) -> DataFrame:
    """Add removed: whether a background source at this motion would fail the position or the motion test."""
    mu = F.hypot("pmra", "pmdec")
    sigma = F.pow(F.lit(10.0), (c("W1mag") - 14.0) * 0.2) * 10.0
    return df.withColumns({"mu": mu, "removed": (mu / 1000.0 * years > tolerance) | (mu / sigma > 3.0)})


def budget(removed: DataFrame, density_deg2: float, radius_arcsec: float) -> DataFrame:
    """Expected chance blends before and after the removal tests."""
    rate = density_deg2 * math.pi * (radius_arcsec / 3600.0) ** 2
    one = removed.agg(F.count(F.lit(1)).alias("n"), F.count_if("removed").alias("n_removed"))
    one = one.join(F.broadcast(quantiles(removed, [], "mu", [0.5]).select(c("q")[0].alias("median_mu"))), F.lit(True))
    return one.select("n", (c("n") * rate).alias("before"), ((c("n") - c("n_removed")) * rate).alias("after"), F.try_divide(c("n"), c("n") - c("n_removed")).cast("double").alias("factor"), (c("n_removed") / c("n")).alias("removed_fraction"), "median_mu")


def efficacy(removed: DataFrame, edges: tuple[float, ...] = (0, 50, 100, 150, 200, 300)) -> DataFrame:
    """(bin, low, n, removed_fraction) in bins of proper motion [low, high); empty bins are absent."""
    b = F.lit(None).cast("int")
    low = F.lit(None).cast("double")
    for i in range(len(edges) - 1):
        inside = (c("mu") >= edges[i]) & (c("mu") < edges[i + 1])
        b, low = F.when(inside, i).otherwise(b), F.when(inside, float(edges[i])).otherwise(low)
    return removed.groupBy(b.alias("bin"), low.alias("low")).agg(F.count(F.lit(1)).alias("n"), F.avg(c("removed").cast("double")).alias("removed_fraction")).filter("bin IS NOT NULL")
