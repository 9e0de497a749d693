"""Exact quantiles by distributed selection, equal to ``percentile`` with its linear interpolation.

Spark's ``percentile`` gathers all distinct values of a group in one task. Here a sketch of bounded size names, for each
quantile, two values that it must lie between; one pass counts the rows below the lower one exactly, and only
the few rows between them are grouped by value and counted through. Where a bracket proves too narrow it is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.tables import written

c = F.col
#: Groups of up to so many rows are left to ``percentile``, which gathers them.
SMALL = 100_000
#: The sketch's ranks are off by at most one part in so many.
ACCURACY = 10_000


def quantiles(df: DataFrame, keys: Sequence[str], column: str, at: Sequence[float], name: str = "q") -> DataFrame:
    """(keys, name): the quantiles ``at`` of a column's values as an array, one row for each group that has any; NULLs and NaNs don't count.

    Without keys there is one row, NULL where no row has a value.
    """
    at = [float(x) for x in at]
    whole = "_all" if not keys else None
    keys_ = list(keys) or [whole]
    if whole:
        df = df.withColumn(whole, F.lit(0))
    # one pass serves the count, the brackets and the selection
    rows = df.select(*keys_, c(column).cast("double").alias("_v")).filter(c("_v").isNotNull() & ~F.isnan("_v"))
    sizes = rows.groupBy(*keys_).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= SMALL:
        out = rows.groupBy(*keys_).agg(F.percentile("_v", F.array(*map(F.lit, at))).alias(name))
    else:
        out = _selected(written(rows), keys_, at, name)
    if not whole:
        return out
    one = df.sparkSession.range(1).select(F.lit(0).alias(whole))
    return one.join(out, whole, "left").drop(whole)


def _selected(rows: DataFrame, keys: list[str], at: list[float], name: str) -> DataFrame:
    slack = 3.0 / ACCURACY
    edges = [x for p in at for x in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, ACCURACY).alias("_e"))
    # ranks from 0: the quantile lies between the values of the ranks first and first + 1
    place = [c("_n").cast("double") - 1] * len(at)
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), F.element_at("_e", 2 * i + 1).alias("lo"), F.element_at("_e", 2 * i + 2).alias("hi"), (place[i] * p).alias("rank")) for i, p in enumerate(at)))
    brackets = written(sketch.select(*keys, brackets.alias("_b")))
    out = []
    todo = brackets
    while True:
        found = _counted(rows, todo, keys)
        out.append(found.filter("ok").select(*keys, "i", "value"))
        short = found.filter("NOT ok").select(*keys, "i", "rank")
        wide = short.groupBy(*keys).agg(F.collect_list(F.struct("i", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), "rank")).alias("_b"))
        todo = written(wide)
        if todo.isEmpty():
            break
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x.value).alias(name))


def _counted(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, rank, value, ok): the quantile of each bracket, and whether the bracket holds it."""
    met = rows.join(brackets, keys)
    below = met.select(*keys, F.explode(F.filter("_b", lambda b: (c("_v") < b.lo))).alias("b")).groupBy(*keys, c("b.i").alias("i")).agg(F.count(F.lit(1)).alias("_below"))
    inside = met.select(*keys, "_v", F.explode(F.filter("_b", lambda b: (c("_v") >= b.lo) & (c("_v") <= b.hi))).alias("b"))
    values = inside.groupBy(*keys, c("b.i").alias("i"), "_v").agg(F.count(F.lit(1)).alias("_m"))
    listed = brackets.select(*keys, F.explode("_b").alias("b")).select(*keys, "b.i", "b.rank").join(below, [*keys, "i"], "left")
    upto = F.sum("_m").over(Window.partitionBy(*keys, "i").orderBy("_v"))
    placed = values.withColumn("_upto", upto).join(listed, [*keys, "i"], "right").withColumn("_end", c("_upto") + F.coalesce("_below", F.lit(0)))
    # a value takes the ranks from _end - _m to _end - 1
    low = F.floor("rank")
    holds = lambda r: (r < c("_end")) & (r >= c("_end") - c("_m"))
    high = F.ceil("rank")
    one = placed.groupBy(*keys, "i", "rank").agg(F.max(F.when(holds(low), c("_v"))).alias("_a"), F.max(F.when(holds(high), c("_v"))).alias("_z"))
    share = c("rank") - F.floor("rank")
    # the same sum as percentile's
    value = F.when(c("_a") == c("_z"), c("_a")).otherwise((F.ceil("rank") - c("rank")) * c("_a") + share * c("_z"))
    return written(one.select(*keys, "i", "rank", value.alias("value"), (c("_a").isNotNull() & c("_z").isNotNull()).alias("ok")))
