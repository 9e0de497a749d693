"""Candidate spectral lines as a table: known lines, recurrence, duplicates, redshift families, excluded bandwidth."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.batches import whole_keys
from skysift.functions.lines import DIFFUSE, EMISSION, GALAXY, INTERSTELLAR, LOCKED, SKY, STELLAR
from skysift.functions.tables import let_workers_import, written

c = F.col
LIGHT_KMS = 299792.458


def known_lines(*lists: tuple[float, ...]) -> list[float]:
    """Distinct union of line lists, rounded to 0.01."""
    return sorted({round(x, 2) for some in lists for x in some})


KNOWN = known_lines(EMISSION, STELLAR, INTERSTELLAR, DIFFUSE, SKY)


def nearest_line(w: Column, lines: list[float]) -> Column:
    """The nearest of some lines in ascending order as struct (gap, line); ties to the lower line.

    A table of cells tells how many middles between lines lie before a cell; only a cell's own middles are compared.
    """
    middles = [(a + b) / 2 for a, b in zip(lines, lines[1:])] or [lines[0]]
    low, high = math.floor(middles[0]), math.ceil(middles[-1]) + 1
    before = [bisect_left(middles, low + i) for i in range(high - low + 1)]
    most = max(b - a for a, b in zip(before, before[1:]))
    # wavelengths beyond the middles count as its ends, NaN as the upper one
    cell = F.least(F.greatest(w, F.lit(float(low))), F.lit(float(high)))
    first = F.element_at(F.array(*map(F.lit, before)), F.floor(cell - low).cast("int") + 1)
    place = first + 1
    ends = F.array(*map(F.lit, [*middles, *[float("nan")] * (most + 1)]))
    for j in range(most):
        place = place + (w > F.element_at(ends, first + (j + 1))).cast("int")
    line = F.element_at(F.array(*map(F.lit, lines)), F.least(place, F.lit(len(lines))))
    line = F.when(w.isNotNull(), line)
    return F.struct(F.abs(w - line).alias("gap"), line.alias("line"))


def velocity(w: Column, lines: list[float]) -> Column:
    near = nearest_line(w, lines)
    return (w - near["line"]) / near["line"] * LIGHT_KMS


#: Width of the cells in which excluded windows are merged, in Angstrom.
CELL = 10.0


def excluded_bandwidth(lines: DataFrame, kms: float, low: float = 3600.0, high: float = 9800.0) -> DataFrame:
    """(excluded, fraction): length of the union of the windows around lines, clipped to the band."""
    half = c("line") * (kms / LIGHT_KMS)
    spans = lines.select(F.greatest(c("line") - half, F.lit(low)).alias("lo"), F.least(c("line") + half, F.lit(high)).alias("hi")).filter("lo < hi").distinct()
    # windows are cut at the edges of cells, and each cell's union is measured apart
    cell = lambda x: F.floor(x / CELL).cast("bigint")
    spans = spans.withColumn("_cell", F.explode(F.sequence(cell(c("lo")), cell(c("hi")))))
    spans = spans.select("_cell", F.greatest("lo", c("_cell") * CELL).alias("lo"), F.least("hi", (c("_cell") + 1) * CELL).alias("hi")).filter("lo < hi")
    order = Window.partitionBy("_cell").orderBy("lo", "hi")
    new = F.coalesce(c("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    isles = spans.withColumn("_new", new.cast("int")).withColumn("_isle", F.sum("_new").over(order)).groupBy("_cell", "_isle").agg((F.max("hi") - F.min("lo")).alias("len"))
    return isles.agg(F.sum("len").alias("excluded")).select("excluded", (c("excluded") / (high - low)).alias("fraction"))


def running_totals(events: DataFrame, points: DataFrame, inclusive: bool, cell: float = 1.0) -> DataFrame:
    """(pos, total): for each distinct point, the sum of n over the events (pos, n) before it, those at it included or not.

    Totals of whole cells of positions come from one row for each cell; only the events of a point's own cell
    are sorted with it.
    """
    place = F.floor(c("pos") / cell).cast("bigint").alias("_cell")
    late, early = F.lit(1), F.lit(0)
    e = events.groupBy("pos").agg(F.sum("n").alias("n")).select("pos", "n", place, (early if inclusive else late).alias("_turn"))
    q = points.select("pos").distinct().select("pos", F.lit(0).cast("bigint").alias("n"), place, (late if inclusive else early).alias("_turn"))
    whole = e.groupBy("_cell").agg(F.sum("n").alias("_sum"))
    cells = q.select("_cell").distinct().join(whole, "_cell", "full").select("_cell", F.coalesce("_sum", F.lit(0)).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("n").over(Window.partitionBy("_cell").orderBy("pos", "_turn").rowsBetween(Window.unboundedPreceding, 0))
    both = e.unionByName(q).withColumn("_in", inside).filter(c("_turn") == (late if inclusive else early))
    return both.join(cells.select("_cell", before.alias("_before")), "_cell").select("pos", (c("_in") + c("_before")).alias("total"))


def recurrent(df: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Add n_spectra: distinct spectra with a line within tolerance, this one included.

    The lines of a spectrum cover disjoint runs of wavelengths; a wavelength's count is the number of runs that
    begin at most at it, less those that end before it. No pair of lines is ever formed, and runs are no groups: a row
    for each distinct wavelength, written once, holds how many begin and end there.
    """
    order = Window.partitionBy("spec_id").orderBy("wavelength")
    apart = lambda gap: F.coalesce(gap > 2 * tolerance, F.lit(True)).cast("long")
    lines = df.select("spec_id", "wavelength").filter(c("wavelength").isNotNull())
    marks = lines.select("wavelength", apart(c("wavelength") - F.lag("wavelength").over(order)).alias("_new"), apart(F.lead("wavelength").over(order) - c("wavelength")).alias("_old"))
    points = written(marks.groupBy("wavelength").agg(F.sum("_new").alias("_new"), F.sum("_old").alias("_old")))
    # both sides are moved by the tolerance downwards, which doubles represent exactly
    high, low = c("wavelength").alias("pos"), (c("wavelength") - tolerance).alias("pos")
    begun = running_totals(points.filter("_new > 0").select(low, c("_new").alias("n")), points.select(high), True)
    ended = running_totals(points.filter("_old > 0").select(high, c("_old").alias("n")), points.select(low), False)
    n = points.select("wavelength", low.alias("_low")).join(begun.select(c("pos").alias("wavelength"), c("total").alias("_b")), "wavelength").join(ended.select(c("pos").alias("_low"), c("total").alias("_e")), "_low")
    return df.join(n.select("wavelength", (c("_b") - c("_e")).alias("n_spectra")), "wavelength")


def recurrent_bins(df: DataFrame, width: float = 2.0, least: int = 3) -> DataFrame:
    """Rows outside of wavelength bins (rounded half to even) that hold lines of many spectra."""
    b = F.rint(c("wavelength") / width).cast("bigint")
    bad = df.groupBy(b.alias("_bin")).agg(F.countDistinct("spec_id").alias("_n")).filter(c("_n") >= least).select("_bin")
    return df.withColumn("_bin", b).join(bad, "_bin", "left_anti").drop("_bin")


def triage(df: DataFrame, lines: list[float], kms: float = 300.0, tolerance: float = 3.0, least: int = 3) -> DataFrame:
    """Add n_spectra and verdict: duplicate, known_window, recurrent or survives.

    Of rows with the same spectrum and wavelength (to 0.1) the most significant one is the first.
    """
    first = Window.partitionBy("spec_id", F.round("wavelength", 1)).orderBy(F.desc("significance"), "search_mode", "line_no")
    d = recurrent(df, tolerance).withColumn("_r", F.row_number().over(first))
    verdict = F.when(c("_r") > 1, "duplicate").when(F.abs(velocity(c("wavelength"), lines)) <= kms, "known_window").when(c("n_spectra") >= least, "recurrent").otherwise("survives")
    return d.withColumn("verdict", verdict).drop("_r")


#: Pairs of an anchor and a line of its spectrum that a task looks at together.
PAIRS = 1_000_000


def _families(w: np.ndarray, edges: np.ndarray, kms: float, z_min: float, z_max: float) -> tuple[np.ndarray, ...]:
    """(spectrum, n_matched, z, is_galaxy) of the spectra with an anchor; ``edges`` are where the ascending distinct lines of a spectrum begin, and the end."""
    rest = np.array(sorted(x for _, x in GALAXY))
    bit = {name: 1 << int(np.searchsorted(rest, x)) for name, x in GALAXY}
    # in relative distance, the middle between two lines is their harmonic mean
    middles = np.array([2 * a * b / (a + b) for a, b in zip(rest, rest[1:])])
    sizes = np.diff(edges)
    redshift = w[:, None] / np.array([x for _, x in GALAXY]) - 1.0
    # in the order that settles ties: by anchor, then by place in the list
    line, place = np.nonzero((redshift >= z_min) & (redshift <= z_max))
    z, owner = redshift[line, place], np.repeat(np.arange(len(sizes)), sizes)[line]
    met, ends, at = np.zeros(len(z), dtype=np.int64), np.cumsum(sizes[owner]), 0
    while at < len(z):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = sizes[owner[at:upto]]
        first = np.cumsum(n) - n
        observed = w[np.repeat(edges[owner[at:upto]] - first, n) + np.arange(n.sum())]
        shift = np.repeat(z[at:upto] + 1.0, n)
        nearest = np.searchsorted(middles, observed / shift, side="left")
        near = np.abs(observed / (rest[nearest] * shift) - 1.0) * LIGHT_KMS <= kms
        met[at:upto] = np.bitwise_or.reduceat(np.where(near, np.left_shift(1, nearest), 0), first)
        at = upto
    matched = np.bitwise_count(met).astype(np.int64)
    galaxy = matched >= 3
    for a, b in LOCKED:
        galaxy |= (met & (bit[a] | bit[b])) == (bit[a] | bit[b])
    if not len(z):
        return owner, matched, z, galaxy
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    score = galaxy * (len(rest) + 1) + matched
    top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, begins), np.diff(np.append(begins, len(z)))))
    best = top[np.append(True, owner[top][1:] != owner[top][:-1])]
    return owner[best], matched[best], z[best], galaxy[best]


def redshift_families(df: DataFrame, kms: float = 250.0, z_min: float = -0.003, z_max: float = 1.2) -> DataFrame:
    """(spec_id, n_lines, n_matched, z, is_galaxy): the redshift under which most distinct rest lines are met.

    Every observed line may be any rest line; that is at most 13 anchors for each line of a spectrum. Under an
    anchor's redshift each line of the spectrum stands for its nearest rest line only, if that is near enough;
    the rest lines that are met are the bits of an integer. Anchors aren't rows: a spectrum's lines are sorted to it once, and
    its anchors are compared where they are.
    """
    let_workers_import(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_keys(batches, "spec_id"):
            w = table.column("wavelength").to_numpy()
            new = np.append(True, (w[1:] != w[:-1]) & ~(np.isnan(w[1:]) & np.isnan(w[:-1])))
            new[edges[:-1]] = True
            places = np.append(0, np.cumsum(new))[edges]
            owner, matched, z, galaxy = _families(w[new], places, kms, z_min, z_max)
            ids = table.column("spec_id").combine_chunks().take(pa.array(edges[owner]))
            columns = [ids, pa.array(np.diff(places)[owner].astype(np.int32)), pa.array(matched.astype(np.int32)), pa.array(z), pa.array(galaxy)]
            yield pa.record_batch(columns, names=["spec_id", "n_lines", "n_matched", "z", "is_galaxy"])

    lines = df.select("spec_id", c("wavelength").cast("double").alias("wavelength")).filter(c("wavelength").isNotNull())
    dealt = lines.repartition("spec_id").sortWithinPartitions("spec_id", "wavelength")
    return dealt.mapInArrow(run, f"spec_id {dict(df.dtypes)['spec_id']}, n_lines int, n_matched int, z double, is_galaxy boolean")


def with_families(triaged: DataFrame, families: DataFrame) -> DataFrame:
    """Survivors in a galaxy's spectrum become verdict galaxy."""
    d = triaged.join(families.select("spec_id", "is_galaxy"), "spec_id", "left").withColumn("is_galaxy", F.coalesce("is_galaxy", F.lit(False)))
    return d.withColumn("verdict", F.when((c("verdict") == "survives") & c("is_galaxy"), "galaxy").otherwise(c("verdict")))


def verdict_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("search_mode", "verdict").agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, n: int) -> DataFrame:
    """The n best by score, lowered for spectra with many lines."""
    many = F.count(F.lit(1)).over(Window.partitionBy("spec_id"))
    d = df.withColumn("rank_score", c("score") / ((many - 1) * 0.15 + 1.0))
    return d.orderBy(F.desc("rank_score"), "spec_id", "wavelength", "line_no").limit(n)
