"""Whole searches from their parts, and runs that go on where they were stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.functions.tables import written
from skysift.operators import catalog, indicators, lightcurve, orbits, verdicts
from skysift.operators.assembly import frame_rms
from skysift.operators.encounters import closest_approach, phase_space, transfer
from skysift.operators.xmatch import literature_match, nearest
from skysift.sources.sinks import write_with_provenance

c = F.col


class Stages:
    """The tables of a run's stages in a shared folder.

    A stage's manifest (its row count and columns) is written after its table. A run that is started again reads the
    stages that have one and makes the others, which replace what was left of them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self, name: str) -> DataFrame | None:
        """The stage's manifest, or None where it isn't done."""
        try:
            return self.spark.read.schema("name string, n_rows long, columns string").json(f"{self.path}/{name}.provenance")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if self.manifest(name) is None:
            write_with_provenance(make(), f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")


def encounter_run(stars: DataFrame, anchor: DataFrame, search_pc: float = 40.0, oldest_myr: float = 10.0, closest_pc: float = 2.0) -> dict[str, DataFrame]:
    """Encounters of all stars with the one-row anchor: ``scored`` (those in the search sphere that move against it), ``shortlist``
    (past encounters within ``closest_pc``, the best transfer score first), ``comoving`` (the slowest first) and ``summary``, one row.
    """
    one = phase_space(anchor.limit(1))
    others = phase_space(stars).join(F.broadcast(one.select("source_id")), "source_id", "left_anti")
    met = closest_approach(others, one).filter(c("v_rel_kms").isNotNull() & (c("sep_now_pc") <= search_pc))
    scored = written(transfer(met, oldest_myr))
    shortlist = scored.filter(c("past_encounter") & (c("d_min_pc") <= closest_pc)).orderBy(F.desc("transfer_score"), "source_id")
    near = c("past_encounter") & (c("d_min_pc") <= closest_pc)
    summary = scored.agg(F.count(F.lit(1)).alias("n_searched"), F.count_if("past_encounter").alias("n_past"), F.count_if(near).alias("n_shortlist"), F.count_if("comoving").alias("n_comoving"), F.min(F.when(near, c("d_min_pc"))).alias("closest_pc"))
    return {"scored": scored, "shortlist": shortlist, "comoving": scored.filter("comoving").orderBy("v_rel_kms", "source_id"), "summary": summary}


def companion_run(accelerations: DataFrame, orbit_rows: DataFrame, sources: DataFrame, catalogues: DataFrame) -> dict[str, DataFrame]:
    """Unseen companions from accelerations and from orbits.

    ``accelerated``: the ranked accelerations that no orbit explains; ``dark``: ranked massive companions of the orbits whose
    source has a position in ``sources``, with their literature matches and novel (in no catalogue and not published, and
    only if there are catalogues at all); ``summary``, one row.
    """
    ranked = written(orbits.without_orbits(orbits.rank_accelerations(orbits.accelerations(accelerations)), orbit_rows))
    placed = written(orbit_rows.join(sources.select("source_id", "ra", "dec"), "source_id"))
    dark = literature_match(orbits.rank_dark(orbits.orbits(placed)), catalogues)
    covered = catalogues.agg((F.count(F.lit(1)) > 0).alias("_covered"))
    dark = written(dark.join(F.broadcast(covered), F.lit(True)).withColumn("novel", c("_covered") & ~c("in_literature") & ~c("known")).drop("_covered"))
    one = dark.agg(F.count(F.lit(1)).alias("n_dark"), F.count_if("in_literature").alias("n_in_literature"), F.count_if("novel").alias("n_novel"))
    count = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    summary = count(accelerations, "n_searched").join(count(ranked, "n_accelerated"), F.lit(True)).join(count(placed, "n_orbits"), F.lit(True)).join(F.broadcast(one), F.lit(True))
    return {"accelerated": ranked.orderBy(F.desc("rank_score"), "source_id"), "dark": dark.orderBy("known", F.desc("triage_class"), F.desc("rank_score"), "source_id"), "summary": summary}


#: What a light curve adds to a source: the optical and the infrared columns of the axes.
MEASURED = ("ztf_frac_rms", "ztf_ls_fap", "ztf_ls_amp_mag", "neowise_w1_frac_rms")


def science_run(table: DataFrame, curves: DataFrame, frames: DataFrame, objects: DataFrame, radius_arcsec: float = 5.0) -> dict[str, DataFrame]:
    """The multi-axis search over the clean rows of a catalogue.

    A first pass over the axes that need no light curve lists what is flagged on any, or has an excess (``shortlist``).
    Those get their optical scatter and period from ``curves`` and their infrared scatter from ``frames`` (band w1), and a second pass
    takes all axes (``scored``). ``candidates`` are on as many axes as it takes, the best score first, with the class of the nearest
    of ``objects`` (cand_id, ra, dec, otype, sptype).
    """
    clean = written(catalog.dust(catalog.analyze(table)).filter("clean").withColumns({x: F.lit(None).cast("double") for x in MEASURED}))
    first = indicators.combine(indicators.evaluate(clean))
    shortlist = written(first.filter("n_axes >= 1 OR has_excess").select("source_id").distinct())
    optical = lightcurve.variability_table(curves, shortlist).select("source_id", c("frac_rms").alias("ztf_frac_rms"), c("fap").alias("ztf_ls_fap"), c("amplitude").alias("ztf_ls_amp_mag"))
    infrared = frame_rms(frames.filter("band = 'w1'").join(shortlist, "source_id", "left_semi")).select("source_id", c("frac_rms").alias("neowise_w1_frac_rms"))
    measured = clean.drop(*MEASURED).join(optical, "source_id", "left").join(infrared, "source_id", "left")
    scored = written(indicators.combine(indicators.evaluate(measured)))
    chosen = scored.filter("multimodal_candidate")
    near = nearest(chosen.select("source_id", "ra", "dec"), objects, radius_arcsec, b_cols=("cand_id", "otype", "sptype")).select("source_id", "otype", "sptype")
    named = chosen.join(near, "source_id", "left").withColumn("candidate_class", verdicts.object_class(c("otype"), c("sptype")))
    return {"shortlist": shortlist, "scored": scored, "candidates": named.orderBy(F.desc("multimodal_score"), "source_id")}
