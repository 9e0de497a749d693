"""The analysis table from catalogue tables, rankings of candidates, and the joins that enrich and confirm them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.operators.lightcurve import fades, fractional_rms
from skysift.operators.spectra import excess_at
from skysift.operators.xmatch import within
from skysift.sources.scans import CONTRACT_DEFAULTS, ingest

c = F.col

def joined(base: DataFrame, others: Sequence[DataFrame], key: str = "source_id") -> DataFrame:
    """A chain of left joins on the key; a column that is there already is never overwritten."""
    out = base
    for other in others:
        have = {x.lower() for x in out.columns}
        out = out.join(other.select(key, *(x for x in other.columns if x.lower() not in have)), key, "left")
    return out


def analysis_table(base: DataFrame, others: Sequence[DataFrame], neighbours: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """The funnel's input: catalogues joined to the base, neighbour counts, known_disk from a table of ids, w2snr and defaults.

    Numbers that aren't finite are NULL; an optional column that has a default holds that instead of NULL. Raises
    ValueError where a required column is missing.
    """
    out = joined(base, others)
    if neighbours is not None:
        out = joined(out, [neighbours.select("source_id", "n_wise_neighbours")])
    flag = F.lit(False)
    if known is not None:
        ids = known.select("source_id").dropna().distinct().withColumn("_known", F.lit(True))
        out, flag = out.join(ids, "source_id", "left"), F.coalesce(c("_known"), F.lit(False))
    out = out.withColumn("known_disk", flag).drop("_known")
    if "w2snr" not in out.columns and "e_W2mag" in out.columns:
        out = out.withColumn("w2snr", F.try_divide(F.lit(2.5 / math.log(10.0)), c("e_W2mag")))
    out = ingest(out)
    return out.withColumns({x: F.coalesce(c(x), F.lit(v)) for x, v in CONTRACT_DEFAULTS.items() if v is not None})


def is_flagged(flag: Column) -> Column:
    """Whether a flag of a control table says yes, as a number or as text."""
    text = F.lower(F.trim(flag.cast("string")))
    return F.coalesce(text.try_cast("double") > 0, F.lit(False)) | F.coalesce(text.isin("y", "yes", "true", "1", "e"), F.lit(False))


def flagged_ids(positions: DataFrame, control: DataFrame, flag: str, radius_arcsec: float = 2.0) -> DataFrame:
    """(source_id): sources with a flagged row of the control table (flag, ra, dec) within the radius."""
    yes = control.filter(is_flagged(c(flag)) & c("ra").isNotNull() & c("dec").isNotNull()).select(F.monotonically_increasing_id().alias("cand_id"), "ra", "dec")
    return within(positions.select("source_id", "ra", "dec"), yes, radius_arcsec).select("source_id").distinct()


def resists_mundane(hr_class: Column, period_power: Column, most: float) -> Column:
    """Whether a dimming star is an aperiodic one of the main sequence."""
    return F.coalesce((hr_class == "main_sequence") & (period_power <= most), F.lit(False))


def ranked_dips(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Candidates, those that resist common explanations first, then by score."""
    out = rows.filter("is_candidate").orderBy(F.desc("resists_mundane"), F.desc_nulls_last("score"), "source_id")
    return out if n is None else out.limit(n)


def ranked_faders(rows: DataFrame, bluest: float = 0.9) -> DataFrame:
    """Secular faders of the main sequence that are bluer than active dwarfs, the most significant first."""
    return rows.filter("is_secular_fader AND hr_class = 'main_sequence'").filter(c("bp_rp") < bluest).orderBy(F.desc_nulls_last("secular_sigma"), "source_id")


def ranked_flashes(rows: DataFrame) -> DataFrame:
    """Flashes of the main sequence, the strongest first."""
    return rows.filter("is_glint AND hr_class = 'main_sequence'").orderBy(F.desc_nulls_last("glint_max_brighten"), "source_id")


def blend_report(verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The verdicts in order (by verdict, then greatest tau), their counts, and the survivors (clean and isolated ones)."""
    counts = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return verdicts.orderBy("verdict", F.desc_nulls_last("tau"), "source_id"), counts, verdicts.filter("verdict IN ('clean', 'isolated')")


def follow_up(scored: DataFrame, n: int) -> DataFrame:
    """The n candidates of the greatest combined score."""
    return scored.orderBy(F.desc_nulls_last("combined_score"), "source_id").limit(n)


def clean_merged(vetted: DataFrame, scored: DataFrame, columns: Sequence[str] = ("tau", "t_dust_k")) -> DataFrame:
    """Clean rows of the vetted table with the named scores."""
    return joined(vetted.filter("clean"), [scored.select("source_id", *columns)])


def cross_confirmed(lines: DataFrame, pairs: DataFrame, pixels: DataFrame, least: float = 4.0, inner: float = 4.0, outer: float = 60.0) -> DataFrame:
    """(spec_id, wavelength, n_overlap, confirm_sigma, cross_confirmed): the best excess at a line's wavelength over the overlapping spectra.

    lines: (spec_id, wavelength); pairs: (spec_id, other_id) of overlapping_spectra(). A line without an overlapping
    spectrum has a count of 0 and isn't confirmed.
    """
    lines = lines.select("spec_id", "wavelength").distinct()
    met = lines.join(pairs.select("spec_id", "other_id").distinct(), "spec_id")
    seen = excess_at(pixels, met.select(c("other_id").alias("spec_id"), "wavelength").distinct(), inner, outer)
    best = met.join(seen.select(c("spec_id").alias("other_id"), "wavelength", "peak"), ["other_id", "wavelength"], "left")
    best = best.groupBy("spec_id", "wavelength").agg(F.count(F.lit(1)).alias("n_overlap"), F.max("peak").alias("confirm_sigma"))
    out = lines.join(best, ["spec_id", "wavelength"], "left")
    return out.select("spec_id", "wavelength", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"), "confirm_sigma", F.coalesce(c("confirm_sigma") >= least, F.lit(False)).alias("cross_confirmed"))


def boosted_targets(targets: DataFrame, hosts: DataFrame, host: float = 0.5, hycean: float = 1.0) -> DataFrame:
    """Targets with dest_score raised for known planet hosts and for hosts of hycean candidates, best first.

    hosts: (source_id, has_hycean_candidate), one row for each host.
    """
    out = targets.join(hosts.select("source_id", F.lit(True).alias("known_planet_host"), "has_hycean_candidate"), "source_id", "left")
    out = out.withColumns({x: F.coalesce(c(x), F.lit(False)) for x in ("known_planet_host", "has_hycean_candidate")})
    score = c("dest_score") + F.when(c("known_planet_host"), host).otherwise(0.0) + F.when(c("has_hycean_candidate"), hycean).otherwise(0.0)
    return out.withColumn("dest_score", score).orderBy(F.desc("dest_score"), "d_min_pc", "source_id")


def target_counts(targets: DataFrame) -> DataFrame:
    """(n_candidates, n_main_sequence, n_known_hosts, n_hycean_hosts)."""
    return targets.agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(c("lum_class") == "main_sequence").alias("n_main_sequence"),
        F.count_if("known_planet_host").alias("n_known_hosts"),
        F.count_if("has_hycean_candidate").alias("n_hycean_hosts"),
    )


def good_frames(epochs: DataFrame) -> DataFrame:
    """Single exposures of positive quality whose flags begin with 00."""
    return epochs.filter((c("qual_frame") > 0) & c("cc_flags").startswith("00"))


def frame_rms(epochs: DataFrame, least: int = 12) -> DataFrame:
    """(source_id, band, n_kept, frac_rms): fractional_rms() of good single exposures, NULL with fewer than ``least``.

    epochs: (source_id, band, mag, magerr, qual_frame, cc_flags).
    """
    return fractional_rms(good_frames(epochs), ["source_id", "band"], least)


def frame_fades(epochs: DataFrame, least: int = 30) -> DataFrame:
    """(source_id, band, n_epochs, slope, slope_sigma, n_seasons): fades() of good single exposures in each band, NULL where there is nothing to fit.

    epochs: (source_id, band, mjd, mag, magerr, qual_frame, cc_flags). n_epochs counts the source's good exposures in the band.
    """
    good = good_frames(epochs)
    n = good.groupBy("source_id", "band").agg(F.count(F.lit(1)).alias("n_epochs"))
    found = fades(good, ["source_id", "band"], min_epochs=least).select("source_id", "band", "slope", "slope_sigma", "n_seasons")
    return n.join(found, ["source_id", "band"], "left").withColumn("n_seasons", F.coalesce("n_seasons", F.lit(0)))


def survey_epochs(epochs: DataFrame, least: int = 20) -> DataFrame:
    """(source_id, mjd, mag, magerr) of an independent survey: good measurements of sources with ``least`` of them, Julian dates made modified ones."""
    good = epochs.filter((c("mag_err") < 0.2) & (c("mag") > 0)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source_id")))
    return good.filter(c("_n") >= least).select("source_id", (c("jd") - 2400000.5).alias("mjd"), "mag", c("mag_err").alias("magerr"))


def tagged_union(emission: DataFrame, absorption: DataFrame) -> DataFrame:
    """Both candidate lists with their search_mode; columns of one list only are NULL in the other."""
    return emission.withColumn("search_mode", F.lit("emission")).unionByName(absorption.withColumn("search_mode", F.lit("absorption")), allowMissingColumns=True)


def sweep_totals(fields: DataFrame) -> DataFrame:
    """(n_fields, n_sources, n_excess) over the fields of a sweep."""
    return fields.agg(F.count(F.lit(1)).alias("n_fields"), F.sum("n_sources").alias("n_sources"), F.sum("n_excess").alias("n_excess"))
