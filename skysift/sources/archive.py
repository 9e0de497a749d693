"""Archive scans: what the searches select from source, solution, photometry, spectrum and planet tables, and the lists they hand on.

``n`` keeps the first n rows in the order that is named, ties to the smaller id; None keeps all rows, in no order. A comparison with an
unknown value doesn't hold. Filters are plain comparisons, so that they reach the Parquet reader; joins are on ids and left to Spark's
size threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.exprs import absolute_magnitude
from skysift.operators import xmatch

c = F.col
#: Columns of each scan.
TARGETS = ("source_id", "ra", "dec", "phot_g_mean_mag", "bp_rp", "parallax", "parallax_over_error", "phot_variable_flag")
ASTROMETRY = ("ra", "dec", "parallax", "parallax_over_error", "phot_g_mean_mag", "bp_rp", "ruwe")
ELEMENTS = ("source_id", "period", "eccentricity", "a_thiele_innes", "b_thiele_innes", "f_thiele_innes", "g_thiele_innes")
PLANETS = ("hostname", "gaia_id", "ra", "dec", "sy_dist", "pl_name", "pl_rade", "pl_bmasse", "pl_orbper", "pl_eqt", "pl_insol", "st_teff")


def _first(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def in_cone(df: DataFrame, ra0: float, dec0: float, radius_deg: float) -> DataFrame:
    """Rows within a great-circle distance of a place; the range of declinations reaches the reader."""
    north, east = F.radians(c("dec") - dec0) / 2, F.radians(c("ra") - ra0) / 2
    chord = F.pow(F.sin(north), 2) + F.cos(F.radians(c("dec"))) * F.cos(F.radians(F.lit(dec0))) * F.pow(F.sin(east), 2)
    return df.filter(c("dec").between(dec0 - radius_deg, dec0 + radius_deg) & (2 * F.degrees(F.asin(F.sqrt(F.least(chord, F.lit(1.0))))) <= radius_deg))


def field_targets(sources: DataFrame, ra: float, dec: float, radius_deg: float = 1.5, g_min: float = 13.0, g_max: float = 18.5, variable_only: bool = True, n: int | None = None) -> DataFrame:
    """Stars of a field north of -28 degrees in a window of magnitudes, flagged as variable unless all are wanted; by id."""
    d = in_cone(sources, ra, dec, radius_deg).filter(c("phot_g_mean_mag").between(g_min, g_max) & (c("dec") > -28.0))
    if variable_only:
        d = d.filter(c("phot_variable_flag") == "VARIABLE")
    return _first(d.select(*TARGETS), n, "source_id")


def cone_stars(sources: DataFrame, measured: DataFrame, ra: float, dec: float, radius_deg: float, plx_min: float, g_max: float) -> DataFrame:
    """Stars of a cone with good astrometry that have a row in ``measured`` (source_id and further columns)."""
    good = (c("parallax") > plx_min) & (c("parallax_over_error") > 10) & (c("phot_g_mean_mag") < g_max) & (c("ruwe") < 1.4)
    return in_cone(sources, ra, dec, radius_deg).filter(good).select("source_id", *ASTROMETRY, "pmra", "pmdec").join(measured, "source_id")


def anchor_shell(sources: DataFrame, distance_pc: float, half_width: float, g_max: float) -> DataFrame:
    """Stars with a radial velocity and good astrometry whose parallax puts them inside the shell around an anchor's distance."""
    low, high = 1000.0 / (distance_pc + half_width), 1000.0 / max(distance_pc - half_width, 1.0)
    good = (c("parallax") > low) & (c("parallax") < high) & (c("parallax_over_error") > 8) & c("radial_velocity").isNotNull() & (c("ruwe") < 1.4)
    return sources.filter(good & (c("phot_g_mean_mag") < g_max)).select("source_id", *ASTROMETRY, "pmra", "pmdec", "radial_velocity")


def orbit_solutions(orbits: DataFrame, sources: DataFrame, plx_min: float, n: int | None = None) -> DataFrame:
    """Astrometric orbits that have their elements, with the astrometry of their sources; greatest parallax first."""
    o = orbits.filter(c("nss_solution_type").startswith("Orbital") & c("a_thiele_innes").isNotNull()).select(*ELEMENTS)
    s = sources.filter(c("parallax") > plx_min).select("source_id", *ASTROMETRY)
    return _first(o.join(s, "source_id"), n, F.desc("parallax"), "source_id")


def acceleration_solutions(accelerations: DataFrame, sources: DataFrame, plx_min: float, significance_min: float, n: int | None = None) -> DataFrame:
    """Significant accelerations with the astrometry of their sources; most significant first."""
    a = accelerations.filter(c("significance") > significance_min).select("source_id", "accel_ra", "accel_dec", "accel_ra_error", "accel_dec_error", c("significance").alias("gaia_significance"))
    s = sources.filter(c("parallax") > plx_min).select("source_id", *ASTROMETRY)
    return _first(a.join(s, "source_id"), n, F.desc("gaia_significance"), "source_id")


def spectrum_sources(sources: DataFrame, ra: float, dec: float, radius_deg: float = 1.0, g_max: float = 17.5, n: int | None = None) -> DataFrame:
    """Sources of a cone that have a sampled low-resolution spectrum, up to a magnitude; by id."""
    return _first(in_cone(sources, ra, dec, radius_deg).filter(c("has_xp_sampled") & (c("phot_g_mean_mag") < g_max)), n, "source_id")


def spectrum_ids(spectra: DataFrame, release: str, kind: str | None = None, n: int | None = None) -> DataFrame:
    """Ids of a release's spectra, of one type if it is named; by id."""
    d = spectra.filter(c("data_release") == release)
    d = d.filter(c("spectype") == kind) if kind else d
    return _first(d.select("spec_id"), n, "spec_id")


def near_infrared(ids: DataFrame, neighbours: DataFrame, links: DataFrame, photometry: DataFrame) -> DataFrame:
    """J, H and Ks of the listed sources by way of best neighbours (source_id, clean_oid) and links (clean_oid, designation)."""
    wanted = neighbours.join(ids.select("source_id"), "source_id", "left_semi")
    bands = [c(x).alias(y) for x, y in (("j_m", "Jmag"), ("j_msigcom", "e_Jmag"), ("h_m", "Hmag"), ("h_msigcom", "e_Hmag"), ("ks_m", "Ksmag"), ("ks_msigcom", "e_Ksmag"))]
    return wanted.join(links, "clean_oid").join(photometry, "designation").select("source_id", *bands)


def columns_of(ids: DataFrame, sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns of the listed sources."""
    return sources.join(ids.select("source_id"), "source_id", "left_semi").select("source_id", *columns)


def nearby_planets(planets: DataFrame, max_pc: float = 80.0) -> DataFrame:
    """Planets whose system is known to be nearer than max_pc, with the columns in use that are present (names in lower case)."""
    d = planets.select(*(c(f"`{x}`").alias(x.lower()) for x in planets.columns))
    return d.filter(c("sy_dist") < max_pc).select(*(x for x in PLANETS if x in d.columns))


def field_candidates(kinds: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each source over the candidate lists of all fields, with cand_type: dipper, secular_fader or glint.

    Dippers stay if they resist mundane explanations, the others if they are on the main sequence; a list without that column stays
    whole. Of several rows of a source the earliest kind in ``kinds`` counts, then the first field_dir, then the least by all columns.
    """
    kept = []
    for at, (kind, d) in enumerate(kinds.items()):
        if kind == "dipper" and "resists_mundane" in d.columns:
            d = d.filter(F.lower(c("resists_mundane").cast("string")).isin("true", "1")).withColumn("resists_mundane", F.lit(True))
        elif kind != "dipper" and "hr_class" in d.columns:
            d = d.filter(c("hr_class") == "main_sequence")
        kept.append(d.withColumns({"cand_type": F.lit(kind), "_kind": F.lit(at)}))
    both = kept[0]
    for d in kept[1:]:
        both = both.unionByName(d, allowMissingColumns=True)
    rest = [x for x in both.columns if x not in ("source_id", "field_dir", "_kind")]
    return both.groupBy("source_id").agg(F.min(F.struct("_kind", "field_dir", *rest)).alias("_r")).select("source_id", "_r.*").drop("_kind")


def nearest_sources(positions: DataFrame, sources: DataFrame, radius_arcsec: float = 3.0, key: str = "name") -> DataFrame:
    """The nearest source of each position with its distance, absolute magnitude and separation; positions without one are left out."""
    columns = ("parallax", "phot_g_mean_mag", "bp_rp", "ruwe")
    near = xmatch.nearest(positions, sources.withColumnRenamed("source_id", "gaia_source_id"), radius_arcsec, key, "gaia_source_id", ("gaia_source_id", *columns))
    known = {"distance_pc": F.when(c("parallax") > 0, 1000.0 / c("parallax")), "abs_g": absolute_magnitude(c("phot_g_mean_mag"), c("parallax"))}
    return near.withColumns(known).withColumnRenamed("sep", "match_arcsec").select(key, "gaia_source_id", *columns, "distance_pc", "abs_g", "match_arcsec")


def enriched(candidates: DataFrame, wise: DataFrame, twomass: DataFrame, objects: DataFrame, radius_arcsec: float = 3.0) -> DataFrame:
    """Candidates with the nearest infrared magnitudes and object type, the colours W1_W2 and K_W2, and ir_verdict.

    wise: (cand_id, ra, dec, W1mag, W2mag); twomass: Jmag, Hmag, Ksmag likewise; objects: otype likewise. What isn't found is NULL.
    """
    places, out = candidates.select("source_id", "ra", "dec"), candidates
    for table, columns in ((wise, ("W1mag", "W2mag")), (twomass, ("Jmag", "Hmag", "Ksmag")), (objects, ("otype",))):
        found = xmatch.nearest(places, table, radius_arcsec, b_cols=("cand_id", *columns)).select("source_id", *columns)
        out = out.drop(*columns).join(found, "source_id", "left")
    verdict = xmatch.excess_verdict(c("W1mag"), c("W2mag"), c("Ksmag"), c("otype"))
    return out.withColumns({"W1_W2": c("W1mag") - c("W2mag"), "K_W2": c("Ksmag") - c("W2mag"), "ir_verdict": verdict})


def confirm_shortlist(raw: DataFrame, n: int, triaged: DataFrame | None = None) -> DataFrame:
    """The n lines to confirm: triaged ones by significance, else raw ones by hunt_rank, of spectra with a single line where that is known."""
    d, column = (raw, "hunt_rank") if triaged is None else (triaged, "significance")
    d = d.filter(c("n_lines_in_spectrum") == 1) if "n_lines_in_spectrum" in d.columns else d
    return _first(d, n, *([F.desc_nulls_last(column)] if column in d.columns else []), "spec_id", "wavelength")
