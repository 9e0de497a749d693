"""Decisions over joined results: object classes, companions, colours, trends, dossiers. All are CASE columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.tables import written
from skysift.operators import lightcurve
from skysift.operators.xmatch import excess_verdict

c = F.col


#: Parts of types, and of spectral types, that name a class.
INTERACTING, ECLIPSING, POLLUTED, WHITE_DWARFS = ("CV", "NOVA", "AM CVN", "AMCVN", "NL"), ("EB", "ECL", "ALGOL", "BETA LYR", "WUMA"), ("DAZ", "DBZ", "DZ", "DZA"), ("DA", "DB", "DC", "DO", "DQ")


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(x)) for x in parts), F.lit(False))


def _known(x: Column) -> Column:
    """A number, NULL where it isn't finite."""
    return F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double"))


def object_class(kind: Column, spectral: Column) -> Column:
    """What an object is by its type and spectral type, the most telling first; unexamined without either."""
    blank = lambda x: F.when(x.isin("NAN", "NONE"), "").otherwise(x)
    k, s = (blank(F.upper(F.trim(F.coalesce(x, F.lit(""))))) for x in (kind, spectral))
    return (
        F.when((k == "") & (s == ""), "unexamined")
        .when(_holds(k, INTERACTING), "interacting binary (CV)")
        .when(_holds(k, ECLIPSING), "eclipsing binary")
        .when(_holds(s, ("+M", "+K")), "WD+dwarf binary")
        .when(_holds(s, POLLUTED), "metal-polluted WD (disk)")
        .when(_holds(k, ("**", "SB", "BINARY")), "binary")
        .when(_holds(k, ("WD",)) | F.substring(s, 1, 2).isin(*WHITE_DWARFS), "white dwarf (other)")
        .when(k == "", "unexamined")
        .otherwise(F.lower(k))
    )


def shape_class(quasar: Column, galaxy: Column, abs_g: Column, colour: Column, variable: Column, non_single: Column) -> Column:
    """What else a shape anomaly may be, else clean."""
    return (
        F.when(_known(quasar) > 0.5, "quasar").when(_known(galaxy) > 0.5, "galaxy").when((_known(abs_g) > 10) & (_known(colour) < 1.5), "white_dwarf")
        .when(F.coalesce(F.upper(variable).startswith("VARIABLE"), F.lit(False)), "known_variable").when(F.coalesce(non_single, F.lit(0)) > 0, "non_single_star").otherwise("clean")
    )


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def companion_reasons(ruwe: Column, noise: Column, noise_sig: Column, multi_peak: Column, non_single: Column) -> Column:
    return reasons(high_ruwe=_known(ruwe) > 1.4, excess_noise=(_known(noise) >= 1) & (_known(noise_sig) > 5), multi_peak=_known(multi_peak) > 10, non_single=_known(non_single) > 0)


def colour_reasons(w1: Column, w2: Column, w3: Column, w4: Column, e1: Column, e2: Column, e3: Column, e4: Column) -> Column:
    """Infrared colours that are red by a margin and by more than three sigma, of the errors that are known."""
    square = lambda e: F.coalesce(_known(e) * _known(e), F.lit(0.0))
    colour = lambda x: _known(w1) - _known(x)
    red = lambda x, e, least: (colour(x) > least) & (colour(x) / F.sqrt(square(e1) + square(e) + 1e-6) > 3)
    return reasons(w1_w2=red(w2, e2, 0.35), w1_w3=red(w3, e3, 0.6), w1_w4=red(w4, e4, 0.9))


def infrared_counterpart(optical: Column, *bands: tuple[Column, Column], sig_min: float = 2.0) -> Column:
    """What the infrared bands, each a (slope, sigma), say of an optical fade.

    A band counts where both are known. One that brightens significantly settles it; else the ratios of the bands that fade
    significantly to the optical slope.
    """
    any_of = lambda test: F.greatest(*(F.coalesce(test(_known(s), _known(z)), F.lit(False)) for s, z in bands), F.lit(False))
    optical = _known(optical)
    ratio = lambda low, high: any_of(lambda s, z: (s > 0) & (z >= sig_min) & (s / optical).between(low, high))
    return (
        F.when(optical.isNull() | (optical <= 0) | ~any_of(lambda s, z: s.isNotNull() & z.isNotNull()), "insufficient_ir")
        .when(any_of(lambda s, z: (s < 0) & (z >= sig_min)), "ir_brightens_dusty")
        .when(ratio(0.3, float("inf")), "ir_fades_gray_occulter")
        .when(ratio(0.02, 0.15), "ir_fades_reddening_law")
        .otherwise("ir_flat_chromatic_fade")
    )


def infrared_trend(slope: Column, sigma: Column) -> Column:
    """Text of a significant trend, else steady."""
    strong = (F.abs(sigma) >= 5) & (F.abs(slope) >= 0.02)
    sense = F.when(slope < 0, "brightening").otherwise("fading")
    return F.when(strong, F.format_string("%s at %.3f mag/yr", sense, F.abs(slope))).otherwise("steady")


def candidate_flags(ruwe: Column, non_single: Column, variable: Column, slope: Column, sigma: Column) -> Column:
    """Notes on a candidate, with what an independent survey's fade says."""
    fades = (slope > 0) & (sigma > 2)
    return reasons(high_ruwe=ruwe > 1.4, non_single=non_single > 0, variable=F.upper(variable).startswith("VARIABLE"), fade_confirmed=fades, fade_not_confirmed=sigma.isNotNull() & ~F.coalesce(fades, F.lit(False)))


def band_verdicts(kinds: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, kind, n_bands, bands, verdict) from (key, band, kind, qualifies): confirmed in two bands, else needs_vetting."""
    ok = F.when(c("qualifies"), c("band"))
    one = kinds.groupBy(key, "kind").agg(F.count_if("qualifies").alias("n_bands"), F.array_join(F.array_sort(F.collect_set(ok)), ",").alias("bands"))
    return one.filter("n_bands > 0").withColumn("verdict", F.when(c("n_bands") >= 2, "confirmed").otherwise("needs_vetting"))


def rollup(df: DataFrame, flags: list[str]) -> DataFrame:
    """Add anomaly_flagged: whether any flag holds."""
    return df.withColumn("anomaly_flagged", F.greatest(*(F.coalesce(c(f), F.lit(False)) for f in flags)))


def coverage(reason: Column) -> Column:
    """no_data where a reason tells of a failure, else ok."""
    return F.when(F.coalesce(F.lower(reason).rlike("failed|unavailable|no "), F.lit(True)), "no_data").otherwise("ok")


#: Verdicts of the candidates that nothing explains away.
GOLD = ("clean_achromatic", "clean_secular_fade", "clean_glint")


def vet_verdict(ir: Column, kind: Column, total_mag: Column, bp_rp: Column, fade_confirmed: Column, flash_confirmed: Column, n_bands: Column, frac_confirmed: Column) -> Column:
    """Final decision on a candidate.

    The infrared verdict unless that is clean; then by its type (secular_fader, glint, else a dipper): a fade must be deep
    enough, of a star that isn't an active dwarf, and in two bands; a flash alike in two bands; half of the dips in another band.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    fade = (
        F.when(F.coalesce(F.abs(_known(total_mag)), F.lit(0.0)) < 0.08, "marginal_fade")
        .when(yes(_known(bp_rp) > 0.9), "active_dwarf_fade")
        .when(yes(fade_confirmed), "clean_secular_fade")
        .otherwise("single_band_fade")
    )
    dip = F.when((F.coalesce(n_bands, F.lit(0)) < 2) | _known(frac_confirmed).isNull(), "single_band_unconfirmed").when(frac_confirmed >= 0.5, "clean_achromatic").otherwise("single_band_artifact")
    clean = F.when(yes(kind == "secular_fader"), fade).when(yes(kind == "glint"), F.when(yes(flash_confirmed), "clean_glint").otherwise("chromatic_flare")).otherwise(dip)
    return F.when(ir != "clean", ir).otherwise(clean)


#: The order in which a source that is a candidate of several types is taken.
TYPES = ("dipper", "secular_fader", "glint")


def vet_run(candidates: DataFrame, photometry: DataFrame, curves: DataFrame, bands: tuple[str, ...] = ("g", "r", "i")) -> DataFrame:
    """One row for each candidate: ir_verdict, the band check of its type, and the verdict.

    candidates: (source_id, cand_type, secular_total_mag, bp_rp), of which the first type of a source counts; photometry:
    (source_id, W1mag, W2mag, Ksmag, otype), one row a source; curves: (source_id, band, mjd, mag, magerr, tiebreak). The epochs of
    candidates that the infrared doesn't rule out meet their candidate's type in one join, and each type's check reads its own.
    """
    order = F.coalesce(F.array_position(F.array(*map(F.lit, TYPES)), c("cand_type")), F.lit(0))
    first = candidates.groupBy("source_id").agg(F.min_by(F.struct("cand_type", "secular_total_mag", "bp_rp"), F.struct(F.when(order == 0, 9).otherwise(order), "secular_total_mag", "bp_rp")).alias("x")).select("source_id", "x.*")
    judged = written(first.join(photometry, "source_id", "left").withColumn("ir_verdict", excess_verdict(c("W1mag"), c("W2mag"), c("Ksmag"), c("otype"))))
    asked = judged.filter(c("ir_verdict").isin("clean", "no_ir_data")).select("source_id", "cand_type")
    routed = curves.filter(c("band").isin(*bands)).join(asked, "source_id")
    of = lambda kind: routed.filter(c("cand_type") == kind)
    both = ["source_id", "band"]
    enough = lambda df, n: df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*both))).filter(c("_n") >= n).drop("_n")

    dips = enough(of("dipper"), 20).withColumn("magerr", F.when(_known(c("magerr")) > 0, c("magerr")).otherwise(0.05))
    flagged = lightcurve.flag_dips(dips, both, 0.10, 3.0)
    seen = flagged.groupBy("source_id").agg(F.count_distinct("band").cast("int").alias("n_bands"))
    met = lightcurve.band_coincidence(flagged, bands=bands).select("source_id", c("coincident").alias("frac_confirmed"))
    pair = bands[:2]
    fades = lightcurve.fade_colours(lightcurve.fades(of("secular_fader").filter(c("band").isin(*pair)), both), bands=pair).select("source_id", c("achromatic").alias("secular_confirmed"))
    flashes = lightcurve.flash_colours(enough(of("glint").filter(c("band").isin(*pair)), 20), bands=pair).select("source_id", c("achromatic").alias("glint_confirmed"))
    out = judged
    for part in (seen.join(met, "source_id", "left"), fades, flashes):
        out = out.join(part, "source_id", "left")
    out = out.withColumns({"n_bands": F.coalesce("n_bands", F.lit(0)), **{x: F.coalesce(x, F.lit(False)) for x in ("secular_confirmed", "glint_confirmed")}})
    verdict = vet_verdict(c("ir_verdict"), c("cand_type"), c("secular_total_mag"), c("bp_rp"), c("secular_confirmed"), c("glint_confirmed"), c("n_bands"), c("frac_confirmed"))
    return out.select("source_id", "cand_type", "ir_verdict", "frac_confirmed", "n_bands", "secular_confirmed", "glint_confirmed", verdict.alias("verdict"))


def shortlist(scored: DataFrame, n: int) -> DataFrame:
    """Objects flagged on an axis or with an excess: most flags first, then the largest significance."""
    chosen = scored.filter((c("n_axes") >= 1) | c("has_excess")).dropDuplicates(["source_id"])
    return chosen.orderBy(F.desc("n_axes"), F.desc_nulls_last("chi_W2"), "source_id").limit(n)


def dossier(targets: DataFrame, parts: dict[str, DataFrame], key: str = "source_id") -> DataFrame:
    """One row for each target with every part as a struct, NULL where a part has no row. Parts are unique by key."""
    for name, part in parts.items():
        packed = part.select(key, F.struct(*(x for x in part.columns if x != key)).alias(name))
        targets = targets.join(packed, key, "left")
    return targets
