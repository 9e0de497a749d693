"""Scans: fixed schemas, selects that reach the Parquet reader, alias-tolerant columns, arrays from long samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
#: What optional columns hold where a catalogue doesn't give them; a magnitude that it doesn't give is unknown.
CONTRACT_DEFAULTS = {"W1mag_unwise": None, "gaia_nn_arcsec": math.inf, "ext_flg": 0, "cc_flags": "0000", "ph_qual": "AA", "n_wise_neighbours": 1, "known_disk": False, "pmra_error": 1.0, "pmdec_error": 1.0, "e_pmra_wise": 50.0, "e_pmdec_wise": 50.0}
#: Columns that the funnel can't do without.
REQUIRED = ("source_id", "ra", "dec", "pmra", "pmdec", "teff", "W1mag", "e_W1mag", "W2mag", "e_W2mag", "ra_wise", "dec_wise", "Jmag", "Hmag", "Ksmag")


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def ingest(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL; optional columns added with their defaults; required ones checked."""
    missing = [x for x in REQUIRED if x not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    finite = {n: F.when(~F.isnan(c(n)) & (F.abs(c(n)) != math.inf), c(n)) for n, t in df.dtypes if t in ("double", "float")}
    df = df.withColumns(finite) if finite else df
    added = {n: F.lit(v).cast("double") if v is None else F.lit(v) for n, v in CONTRACT_DEFAULTS.items() if n not in df.columns}
    return df.withColumns(added) if added else df


def aliased(df: DataFrame, targets: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each target from its first alias that is present; absent targets are left out."""
    found = {t: next((a for a in names if a in df.columns), None) for t, names in targets.items()}
    return df.select(*(c(a).alias(t) for t, a in found.items() if a))


def parent_sample(df: DataFrame, farthest_pc: float, pwd_min: float) -> DataFrame:
    """Near and confident sources with parallax_over_error; rows without id, position or temperature go."""
    d = df.filter((c("parallax") >= 1000.0 / farthest_pc) & (c("pwd") >= pwd_min)).dropna(subset=["source_id", "ra", "dec", "teff"])
    return d.withColumn("parallax_over_error", F.try_divide(c("parallax"), c("parallax_error")))


def first_rows(df: DataFrame, n: int, key: str = "source_id") -> DataFrame:
    return df.orderBy(key).limit(n)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of the listed ids, one for each id (the least by all columns)."""
    rows = df.join(ids.select(key).distinct(), key, "left_semi")
    rest = [x for x in df.columns if x != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*")


def distance_shell(df: DataFrame, distance_pc: float, half_width: float, g_max: float) -> DataFrame:
    """Stars whose parallax puts them within half_width of a distance, with a radial velocity, up to a magnitude."""
    low, high = 1000.0 / (distance_pc + half_width), 1000.0 / max(distance_pc - half_width, 1.0)
    return df.filter(c("parallax").between(low, high) & c("radial_velocity").isNotNull() & (c("phot_g_mean_mag") < g_max))


def samples_to_arrays(samples: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, wave, flux) arrays in order of wavelength from one row for each sample."""
    packed = F.array_sort(F.collect_list(F.struct("wave", "flux")))
    return samples.groupBy(key).agg(packed.alias("_s")).select(key, F.transform("_s", lambda x: x["wave"]).alias("wave"), F.transform("_s", lambda x: x["flux"]).alias("flux"))


def aligned(meta: DataFrame, arrays: DataFrame, n: int, key: str = "source_id") -> DataFrame:
    """Metadata with spectra of the right length."""
    return meta.join(arrays.filter(F.size("flux") == n), key)


def valid_spectra(df: DataFrame, least: int = 100) -> DataFrame:
    """Spectra long enough with equal lengths; missing masks are zero, missing redshifts 0; resolution by release."""
    from skysift.operators.spectra import RESOLUTION

    d = df.filter((F.size("flux") >= least) & (F.size("flux") == F.size("wave")) & (F.size("flux") == F.size("ivar")))
    table = F.create_map(*(F.lit(x) for pair in RESOLUTION.items() for x in pair))
    return d.withColumns({"mask": F.coalesce("mask", F.array_repeat(F.lit(0), F.size("flux"))), "redshift": F.coalesce("redshift", F.lit(0.0)), "resolution": table[c("release")]})


def good_epochs(df: DataFrame, times: Sequence[str] = ("mjd", "hjd", "bjd"), bad_bits: int = 32768) -> DataFrame:
    """Epochs with a time (first column that is present), a magnitude and no bad-quality bit."""
    at = next(t for t in times if t in df.columns)
    d = df.withColumn("mjd", F.expr(f"try_cast(`{at}` AS DOUBLE)")).filter(c("mjd").isNotNull() & c("mag").isNotNull())
    return d.filter(c("catflags").bitwiseAND(F.lit(bad_bits)) == 0) if "catflags" in df.columns else d


def region_sources(epochs: DataFrame, min_epochs: int) -> DataFrame:
    """(oid, n, ra, dec, channel): objects with enough epochs, median positions and readout channel (x for a missing part)."""
    channel = F.concat_ws("_", *(F.coalesce(c(x).cast("string"), F.lit("x")) for x in ("field", "ccdid", "qid")))
    one = epochs.groupBy("oid").agg(F.count(F.lit(1)).alias("n"), F.percentile(c("ra"), F.lit(0.5)).alias("ra"), F.percentile(c("dec"), F.lit(0.5)).alias("dec"), F.min(channel).alias("channel"))
    return one.filter(c("n") >= min_epochs)


def tiles(spark: SparkSession, ra0: float, dec0: float, half: float, step: float) -> DataFrame:
    """(tile, ra_lo, ra_hi, dec_lo, dec_hi): boxes over a square field; steps in right ascension widen with declination."""
    n = math.ceil(2 * half / step)
    grid = spark.range(n * n).select(c("id").alias("tile"), (F.floor(c("id") / n) * step + dec0 - half).alias("dec_lo"), (c("id") % n).alias("_i"))
    width = step / F.cos(F.radians(c("dec_lo") + step / 2))
    return grid.select("tile", (c("_i") * width + ra0 - width * n / 2).alias("ra_lo"), ((c("_i") + 1) * width + ra0 - width * n / 2).alias("ra_hi"), "dec_lo", (c("dec_lo") + step).alias("dec_hi"))


def in_tiles(df: DataFrame, boxes: DataFrame, margin: float, key: str = "source_id") -> DataFrame:
    """Rows inside any box widened by margin, each once (in its lowest tile). Boxes are a field's grid, broadcast."""
    inside = c("ra").between(c("ra_lo") - margin, c("ra_hi") + margin) & c("dec").between(c("dec_lo") - margin, c("dec_hi") + margin)
    return df.join(F.broadcast(boxes), inside).groupBy(key).agg(F.min("tile").alias("tile"), F.first("ra").alias("ra"), F.first("dec").alias("dec"))


def union_of_fields(spark: SparkSession, glob: str, schema: str, kind: str) -> DataFrame:
    """Per-field CSV files as one table with the folder they came from."""
    d = spark.read.schema(schema).option("header", True).csv(glob)
    return d.withColumns({"field_dir": F.element_at(F.split(F.input_file_name(), "/"), -2), "cand_type": F.lit(kind)})


def summaries(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(glob)
