"""Phase space, close encounters, their uncertainties, and destinations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.functions.batches import whole_keys
from skysift.functions.exprs import KMS_PER_MASYR_KPC, clip, held
from skysift.functions.quantiles import quantiles
from skysift.functions.tables import let_workers_import, written

c = F.col
#: Rotation from equatorial to Galactic axes.
ROTATION = (
    (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
    (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
    (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
)
#: pc/Myr for one km/s; light-years and au in a parsec; solar GM (km3/s2); km in a parsec.
PC_PER_MYR, LY_PER_PC, AU_PER_PC, GM_SUN, PC_KM = 1.0227121651, 3.2615638, 206264.806, 1.32712440018e11, 3.0856775815e13
#: Colour and absolute magnitude along the main sequence.
RIDGE = ((-0.1, 0.6), (0.0, 1.1), (0.5, 3.5), (0.82, 4.67), (1.0, 5.4), (1.5, 7.0), (2.0, 8.8), (2.5, 11.0), (3.0, 12.5), (3.5, 13.6), (4.0, 14.5))
POSITION, VELOCITY = ("X_pc", "Y_pc", "Z_pc"), ("U_kms", "V_kms", "W_kms")


def _rotated(x: Column, y: Column, z: Column) -> list[Column]:
    return [x * r[0] + y * r[1] + z * r[2] for r in ROTATION]


def galactic_position(df: DataFrame, floor: float = 0.2) -> DataFrame:
    """Add dist_pc and X, Y, Z; NULL below the parallax floor."""
    ra, dec = F.radians("ra"), F.radians("dec")
    df = df.withColumn("dist_pc", F.when(c("parallax") >= floor, 1000.0 / c("parallax")))
    place = _rotated(F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec))
    return df.withColumns({n: e * c("dist_pc") for n, e in zip(POSITION, place)})


def tangential_velocity(df: DataFrame) -> DataFrame:
    """Add vtan_ra, vtan_dec and vtan (km/s)."""
    d = F.when(c("parallax") > 0, F.lit(KMS_PER_MASYR_KPC) / c("parallax"))
    df = df.withColumns({"vtan_ra": c("pmra") * d, "vtan_dec": c("pmdec") * d})
    return df.withColumn("vtan", F.hypot("vtan_ra", "vtan_dec"))


def phase_space(df: DataFrame, floor: float = 0.5) -> DataFrame:
    """Add position and velocity; velocities are NULL without a radial velocity."""
    place = ("dist_pc", *POSITION)
    df = galactic_position(df, floor).withColumnsRenamed({n: f"_{n}" for n in place})
    ra, dec, rv = F.radians("ra"), F.radians("dec"), c("radial_velocity")
    a, d = (c(p) * c("_dist_pc") * (KMS_PER_MASYR_KPC / 1000.0) for p in ("pmra", "pmdec"))
    x = rv * F.cos(dec) * F.cos(ra) - a * F.sin(ra) - d * F.sin(dec) * F.cos(ra)
    y = rv * F.cos(dec) * F.sin(ra) + a * F.cos(ra) - d * F.sin(dec) * F.sin(ra)
    z = rv * F.sin(dec) + d * F.cos(dec)
    # held, as what follows uses each of them several times
    return held(df, {**{n: c(f"_{n}") for n in place}, **dict(zip(VELOCITY, _rotated(x, y, z)))}).drop(*(f"_{n}" for n in place))


def closest_approach(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """Add sep_now, v_rel, t_enc (Myr) and d_min of straight paths past the one-row anchor."""
    one = anchor.select(*(c(n).alias(f"_{n}") for n in POSITION + VELOCITY)).limit(1)
    return approach(df.join(F.broadcast(one), F.lit(True)))


def approach(df: DataFrame) -> DataFrame:
    """closest_approach() of rows that hold the anchor's position and velocity as columns with _ before their names, which are dropped."""
    dr = [c(n) - c(f"_{n}") for n in POSITION]
    dv = [c(n) - c(f"_{n}") for n in VELOCITY]
    df = df.withColumns({"sep_now_pc": F.sqrt(sum((x * x for x in dr), F.lit(0.0))), "v_rel_kms": F.sqrt(sum((x * x for x in dv), F.lit(0.0)))})
    dot = sum((r * v for r, v in zip(dr, dv)), F.lit(0.0)) * PC_PER_MYR
    df = df.withColumn("t_enc_myr", F.when(c("v_rel_kms") > 0, -dot / F.pow(c("v_rel_kms") * PC_PER_MYR, 2)))
    ends = [r + v * c("t_enc_myr") * PC_PER_MYR for r, v in zip(dr, dv)]
    df = df.withColumn("d_min_pc", F.sqrt(sum((x * x for x in ends), F.lit(0.0))))
    return df.drop(*(f"_{n}" for n in POSITION + VELOCITY))


def transfer(df: DataFrame, oldest: float = 10.0) -> DataFrame:
    """Add past_encounter, transfer_score and comoving."""
    past = F.coalesce((c("t_enc_myr") < 0) & (c("t_enc_myr") >= -oldest), F.lit(False))
    score = 1.0 / (F.greatest("d_min_pc", F.lit(0.01)) * F.pow(F.greatest("v_rel_kms", F.lit(0.1)), 2))
    near = F.coalesce((c("v_rel_kms") <= 3) & (c("sep_now_pc") <= 5), F.lit(False))
    return df.withColumns({"past_encounter": past, "transfer_score": F.when(past, score).otherwise(0.0), "comoving": near})


def regime(df: DataFrame, reservoir: Column, donor_mass: float = 0.36) -> DataFrame:
    """Add escape speed at closest approach, focusing, within, capturable and transfers."""
    escape = F.sqrt(F.try_divide(F.lit(2.0 * GM_SUN * donor_mass / PC_KM), c("d_min_pc")))
    df = df.withColumns({"v_esc_kms": escape, "within_reservoir": c("d_min_pc") < reservoir})
    df = df.withColumns({"capturable": c("v_rel_kms") < c("v_esc_kms"), "focusing": 1.0 + F.pow(F.try_divide(c("v_esc_kms"), c("v_rel_kms")), 2)})
    return df.withColumn("transfers", c("within_reservoir") & c("capturable"))


def regime_sweep(df: DataFrame, reservoirs: tuple[float, ...] = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0), donor_mass: float = 0.36) -> DataFrame:
    """Summary of past encounters for each reservoir radius; the radii are exploded inside each row."""
    rows = df.filter("t_enc_myr < 0").withColumn("reservoir", F.explode(F.array(*map(F.lit, reservoirs))))
    r = regime(rows, c("reservoir"), donor_mass)
    # the median is the same for every reservoir
    median = quantiles(df.filter("t_enc_myr < 0"), [], "v_rel_kms", [0.5]).select(c("q")[0].alias("v_rel_median"))
    one = r.groupBy("reservoir").agg(
        F.count(F.lit(1)).alias("n_past"), F.min("v_rel_kms").alias("v_rel_min"), F.min("d_min_pc").alias("d_min_min"),
        F.count_if("within_reservoir").alias("n_within"), F.count_if("capturable").alias("n_capturable"), F.count_if("transfers").alias("n_transfers"),
        F.min_by(c("v_rel_kms") / c("v_esc_kms"), F.struct("d_min_pc", "source_id")).alias("speed_excess"), F.max("focusing").alias("max_focusing"),
    )
    return one.join(F.broadcast(median), F.lit(True)).select("reservoir", "n_past", "v_rel_min", "v_rel_median", "d_min_min", "n_within", "n_capturable", "n_transfers", "speed_excess", "max_focusing")


def keyed_uniform(key: np.ndarray, draw: np.ndarray, stream: int) -> np.ndarray:
    """Uniform numbers in (0, 1), a row for each key and a column for each draw, that depend on key, draw and stream alone, in plain integer arithmetic."""
    low = np.int64(4294967295)
    x = ((key & np.int64(2147483647)) * np.int64(2654435761))[:, None] + (draw * np.int64(40503) + np.int64(stream * 69069 + 12345))
    x = ((x & low) * np.int64(1103515245) + np.int64(12345)) & low
    x = ((x & np.int64(65535)) * np.int64(65539) + (x >> np.int64(16)) * np.int64(40503) + np.int64(7)) & low
    return (x + 0.5) / 4294967296.0


def keyed_normal(key: np.ndarray, draw: np.ndarray, stream: int) -> np.ndarray:
    return np.sqrt(np.log(keyed_uniform(key, draw, stream)) * -2.0) * np.cos(keyed_uniform(key, draw, stream + 1) * (2 * math.pi))


#: What is drawn, each from its own column ``<name>_error``.
DRAWN = ("parallax", "pmra", "pmdec", "radial_velocity")
#: Stars whose draws a task holds at a time, and the least number of tasks for a core.
TOGETHER, TASKS = 64, 4


def _star(df: DataFrame) -> list[Column]:
    """Place, values of DRAWN and their errors as doubles; an error that is NULL or not above 0 is 0."""
    error = lambda n: F.when(c(f"{n}_error") < float("inf"), F.greatest(c(f"{n}_error"), F.lit(0.0)))
    return [*(c(n).cast("double") for n in ("ra", "dec", *DRAWN)), *(F.coalesce(error(n), F.lit(0.0)).cast("double") for n in DRAWN)]


def _drawn_motion(ident: np.ndarray, star: np.ndarray, draw: np.ndarray, stream: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """phase_space() of Gaussian draws around stars' own values, a row for each star: positions and velocities, NaN where they aren't known.

    Numbers depend on the star's id, the draw and the stream alone, so results don't depend on partitioning.
    """
    plx, pmra, pmdec, rv = (star[:, 2 + i, None] + keyed_normal(ident, draw, stream + 2 * i) * star[:, 6 + i, None] for i in range(len(DRAWN)))
    ra, dec = np.radians(star[:, 0, None]), np.radians(star[:, 1, None])
    sin_a, cos_a, sin_d, cos_d = np.sin(ra), np.cos(ra), np.sin(dec), np.cos(dec)
    dist = np.where(plx >= 0.5, 1000.0 / plx, np.nan)
    rotated = lambda x, y, z: [x * r[0] + y * r[1] + z * r[2] for r in ROTATION]
    a, d = (p * dist * (KMS_PER_MASYR_KPC / 1000.0) for p in (pmra, pmdec))
    x = rv * cos_d * cos_a - a * sin_a - d * sin_d * cos_a
    y = rv * cos_d * sin_a + a * cos_a - d * sin_d * sin_a
    return [e * dist for e in rotated(cos_d * cos_a, cos_d * sin_a, sin_d)], rotated(x, y, rv * sin_d + d * cos_d)


def _passes(ident: np.ndarray, star: np.ndarray, anchor: tuple[list[np.ndarray], list[np.ndarray]], draw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """approach() of each draw: d_min, t_enc and v_rel, all NaN where a draw has no finite result."""
    place, motion = _drawn_motion(ident, star, draw, 0)
    dr, dv = [p - q for p, q in zip(place, anchor[0])], [p - q for p, q in zip(motion, anchor[1])]
    v = np.sqrt(dv[0] * dv[0] + dv[1] * dv[1] + dv[2] * dv[2])
    t = np.where(v > 0, -((dr[0] * dv[0] + dr[1] * dv[1] + dr[2] * dv[2]) * PC_PER_MYR) / (v * PC_PER_MYR) ** 2, np.nan)
    ends = [p + q * t * PC_PER_MYR for p, q in zip(dr, dv)]
    d = np.sqrt(ends[0] * ends[0] + ends[1] * ends[1] + ends[2] * ends[2])
    fine = np.isfinite(d) & np.isfinite(t)
    return tuple(np.where(fine, x, np.nan) for x in (d, t, v))


def _summed(d: np.ndarray, t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A row for each star: number of valid draws, percentiles 16, 50 and 84 of each (as ``percentile`` interpolates), and the three shares; NaN where none is valid."""
    n = np.isfinite(d).sum(axis=1)
    last = np.maximum(n - 1, 0)
    out = [n.astype(float)]
    for x in (d, t, v):
        x = np.sort(x, axis=1)  # NaN last
        for p in (0.16, 0.5, 0.84):
            at = last * p
            low, high = np.floor(at), np.ceil(at)
            a, z = (np.take_along_axis(x, i.astype(np.int64)[:, None], axis=1)[:, 0] for i in (low, high))
            out.append(np.where(a == z, a, (high - at) * a + (at - low) * z))
    share = lambda test: np.where(n > 0, test.sum(axis=1) / np.maximum(n, 1), np.nan)
    return np.stack([*out, share(t < 0), share(d < 1), share(d < 2)], axis=1)


def encounter_uncertainty(candidates: DataFrame, anchor: DataFrame, draws: int = 3000) -> DataFrame:
    """Percentiles of d_min, t_enc and v_rel over draws of both the star and the one-row anchor, n_valid and robust; the closest first.

    A star meets the anchor's draws by number. Draws are made and summed up where the star is, some stars at a time; they are
    neither rows nor shuffled. Rows of one id count as one star with more draws. Draws without a finite
    result don't count; a star that has none has NULLs and isn't robust.
    """
    let_workers_import(candidates.sparkSession)
    draw, of = np.arange(draws, dtype=np.int64), ("d_min_pc", "t_enc_myr", "v_rel_kms")
    names = [*(f"{n}_{p}" for n in of for p in (16, 50, 84)), "frac_past", "frac_1pc", "frac_2pc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = None
        for table, edges in whole_keys(batches, "source_id"):
            key = table.column("source_id").to_numpy()
            stars, anchors = (np.array(table.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(key), -1) for x in ("star", "anchor"))
            if fixed is None:
                ident = table.column("anchor_id")[0].as_py()
                fixed = _drawn_motion(np.array([ident], dtype=np.int64), anchors[:1], draw, 2 * len(DRAWN))
            done, at = [], 0
            while at < len(edges) - 1:
                upto = max(at + 1, int(np.searchsorted(edges, edges[at] + TOGETHER, side="right")) - 1)
                lo, hi = edges[at], edges[upto]
                met = _passes(key[lo:hi], stars[lo:hi], fixed, draw)
                if hi - lo == upto - at:
                    done.append(_summed(*met))
                else:
                    done += [_summed(*(x[i - lo : j - lo].reshape(1, -1) for x in met)) for i, j in zip(edges[at:upto], edges[at + 1 : upto + 1])]
                at = upto
            found = np.concatenate(done)
            columns = [pa.array(key[edges[:-1]]), pa.array(found[:, 0].astype(np.int64)), *(pa.array(x, from_pandas=True) for x in found[:, 1:].T)]
            yield pa.record_batch(columns, names=["source_id", "n_valid", *names])

    known = lambda df: df.filter(c("source_id").isNotNull()).withColumn("source_id", c("source_id").cast("long"))
    one = anchor.limit(1).select(c("source_id").cast("long").alias("anchor_id"), F.array(*_star(anchor)).alias("anchor"))
    rows = known(candidates).select("source_id", F.array(*_star(candidates)).alias("star"))
    # a number of tasks that isn't lowered for a small table: a star is much work; the order comes last, as joins drop it
    rows = rows.join(F.broadcast(one), F.lit(True)).repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, "source_id")
    met = rows.sortWithinPartitions("source_id").mapInArrow(run, f"source_id long, n_valid long, {', '.join(f'{x} double' for x in names)}")
    robust = F.coalesce((c("frac_past") > 0.9) & (c("frac_2pc") > 0.5), F.lit(False))
    # written, as an order takes its rows twice
    return written(met.withColumn("robust", robust)).orderBy(F.asc_nulls_last("d_min_pc_50"), "source_id")


def encounter_followup(shortlist: DataFrame, errors: DataFrame, anchor: DataFrame, draws: int = 3000, keep: tuple[str, ...] = ("phot_g_mean_mag", "bp_rp", "dist_pc", "transfer_score")) -> DataFrame:
    """encounter_uncertainty() of a shortlist whose astrometry comes with its errors from another table, beside the shortlist's ``keep`` columns.

    The anchor's radial velocity has an error of 0.5 km/s where its own isn't known.
    """
    # written, as its search is used twice
    shortlist = written(shortlist.select("source_id", *keep))
    rows = errors.join(shortlist.select("source_id"), "source_id", "left_semi")
    rv = c("radial_velocity_error")
    anchor = anchor.withColumn("radial_velocity_error", F.coalesce(F.when(F.abs(rv) < float("inf"), rv), F.lit(0.5)))
    found = encounter_uncertainty(rows, anchor, draws)
    return found.join(shortlist, "source_id").orderBy(F.asc_nulls_last("d_min_pc_50"), "source_id")


def ridge(colour: Column) -> Column:
    """Main-sequence absolute magnitude by linear interpolation; NULL outside of the table."""
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in zip(RIDGE, RIDGE[1:]):
        out = F.when((colour >= x0) & (colour <= x1), (colour - x0) * ((y1 - y0) / (x1 - x0)) + y0).otherwise(out)
    return out


def destinations(df: DataFrame, classical: bool = False, speeds: tuple[float, ...] = (0.001, 0.01, 0.1)) -> DataFrame:
    """Add crossing times, abs_g, ms_residual, lum_class and dest_score."""
    df = df.withColumns({f"cross_yr_{i}": c("d_min_pc") * LY_PER_PC / s for i, s in enumerate(speeds)})
    df = df.withColumn("abs_g", c("phot_g_mean_mag") - F.log10("dist_pc") * 5.0 + 5.0)
    df = df.withColumn("ms_residual", c("abs_g") - ridge(c("bp_rp")))
    near = F.abs("ms_residual") <= 1.5
    kind = F.when(near & (c("bp_rp") < 0.45), "hot_shortlived").when(near, "main_sequence").when(c("ms_residual") < -1.5, "giant").when(c("ms_residual") > 3, "remnant").otherwise("unknown")
    centre, width = (1.0, 0.7) if classical else (2.6, 1.1)
    wish = F.exp(-F.pow(c("bp_rp") - centre, 2) / (2 * width**2))
    df = df.withColumn("lum_class", kind)
    return df.withColumn("dest_score", clip(F.when(c("lum_class") == "main_sequence", wish).when(c("lum_class") == "hot_shortlived", wish * 0.1).otherwise(0.0), 0.0, 1.0))


def rank_targets(df: DataFrame) -> DataFrame:
    return df.filter("t_enc_myr < 0").orderBy(F.desc("dest_score"), "d_min_pc", "source_id")
