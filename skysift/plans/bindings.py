"""Engine inputs as SQL over the given tables; the same text runs in Spark and in DuckDB.

Literals carry an exponent so that both engines read them as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysift.functions.exprs import BANDS, BOLTZMANN, LIGHT, PLANCK, frequency

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def sql_planck(t: str, band: str) -> str:
    nu = frequency(band)
    return f"({2.0 * PLANCK * nu**3 / LIGHT**2!r} / (exp({PLANCK * nu / BOLTZMANN!r} / ({t})) - 1e0))"


def sql_model(t: str, band: str) -> str:
    return f"({sql_planck(t, band)} * 3.141592653589793e26)"


def sql_mag(flux: str, band: str) -> str:
    return f"(-2.5e0 * log10(({flux}) / {BANDS[band][1]!r}e0))"


_MAGS = ", ".join(f"{sql_mag(f'scale * {sql_model("teff", b)} * (1e0 + noise)', b)} AS {b}mag" for b in ("G", "BP", "RP", "J", "H", "Ks"))
CATALOGUE = f"""
SELECT *, sqrt(e_W2mag) AS e_unused,
  W1mag + ((k % 9) - 4) / 20e0 AS w1_un, ra_s AS ra, dec_s AS dec
FROM (
  SELECT *, {_MAGS},
    {sql_mag(f'scale * {sql_model("teff", "W1")} * (1e0 - noise / 2e0) + omega * {sql_model("td", "W1")}', "W1")} AS W1mag,
    {sql_mag(f'scale * {sql_model("teff", "W2")} * (1e0 - noise / 3e0) + omega * {sql_model("td", "W2")}', "W2")} AS W2mag,
    {sql_mag(f'scale * {sql_model("teff", "NUV")} * (1e0 - uvdef)', "NUV")} AS nuv,
    {sql_mag(f'scale * {sql_model("teff", "FUV")} * (1e0 - uvdef / 2e0)', "FUV")} AS fuv
  FROM (
    SELECT *, tau_in * scale * teff * teff * teff * teff / (td * td * td * td) AS omega FROM (
      SELECT c_custkey AS k, c_custkey AS source_id, c_mktsegment AS label, c_acctbal AS bal,
        (c_custkey * 137.50776e0) % 360e0 AS ra_s, (c_custkey * 7919 % 12000) / 100e0 - 40e0 AS dec_s,
        5e-24 * (1 + c_custkey % 20) AS scale, 4000e0 + (c_custkey * 37 % 8000) AS teff,
        ((c_custkey * 29 % 40) - 19.5e0) / 1000e0 AS noise,
        200e0 + (c_custkey * 91 % 2400) AS td,
        CASE WHEN c_custkey % 4 = 0 THEN pow(10e0, -3.5e0 + (c_custkey % 31) / 9e0) ELSE 0e0 END AS tau_in,
        CASE WHEN c_custkey % 6 = 0 THEN (c_custkey % 10) / 10e0 ELSE 0e0 END AS uvdef,
        0.02e0 + (c_custkey % 5) / 200e0 AS e_W2mag
      FROM customer) a) b) c
"""
CATALOGUE = f"""
SELECT source_id, label, ra, dec, teff,
  Gmag, BPmag, RPmag, CASE WHEN k % 23 = 0 THEN NULL ELSE Jmag END AS Jmag, CASE WHEN k % 23 = 0 THEN NULL ELSE Hmag END AS Hmag, CASE WHEN k % 23 = 0 OR k % 7 = 0 THEN NULL ELSE Ksmag END AS Ksmag,
  0.03e0 AS e_Jmag, CASE WHEN k % 5 = 0 THEN NULL ELSE 0.04e0 END AS e_Hmag, 0.05e0 AS e_Ksmag, 0.02e0 AS e_Gmag, 0.02e0 AS e_BPmag, 0.02e0 AS e_RPmag,
  W1mag, W2mag, 0.02e0 + (k % 4) / 200e0 AS e_W1mag, CASE WHEN k % 37 = 0 THEN NULL ELSE e_W2mag END AS e_W2mag,
  CASE WHEN k % 3 = 0 THEN NULL ELSE nuv END AS NUVmag, CASE WHEN k % 4 = 1 THEN NULL ELSE fuv END AS FUVmag, 0.1e0 AS e_NUVmag, 0.15e0 AS e_FUVmag,
  CASE WHEN k % 50 = 0 THEN NULL ELSE 0.9e0 + (k * 13 % 60) / 100e0 END AS ruwe,
  8e0 + k % 40 AS parallax_over_error, (k * 7 % 110) / 100e0 AS astrometric_excess_noise, 0.9e0 + (k % 11) / 100e0 AS pwd,
  2e0 + (greatest(bal, -999e0) + 1000e0) / 1000e0 AS parallax,
  (k * 31 % 401) - 200e0 AS pmra, (k * 53 % 401) - 200e0 AS pmdec, 0.1e0 AS pmra_error, 0.1e0 AS pmdec_error,
  (k * 31 % 401) - 200e0 + (k * 17 % 101) - 50e0 AS pmra_wise, (k * 53 % 401) - 200e0 + (k * 19 % 61) - 30e0 AS pmdec_wise,
  CASE WHEN k % 8 = 0 THEN NULL ELSE 20e0 END AS e_pmra_wise, 20e0 AS e_pmdec_wise,
  ra + (((k * 31 % 401) - 200e0) * -0.6e0 + CASE WHEN k % 13 = 0 THEN 2000e0 ELSE 100e0 END) / 3.6e6 / cos(radians(dec)) AS ra_wise,
  dec + (((k * 53 % 401) - 200e0) * -0.6e0 + 50e0) / 3.6e6 AS dec_wise,
  CASE WHEN k % 17 = 0 THEN 'D000' WHEN k % 19 = 0 THEN '00h0' ELSE '0000' END AS cc_flags,
  CASE k % 16 WHEN 0 THEN 'AU' WHEN 1 THEN 'AB' WHEN 2 THEN 'CA' ELSE 'AA' END AS ph_qual,
  CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS ext_flg, 1 + CASE WHEN k % 21 = 0 THEN 1 ELSE 0 END AS n_wise_neighbours,
  CASE WHEN k % 9 = 0 THEN NULL ELSE 5.5e0 + (k * 3 % 40) END AS gaia_nn_arcsec,
  CASE WHEN k % 6 = 0 THEN NULL ELSE w1_un END AS W1mag_unwise,
  k % 40 = 0 AS known_disk, k % 43 = 0 AS is_qso,
  CASE WHEN k % 3 = 0 THEN (k * 19 % 97) / 1000e0 END AS ztf_frac_rms, CASE WHEN k % 5 < 2 THEN (k * 23 % 101) / 1000e0 END AS neowise_w1_frac_rms,
  CASE WHEN k % 3 = 0 THEN pow(10e0, -(k % 8) / 1e0) END AS ztf_ls_fap, CASE WHEN k % 3 = 0 THEN (k * 7 % 90) / 1000e0 END AS ztf_ls_amp_mag,
  CASE WHEN k % 31 = 0 THEN 'VARIABLE' ELSE 'NOT_AVAILABLE' END AS phot_variable_flag,
  12e0 + bal / 2000e0 AS phot_g_mean_mag, (k * 41 % 420) / 100e0 - 0.1e0 AS bp_rp,
  CASE WHEN k % 7 = 3 THEN NULL ELSE ((k * 61 % 200) - 100e0) END AS radial_velocity
FROM ({CATALOGUE}) q
"""

LIGHTCURVE_EVENTS = """
SELECT user_id AS source_id, event_type AS band, {micros}(ts) / 8.64e10 AS mjd, 12e0 + value / 200e0 AS mag, 0.02e0 AS magerr, event_id AS tiebreak FROM events
"""
LIGHTCURVE_SHIPPING = """
SELECT l_suppkey AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN 'g' ELSE 'r' END AS band, CAST(l_linenumber AS STRING) AS channel, {micros}(l_shipdate) / 8.64e10 AS mjd,
  12e0 + l_extendedprice / 1e5 AS mag, 0.05e0 AS magerr, l_orderkey * 10 + l_linenumber AS tiebreak FROM lineitem
"""
SKY_B = """
SELECT s_suppkey AS cand_id, (s_suppkey * 7 * 137.50776e0) % 360e0 + s_acctbal / 3.6e6 AS ra, (s_suppkey * 7 * 7919 % 12000) / 100e0 - 40e0 + (s_suppkey % 7) / 3.6e3 AS dec,
  10e0 + (s_suppkey * 3 % 100) / 20e0 AS mag, s_nationkey AS kind FROM supplier
"""
ORBITS = """
SELECT p_partkey AS source_id, 0.5e0 + p_size / 10e0 AS a_ti, (p_partkey % 11) / 10e0 - 0.5e0 AS b_ti, (p_partkey % 13) / 10e0 - 0.6e0 AS f_ti, 0.3e0 + p_retailprice / 1000e0 AS g_ti,
  200e0 + p_size * 20 AS period, 1e0 + p_partkey % 9 AS parallax, 8e0 + (p_partkey * 7 % 90) / 10e0 AS phot_g_mean_mag, 1e0 + (p_partkey % 40) / 8e0 AS ruwe FROM part
"""
ACCELERATIONS = """
SELECT o_orderkey AS source_id, (o_totalprice - 150000e0) / 50000e0 AS accel_ra, (o_custkey % 701) / 100e0 - 3.5e0 AS accel_dec, 0.05e0 AS accel_ra_error,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 0.04e0 END AS accel_dec_error, 0.5e0 + (o_orderkey * 11 % 300) / 10e0 AS parallax, 10e0 + (o_orderkey * 13 % 80) / 10e0 AS phot_g_mean_mag,
  (o_orderkey * 3 % 350) / 100e0 AS bp_rp FROM orders
"""
STARS_6D = """
SELECT o_orderkey AS source_id, (o_orderkey * 137.50776e0) % 360e0 AS ra, (o_orderkey * 7919 % 12000) / 100e0 - 60e0 AS dec, 20e0 + (o_custkey * 7 % 400) / 10e0 AS parallax,
  o_totalprice / 1000e0 - 150e0 AS pmra, (o_custkey * 13 % 600) - 300e0 AS pmdec, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE (o_orderkey * 61 % 160) - 80e0 END AS radial_velocity,
  6e0 + (o_orderkey * 17 % 110) / 10e0 AS phot_g_mean_mag, (o_orderkey * 41 % 440) / 100e0 - 0.2e0 AS bp_rp FROM orders
"""
LINES = """
SELECT l_orderkey AS spec_id, l_linenumber AS line_no, 3600e0 + l_extendedprice / 17e0 AS wavelength, l_quantity AS significance, CASE WHEN l_returnflag = 'R' THEN 'absorption' ELSE 'emission' END AS search_mode
FROM lineitem
"""
SPECTRA = """
SELECT vec_id AS spec_id, pix, 4000e0 + 50e0 * pix AS wave, 1e0 + CAST(x AS DOUBLE) AS flux, 100e0 AS ivar, label FROM ({exploded}) e
"""

BINDINGS = {
    "catalogue": CATALOGUE,
    "curves": LIGHTCURVE_EVENTS,
    "long_curves": LIGHTCURVE_SHIPPING,
    "sky_b": SKY_B,
    "orbits": ORBITS,
    "accelerations": ACCELERATIONS,
    "stars": STARS_6D,
    "lines": LINES,
    "spectra": SPECTRA,
}


def _text(name: str, duckdb: bool) -> str:
    micros = "epoch_us" if duckdb else "unix_micros"
    text = BINDINGS[name]
    if not duckdb:
        text = text.replace("{micros}(ts)", "{micros}(CAST(ts AS TIMESTAMP))").replace("{micros}(l_shipdate)", "{micros}(CAST(l_shipdate AS TIMESTAMP))")
    exploded = (
        "SELECT vec_id, label, unnest(range(len(embedding))) AS pix, unnest(embedding) AS x FROM embeddings"
        if duckdb
        else "SELECT vec_id, label, p.pos AS pix, p.x AS x FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x"
    )
    return text.replace("{micros}", micros).replace("{exploded}", exploded)


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The engine input ``name`` over the tables in ``sf_dir``."""
    text = _text(name, duckdb=False)
    for t in TABLES:
        if t in text:
            rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if name == "catalogue":  # a small file is one task, and its rows take long
                rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)
            rows.createOrReplaceTempView(t)
    return spark.sql(text)


def duck(name: str) -> str:
    """The same input as a subquery for DuckDB."""
    return f"({_text(name, duckdb=True)})"
