"""Line lists and wavelength scales."""

from __future__ import annotations

from pyspark.sql import Column


def vacuum_from_air(w: float | Column) -> float | Column:
    """Vacuum wavelength (Angstrom) of an air wavelength, by the usual dispersion formula; works on numbers and columns."""
    s2 = 1e8 / (w * w)
    return w * (1.0 + 0.00008336624212083 + 0.02408926869968 / (130.1065924522 - s2) + 0.0001599740894897 / (38.92568793293 - s2))


#: Night-sky lines (air, Angstrom).
SKY_AIR = (
    5577.34, 5867.5, 5889.95, 5895.92, 6300.30, 6363.78, 6498.7, 6533.0, 6863.9, 6923.2, 6948.9, 7276.4, 7340.9, 7358.7, 7392.2, 7822.0, 7841.3,
    7913.7, 7964.0, 7993.3, 8344.6, 8399.2, 8430.2, 8465.4, 8505.0, 8791.2, 8827.1, 8885.9, 8919.6,
)
SKY = tuple(vacuum_from_air(w) for w in SKY_AIR)
#: Atmospheric bands (Angstrom).
TELLURIC = ((6860.0, 6920.0), (7590.0, 7700.0), (7160.0, 7340.0), (8100.0, 8400.0), (8900.0, 9800.0))
#: Common emission lines at rest (vacuum, Angstrom).
EMISSION = (
    3727.09, 3729.88, 3868.76, 3967.47, 3934.78, 3969.59, 4102.89, 4341.68, 4862.68, 4960.30, 5008.24, 5176.7, 5890.0, 5896.0, 6549.86, 6564.61, 6585.27, 6718.29, 6732.67,
    5877.25, 4472.7, 6679.99, 7067.2, 7283.4, 7774.2, 8446.4, 8500.36, 8544.44, 8664.52, 8392.4, 8413.3, 8440.3, 8469.6, 8504.8, 8547.7, 8600.8, 8667.4, 8752.9,
    8865.3, 9017.8, 9231.5, 9548.6, 3890.2, 3971.2, 4341.7,
)
#: Interstellar lines (air, Angstrom).
INTERSTELLAR_AIR = (5889.9, 5895.9, 3933.7, 3968.5, 7664.9, 7699.0, 4300.3)
#: Lines of emission-line galaxies at rest (vacuum, Angstrom), and pairs that lock a redshift.
GALAXY = (
    ("[OII]3727", 3727.09), ("[OII]3729", 3729.88), ("[NeIII]3869", 3869.86), ("Hg4341", 4341.68), ("Hb4862", 4862.68), ("[OIII]4959", 4960.30), ("[OIII]5007", 5008.24),
    ("[OI]6300", 6302.05), ("[NII]6548", 6549.86), ("Ha6563", 6564.61), ("[NII]6584", 6585.27), ("[SII]6716", 6718.29), ("[SII]6731", 6732.68),
)
LOCKED = (
    ("Ha6563", "[NII]6584"), ("Ha6563", "[NII]6548"), ("[NII]6548", "[NII]6584"), ("[OIII]4959", "[OIII]5007"), ("[SII]6716", "[SII]6731"),
    ("Ha6563", "[SII]6716"), ("Ha6563", "[SII]6731"), ("[OII]3727", "[OII]3729"),
)
#: Stellar absorption lines at rest (air, Angstrom): Balmer, Paschen, helium, calcium, sodium, magnesium, potassium, iron and others, band heads.
STELLAR_AIR = (
    3835.4, 3889.1, 3970.1, 4101.7, 4340.5, 4861.3, 6562.8, 8598.4, 8665.0, 8750.5, 8862.8, 9014.9, 9229.0, 4026.2, 4471.5, 4541.6, 4685.7, 5875.6, 6678.2,
    3933.7, 3968.5, 8498.0, 8542.1, 8662.1, 5889.9, 5895.9, 5167.3, 5172.7, 5183.6, 5528.4, 4308.0, 7664.9, 7699.0, 4045.8, 4063.6, 4071.7, 4132.1, 4143.9, 4226.7, 4271.8,
    4383.5, 4404.8, 4415.1, 4528.6, 4668.1, 4920.5, 4957.6, 5250.2, 5269.5, 5328.0, 5371.5, 5397.1, 5405.8, 5434.5, 5446.9, 5455.6, 6122.2, 6162.2, 6439.1, 6494.9,
    7053.0, 7589.0, 7666.0, 8432.0,
)
STELLAR = tuple(vacuum_from_air(w) for w in STELLAR_AIR)
INTERSTELLAR = tuple(vacuum_from_air(w) for w in INTERSTELLAR_AIR)
#: Diffuse interstellar bands (air, Angstrom).
DIFFUSE_AIR = (4428.0, 5780.5, 5797.1, 6196.0, 6203.0, 6269.8, 6283.8, 6379.3, 6613.6, 6660.7, 6993.2, 5705.1, 5849.8, 4726.8, 4963.9)
DIFFUSE = tuple(vacuum_from_air(w) for w in DIFFUSE_AIR)
