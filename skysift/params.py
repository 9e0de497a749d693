"""Every threshold of the library, as frozen values that Catalyst folds into the plan."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # excess selection
    chi_w1_min: float = 5.0
    chi_w2_min: float = 3.0
    sys_floor_mag: float = 0.05
    chi_color_min: float = 2.0
    # contamination funnel
    ruwe_max: float = 1.4
    parallax_snr_min: float = 10.0
    excess_noise_max: float = 1.0
    ext_flag_max: int = 0
    w1_saturation: float = 8.0
    w2_snr_min: float = 5.0
    max_neighbours: int = 1
    neighbour_radius: float = 6.0
    unwise_frac_max: float = 0.30
    offset_max: float = 1.0
    pm_sigma_max: float = 3.0
    epoch_optical: float = 2016.0
    epoch_infrared: float = 2015.4
    agn_colour: float = 0.8
    # dust locus and anomaly
    t_dust_min: float = 600.0
    t_dust_max: float = 2500.0
    tau_min: float = 1e-4
    tau_max: float = 1e-1
    tau_swarm: float = 0.3
    # indicators
    uv_sigma_min: float = 3.0
    uv_sys_frac: float = 0.30
    balance_lo: float = 0.3
    balance_hi: float = 3.0
    balance_min: float = 5e-3
    optical_rms_min: float = 0.03
    ir_rms_min: float = 0.05
    fap_max: float = 1e-3
    ls_amp_min: float = 0.02
    vtan_hi: float = 200.0
    min_axes: int = 2
    confidence: float = 0.95


DEFAULT = Params()
