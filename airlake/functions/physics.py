"""Derived physical quantities as column expressions (no UDFs)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from airlake.functions.numeric import clip, logistic

# Fixed values.
GRAVITY = 9.81
R_DRY = 287.05
LAPSE_DRY = 0.0098
REF_PRESSURE = 1013.25
DZ_925 = R_DRY * 288.15 / GRAVITY * math.log(REF_PRESSURE / 925.0)
FUEL_KG_PER_MJ = 0.368
EMISSION_FACTORS = {"pm25": 8.5, "pm10": 12.5, "co": 62.0, "nox": 2.5, "voc": 7.0, "so2": 0.45, "bc": 0.45, "oc": 2.4}
URBAN_KG_KM2_DAY = 180.0
# Share of the daily mean emission by local hour 0..23.
DIURNAL = (0.62, 0.55, 0.50, 0.48, 0.55, 0.80, 1.10, 1.25, 1.32, 1.20, 1.02, 0.90,
           0.85, 0.85, 0.90, 0.98, 1.05, 1.15, 1.30, 1.45, 1.45, 1.30, 1.10, 0.85)


@dataclass(frozen=True)
class Feedback:
    """Coefficients of the aerosol - radiation - mixing-height chain."""

    k_aod: float = 0.00023
    sw_reduction: float = 0.30
    pbl_suppression: float = 0.25
    pbl_min: float = 150.0
    cooling_per_100wm2: float = 2.0


def humidity_growth(rh: Column) -> Column:
    return F.lit(1.0) + F.lit(0.12) * clip((rh - 40) / F.lit(60.0), 0, 1)


def aod_from_pm(pm: Column, rh: Column, k: float | Column = Feedback.k_aod) -> Column:
    kc = k if isinstance(k, Column) else F.lit(float(k))
    return clip(pm, 0) * kc * humidity_growth(rh)


def aod_fused(pm: Column, rh: Column, aod: Column, k: float | Column = Feedback.k_aod) -> Column:
    """Observed depth blended 0.7 / 0.3 with the estimate; the estimate alone where not observed."""
    est = aod_from_pm(pm, rh, k)
    return F.coalesce(F.lit(0.7) * aod + F.lit(0.3) * est, est)


def attenuated(f0: Column, aod: Column) -> Column:
    return f0 * F.exp(-clip(aod, 0, 6))


def dimming_wm2(sw: Column, aod: Column) -> Column:
    return sw * (F.lit(1.0) - F.exp(-clip(aod, 0, 6)))


def dimming_fraction(sw: Column, aod: Column) -> Column:
    lost = clip(F.lit(1.0) - F.exp(-clip(aod, 0, 6)), 0, 1)
    return F.when(sw > 1.0, lost).when(sw.isNotNull(), F.lit(0.0))


def surface_cooling(fraction: Column, sw: Column, p: Feedback = Feedback()) -> Column:
    return -F.lit(p.cooling_per_100wm2) * (clip(fraction, 0, 1) * clip(sw, 0)) / F.lit(100.0)


def mixing_height_base(hour: Column, cloud: Column) -> Column:
    day = F.lit(0.45) + F.lit(0.55) * F.greatest(F.sin(F.lit(math.pi) * (hour - F.lit(5.5)) / F.lit(14.0)), F.lit(0.0))
    return clip((F.lit(150.0) + F.lit(1450.0) * day) * (F.lit(1.0) - F.lit(0.35) * cloud / F.lit(100.0)), 150, 2200)


def mixing_height_coupled(base: Column, pm: Column, rh: Column, p: Feedback = Feedback()) -> tuple[Column, Column]:
    """Suppressed height and feedback strength."""
    loss = F.lit(p.sw_reduction) * clip(aod_from_pm(pm, rh, p.k_aod), 0)
    height = clip(base * (F.lit(1.0) - F.lit(p.pbl_suppression) * clip(loss, 0, 1)), p.pbl_min)
    return height, clip(F.lit(p.pbl_suppression) * loss, 0, 1)


def inversion_lapse(t_sfc: Column, t_925: Column) -> Column:
    return clip(t_925 - t_sfc, 0)


def bulk_richardson(t_sfc_k: Column, t_aloft_k: Column, z_sfc: float, z_aloft: float,
                    u_sfc: Column, v_sfc: Column, u_aloft: Column, v_aloft: Column) -> Column:
    power = R_DRY * LAPSE_DRY / GRAVITY
    t_mean = F.lit(0.5) * (t_sfc_k + t_aloft_k)
    theta_s = t_sfc_k * F.lit((1000.0 / REF_PRESSURE) ** power)
    p_aloft = F.lit(REF_PRESSURE) * F.exp(-(F.lit(z_aloft * GRAVITY)) / (F.lit(R_DRY) * t_mean))
    theta_a = t_aloft_k * F.pow(F.lit(1000.0) / p_aloft, F.lit(power))
    shear = F.pow(u_aloft - u_sfc, F.lit(2)) + F.pow(v_aloft - v_sfc, F.lit(2))
    dz = max(z_aloft - z_sfc, 1.0)
    return F.lit(GRAVITY) / t_mean * (theta_a - theta_s) * F.lit(dz) / clip(shear, 1e-4)


def stability_class(rib: Column) -> Column:
    return F.when(rib > 1.0, 4).when(rib > 0.25, 3).when(rib >= 0.0, 2).when(rib < 0.0, 1).otherwise(-1)


def inversion_diagnostics(t2m: Column, t925: Column, ws: Column, pblh: Column) -> dict[str, Column]:
    strength = clip(t925 - t2m, 0)
    calm = logistic(ws, 4.0, -1.2)
    prob = clip(logistic(strength, 2.0, 0.8) * calm, 0, 1)
    shallow = F.lit(1.0) - clip((pblh - 250) / F.lit(1800.0), 0, 1)
    return {
        "strength_k": strength,
        "height_m": F.when(strength > 1.0, F.lit(DZ_925)).otherwise(F.lit(250.0)),
        "probability": prob,
        "trapping_idx": clip(F.lit(0.55) * prob + F.lit(0.25) * calm + F.lit(0.2) * shallow, 0, 1),
    }


def ventilation_index(pblh: Column, ws: Column) -> Column:
    return pblh * (ws + F.lit(0.35))


def lapse_stability(t2m: Column, t925: Column) -> Column:
    return (t925 - t2m) / F.lit(DZ_925) * F.lit(1000.0)


def stagnation_index(pblh: Column, ws: Column, stability: Column) -> Column:
    p = clip((pblh - 200) / F.lit(2000.0), 0, 1)
    w = clip(F.lit(1.0) - (ws - F.lit(0.5)) / F.lit(6.0), 0, 1)
    s = clip(F.lit(1.0) - (stability + 2) / F.lit(8.0), 0, 1)
    return clip(F.lit(0.2) * (F.lit(1.0) - p) + F.lit(0.5) * w + F.lit(0.3) * s, 0, 1)


def pressure_height(p_hpa: Column, t_sfc_k: Column) -> Column:
    return F.lit(R_DRY) * t_sfc_k / F.lit(GRAVITY) * F.log(F.lit(REF_PRESSURE) / p_hpa)


def surface_pressure(height_m: Column, t925_c: Column) -> Column:
    scale = F.lit(R_DRY) * (t925_c + F.lit(273.15)) / F.lit(GRAVITY)
    return F.lit(925.0) * F.exp((F.lit(DZ_925) - height_m) / scale)


def inversion_strength(gamma: Column, ri: Column) -> Column:
    return logistic((gamma - F.lit(0.5)) / F.lit(0.3)) * logistic((ri - F.lit(0.6)) / F.lit(0.4))


def ventilation(pblh: Column, ws: Column) -> Column:
    return pblh * ws / F.lit(1000.0)


def log_obs(c: Column) -> Column:
    return F.log1p(clip(c, 0))


def fire_emission(frp: Column, fuel_scale: float = 1000.0) -> dict[str, Column]:
    """Grams per hour by species for one detection; ``fuel_scale`` 1000 keeps the published totals."""
    fuel = frp * F.lit(FUEL_KG_PER_MJ) * F.lit(3600.0) * F.lit(float(fuel_scale))
    return {sp: fuel * F.lit(ef) for sp, ef in EMISSION_FACTORS.items()}


def diurnal_factor(local_hour: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DIURNAL]), (F.pmod(local_hour, F.lit(24)) + 1).cast("int"))


def local_solar_hour(hour: Column, lon_tz: float = 77.2) -> Column:
    return F.pmod(F.bround(hour + F.lit((lon_tz - 82.5) / 15.0), 0), F.lit(24)).cast("int")


def season_factor(doy: Column) -> Column:
    return F.pow(F.cos((doy - 309) / F.lit(45.0) * F.lit(math.pi)), F.lit(2))
