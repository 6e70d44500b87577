"""Model features of the city-hour frame."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import geo, physics
from airlake.functions.numeric import clip, div
from airlake.operators import series

# Coefficients of the reduced-order estimate.
DECAY_BASE = 0.35
URBAN_PER_HOUR = 9.0
FIRE_TO_PM = 0.045
COLD_BOOST_PER_C = 0.03
NOX_TO_O3 = 0.035
O3_BACKGROUND = 38.0
O3_SOLAR = 40.0
FAR_KM = 300.0
# Order of the 17 raw and 15 engineered features.
RAW_FEATURES = ("pm25_raw", "pm10_raw", "o3_raw", "pblh_m", "gamma", "ri_bulk", "rh_pct", "ws_ms", "wd_deg", "aod", "t2m_c",
                "frp_local_mw", "fire_exposure", "obs_pm25", "obs_pm10", "obs_o3", "obs_manual")
ENGINEERED_FEATURES = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "lag1_pm25", "lag1_pm10", "lag1_o3", "lag24_pm25",
                       "roll24_pm25", "roll24_pm10", "inv_strength", "vent_coef", "log_obs_pm25", "mdl_trend", "mdl_obs_bias")
FEATURES = RAW_FEATURES + ENGINEERED_FEATURES


@dataclass(frozen=True)
class SlopeFit:
    """Through-origin fit of observed depth on particle mass."""

    default: float = 0.00023
    min_rows: int = 10
    lo: float = 1e-6
    hi: float = 3e-3


def cyclic(t: Column) -> dict[str, Column]:
    h = F.lit(2 * math.pi) * F.hour(t) / F.lit(24.0)
    d = F.lit(2 * math.pi) * F.dayofyear(t) / F.lit(365.25)
    return {"hour_sin": F.sin(h), "hour_cos": F.cos(h), "doy_sin": F.sin(d), "doy_cos": F.cos(d)}


def origin_slope(df: DataFrame, pm: str = "pm25", rh: str = "rh", aod: str = "aod", fit: SlopeFit = SlopeFit()) -> DataFrame:
    """One row: slope of depth on grown mass, masked to mass above 1, clipped; the default below 10 rows."""
    x = F.col(pm) * physics.humidity_growth(F.col(rh))
    ok = x.isNotNull() & F.col(aod).isNotNull() & (F.col(pm) > 1.0)
    slope = clip(div(F.sum(F.when(ok, x * F.col(aod))), F.sum(F.when(ok, x * x))), fit.lo, fit.hi)
    return df.agg(F.when(F.count_if(ok) < fit.min_rows, F.lit(fit.default)).otherwise(slope).alias("k"))


def physics_features(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Depth, dimming, mixing height, feedback and temperature anomaly appended to the city-hour frame."""
    v = clip(F.coalesce("pm25", F.lit(0.0)), 0)
    rh = F.coalesce("rh", F.lit(50.0))
    sw = F.coalesce("solar", F.lit(0.0))
    fused = physics.aod_fused(v, rh, F.col("aod"))
    base = physics.mixing_height_base(F.hour(t), F.coalesce("cloud", F.lit(0.0)))
    height, strength = physics.mixing_height_coupled(base, v, rh)
    filled = df.select(F.col("pm25"), rh.alias("rh"), "aod").withColumn("pm25", v)
    return df.withColumns({
        "aod_calibrated_k": origin_slope(filled).scalar(), "aod_fused": fused,
        "solar_dimming_wm2": physics.dimming_wm2(sw, fused), "solar_dimming_frac": physics.dimming_fraction(sw, fused),
        "pblh_base_m": base, "pblh_coupled_m": height, "feedback_strength": strength,
        "temperature_anomaly_c": series.rolling_anomaly("temp", series.by(keys, t)),
    })


def raw_model(df: DataFrame, keys: list[str], t: str, coupled: bool = True) -> DataFrame:
    """17 raw columns: decay of the previous hour's observation plus urban, fire and feedback terms.

    Expects a gap-free, filled hourly frame.  Only the previous hour's observations
    enter, never the current one; a missing previous hour counts as zero.
    """
    w = series.by(keys, t)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    depth = "aod_fused" if "aod_fused" in df.columns else "aod"
    d = df.withColumns({f"_p_{c}": F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)) for c in ("pm25", "pm10", "o3")})
    ws = geo.kmh_to_ms(z("ws"))
    pbl = z("pblh_coupled_m") if coupled else z("pblh_base_m")
    inv, stag, rh, temp, solar = z("inv"), z("stag"), z("rh"), z("temp"), z("solar")
    up, close = z("upwind_frp"), z("close_frp_50km")
    far = F.when(F.col("min_distance_km") > 0, F.col("min_distance_km")).otherwise(F.lit(FAR_KM))
    p25, p10 = F.col("_p_pm25"), F.col("_p_pm10")
    vent = clip(pbl * ws / F.lit(1000.0), 0.05, 30)
    loss = clip(F.lit(DECAY_BASE) / (F.lit(1.0) + F.lit(0.25) * vent) + F.lit(0.05) * (rh > 70).cast("int"), 0.02, 0.85)
    cold = clip((F.lit(18.0) - temp) / F.lit(8.0), 0, 1.5)
    urban = F.lit(URBAN_PER_HOUR) * (F.lit(1.0) + F.lit(COLD_BOOST_PER_C * 8.0) * cold) * (F.lit(0.6) + F.lit(0.8) * clip(stag, 0, 1))
    decay = F.exp(-(far / F.lit(300.0)))
    fire = F.lit(FIRE_TO_PM) * (up * decay + F.lit(0.5) * close)
    trap = F.lit(1.0)
    if coupled:
        trap = F.lit(1.0) + F.lit(0.35) * clip(z("feedback_strength"), 0, 1) * clip((p25 - 80) / F.lit(120.0), 0, 1)
    day = clip(solar / F.lit(400.0), 0, 1)
    out = {
        "pm25_raw": F.greatest(p25 * (F.lit(1.0) - loss) + urban + fire, F.lit(0.0)) * trap,
        "pm10_raw": F.greatest(p10 * (F.lit(1.0) - loss) + F.lit(1.55) * urban + F.lit(1.6) * fire, F.lit(0.0)) * trap,
        "o3_raw": clip(F.lit(O3_BACKGROUND) + F.lit(O3_SOLAR) * day * (F.lit(1.0) + F.lit(0.02) * clip(temp - 15, -3, 10))
                       - F.lit(NOX_TO_O3) * p25 * (F.lit(1.0) - day), 0, 200),
        "pblh_m": pbl,
        "gamma": F.lit(0.10) * inv + F.lit(0.05) * stag - F.lit(0.01) * clip(ws, 0, 10),
        "ri_bulk": F.lit(0.25) * inv / (F.lit(1.0) + clip(ws, 0, 8)) + F.lit(1e-3),
        "rh_pct": rh, "ws_ms": ws, "wd_deg": z("wd"), "aod": z(depth), "t2m_c": temp,
        "frp_local_mw": F.lit(0.5) * close + F.lit(0.3) * up,
        "fire_exposure": F.lit(FIRE_TO_PM) * decay * (up + F.lit(0.5) * close),
        "obs_pm25": p25, "obs_pm10": p10, "obs_o3": F.col("_p_o3"), "obs_manual": F.lit(0.0),
    }
    return d.select(*keys, t, *[out[c].alias(c) for c in RAW_FEATURES])


def feature_row(raw: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The ordered 32-feature row per (time, station); one shuffle and sort for all windows."""
    w = series.by(keys, t)
    eng = {
        **cyclic(F.col(t)),
        "lag1_pm25": series.lag_zero("obs_pm25", 1, w), "lag1_pm10": series.lag_zero("obs_pm10", 1, w),
        "lag1_o3": series.lag_zero("obs_o3", 1, w), "lag24_pm25": series.lag_zero("obs_pm25", 24, w),
        "roll24_pm25": series.rolling_mean("obs_pm25", w, nulls_as_zero=True),
        "roll24_pm10": series.rolling_mean("obs_pm10", w, nulls_as_zero=True),
        "inv_strength": physics.inversion_strength(F.col("gamma"), F.col("ri_bulk")),
        "vent_coef": physics.ventilation(F.col("pblh_m"), F.col("ws_ms")),
        "log_obs_pm25": physics.log_obs(F.col("obs_pm25")),
        "mdl_trend": series.trend("pm25_raw", w), "mdl_obs_bias": F.col("pm25_raw") - F.col("obs_pm25"),
    }
    return raw.select(*keys, t, *RAW_FEATURES, *[eng[c].alias(c) for c in ENGINEERED_FEATURES])


def t1_features(df: DataFrame, keys: list[str], t: str, physics_col: str, obs_col: str) -> DataFrame:
    """Next-step features: six clamped lags, previous observation, cycles of the row index, rolling mean and trend."""
    w = series.by(keys, t)
    i = F.row_number().over(w) - 1
    hour, day = F.lit(2 * math.pi) * (i % 24) / F.lit(24.0), F.lit(2 * math.pi) * (i % 365) / F.lit(365.0)
    cols = {f"lag{k}": series.lag_clamped(physics_col, k, w) for k in range(1, 7)}
    cols.update({
        "obs_prev": series.lag_clamped(obs_col, 1, w), "physics_now": F.col(physics_col),
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day),
        "roll7": F.avg(physics_col).over(w.rowsBetween(-6, 0)),
        "trend6": F.when(i >= 6, F.col(physics_col) - F.lag(physics_col, 6).over(w)).otherwise(F.lit(0.0)),
    })
    return df.select(*keys, t, *[c.alias(n) for n, c in cols.items()])


def add_fire_features(ch: DataFrame, fires: DataFrame, t: str, cols: list[str]) -> DataFrame:
    """Left join of hourly fire features; hours without fires get zero."""
    return ch.join(fires.select(t, *cols), t, "left").fillna(0, subset=cols)


def station_registry(ch: DataFrame, city: str, t: str) -> DataFrame:
    """First known place and number of hours per city (earliest hour wins, so the choice is fixed)."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(t)))
    return ch.groupBy(city).agg(first("lat").alias("lat"), first("lon").alias("lon"), first("state").alias("state"), F.count(t).alias("n_hours"))


def regime_signals(ch: DataFrame, t: str, hours: int = 72) -> DataFrame:
    """Flagged hours and mean depth in the last ``hours`` before the newest row."""
    top = ch.agg((F.max(t) - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("m")).scalar()
    return ch.filter(F.col(t) >= top).agg(
        F.count_if(F.col("inv") > 0).alias("inversion_hours"), F.count_if(F.col("crop") > 0).alias("biomass_season_hours"),
        F.count_if(F.col("stag") > 0).alias("stagnation_hours"), F.round(F.avg("aod"), 3).alias("mean_aod"))
