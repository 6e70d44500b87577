"""Renames, coercions, lookups and filters that bring feeds to canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import geo, timing
from airlake.functions.numeric import to_double

# Source header -> canonical name.
CANONICAL_COLUMNS = {
    "City": "city", "State": "state", "Latitude": "lat", "Longitude": "lon", "Datetime": "observed_at_utc",
    "Temp_2m_C": "temp_2m_c", "Humidity_Percent": "rh_pct", "Dew_Point_C": "dew_point_c",
    "Wind_Speed_10m_kmh": "ws_kmh", "Wind_Speed_80m_kmh": "ws80_kmh", "Wind_Speed_120m_kmh": "ws120_kmh",
    "Wind_Dir_10m": "wd_deg", "Wind_Gusts_kmh": "gusts_kmh", "Wind_Stagnation": "wind_stagnation",
    "Precipitation_mm": "precip_mm", "Pressure_MSL_hPa": "pressure_msl_hpa",
    "Surface_Pressure_hPa": "surface_pressure_hpa", "Solar_Radiation_Wm2": "solar_radiation_wm2",
    "Direct_Radiation_Wm2": "direct_radiation_wm2", "Diffuse_Radiation_Wm2": "diffuse_radiation_wm2",
    "UV_Index": "uv_index", "Cloud_Cover_Percent": "cloud_cover_pct", "Is_Daytime": "is_daytime",
    "PM2_5_ugm3": "pm25_ugm3", "PM10_ugm3": "pm10_ugm3", "PM_Ratio": "pm_ratio", "CO_ugm3": "co_ugm3",
    "NO2_ugm3": "no2_ugm3", "SO2_ugm3": "so2_ugm3", "O3_ugm3": "o3_ugm3", "Dust_ugm3": "dust_ugm3", "AOD": "aod",
    "Temp_Inversion": "temp_inversion_flag", "Festival_Period": "festival_period",
    "Crop_Burning_Season": "crop_burning_season", "US_AQI": "us_aqi", "AQI_Category": "aqi_category_num",
    "PM25_Category_India": "pm25_category_india",
}
# Columns that are always empty, and derived columns that are rebuilt here.
DROP_EMPTY = ("Temp_80m_C", "Temp_120m_C", "Temp_180m_C", "Inversion_Strength_C", "NH3_ugm3")
DROP_DERIVED = (
    "Year", "Month", "Day", "Hour", "Day_of_Week", "Day_Name", "Week_of_Year", "Is_Weekend", "Quarter", "Season",
    "Time_of_Day", "Humidity_Category", "Wind_Category", "Rain_mm", "Is_Raining", "Heavy_Rain", "Cloud_Low_Percent",
    "Cloud_Mid_Percent", "Cloud_High_Percent", "US_AQI_PM25", "US_AQI_PM10", "US_AQI_NO2", "US_AQI_O3", "US_AQI_CO",
    "EU_AQI", "EU_AQI_PM25", "EU_AQI_PM10", "Sunshine_Seconds",
)
# Pollutant id -> metric, and units, per feed.
OGD_METRICS = {"PM2.5": "PM2.5", "PM10": "PM10", "SO2": "SO2", "NO2": "NO2", "CO": "CO", "OZONE": "O3", "NH3": "NH3"}
OGD_UNITS = {"PM2.5": "ug/m3", "PM10": "ug/m3", "SO2": "ug/m3", "NO2": "ug/m3", "CO": "mg/m3", "O3": "ug/m3", "NH3": "ug/m3"}
DIGEST_METRICS = {"SO2": "SO2", "NO2": "NO2", "PM2.5": "PM2.5", "PM10": "PM10", "CO": "CO", "O3": "OZONE", "NH3": "NH3"}
DIGEST_UNITS = {"SO2": "ppb", "NO2": "ppb", "O3": "ppb", "CO": "mg/m3", "NH3": "ppb", "PM2.5": "ug/m3", "PM10": "ug/m3"}
SATELLITES = {"NPP": "VIIRS_SNPP", "NOAA-20": "VIIRS_NOAA20", "NOAA-21": "VIIRS_NOAA20", "AQUA": "MODIS_AQUA", "TERRA": "MODIS_TERRA"}
SURFACE_HINTS = ("surface", "above ground", "mean sea level")
PRESSURE_HINTS = ("mb", "hpa")
MIN_CONFIDENCE = 20.0
DEFAULT_BRIGHTNESS_K = 350.0


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed map, null when the key is absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonicalize(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in DROP_EMPTY and c not in DROP_DERIVED]
    return df.select(*[F.col(f"`{c}`").alias(CANONICAL_COLUMNS.get(c, c)) for c in keep])


def drop_all_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop the listed columns that hold no value; one aggregate returns one row of counts."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return df.drop(*[c for c in present if counts[c] == 0])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: to_double(F.col(c)) for c in cols})


def trim_all(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(F.col(c)) for c, t in df.dtypes if t == "string"})


def to_hour(df: DataFrame, col: str) -> DataFrame:
    """Parse, drop unreadable stamps, floor to the hour."""
    t = F.col(col) if dict(df.dtypes)[col] != "string" else timing.parse_utc(F.col(col))
    return df.withColumn(col, timing.hour_floor(t)).filter(F.col(col).isNotNull())


def map_metric(df: DataFrame, id_col: str, metrics: dict[str, str], units: dict[str, str]) -> DataFrame:
    """Canonical metric and unit; rows with unknown ids are dropped."""
    return (
        df.withColumn("metric", lookup(metrics, F.upper(F.trim(F.col(id_col)))))
        .filter("metric is not null")
        .withColumn("unit", lookup(units, F.col("metric")))
    )


def quality_flag(confidence: Column) -> Column:
    conf = F.replace(confidence, F.lit("%"), F.lit("")).try_cast("double")
    return F.when(conf >= MIN_CONFIDENCE, "OK").otherwise("SUSPECT")


def availability_flag(available: Column) -> Column:
    return F.when(available, "OK").otherwise("MISSING")


def normalize_fires(df: DataFrame) -> DataFrame:
    """Satellite export rows to canonical detections; unknown satellites and unreadable times are dropped."""
    hhmm = F.when(F.col("acq_time").isNull(), 0).otherwise(F.col("acq_time").try_cast("int"))
    day = timing.iso_day(F.col("acq_date"))
    hh, mm = F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int")
    acq = F.when((hh < 24) & (mm < 60), timing.ntz(day) + F.make_dt_interval(F.lit(0), hh, mm))
    sat = lookup(SATELLITES, F.upper(F.trim(F.col("satellite"))))
    # a missing part has a mark of its own, so different rows don't share an id
    fid = F.concat_ws("|", sat, *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in ("acq_date", "acq_time", "latitude", "longitude", "scan", "track")])
    num = lambda c, d: F.coalesce(to_double(F.col(c)), F.lit(float(d)))
    extra = [c for c in df.columns if c not in (
        "latitude", "longitude", "acq_date", "acq_time", "satellite", "frp", "bright_ti4", "confidence", "scan", "track", "daynight")]
    return df.filter(sat.isNotNull() & day.isNotNull() & (hh < 24) & (mm < 60)).select(
        fid.alias("fire_id"), sat.alias("satellite"),
        to_double(F.col("latitude")).alias("lat"), to_double(F.col("longitude")).alias("lon"),
        acq.alias("acq"), F.greatest(F.lit(0.0), num("frp", 0.0)).alias("frp_mw"),
        num("bright_ti4", DEFAULT_BRIGHTNESS_K).alias("brightness_kelvin"),
        F.replace(F.col("confidence"), F.lit("%"), F.lit("")).try_cast("double").alias("confidence_percent"),
        num("scan", 0.0).alias("scan_km"), num("track", 0.0).alias("track_km"),
        F.when(F.upper(F.trim(F.col("daynight"))).startswith("N"), "N").otherwise("D").alias("day_night"),
        quality_flag(F.col("confidence")).alias("quality_flag"), *extra,
    )


def bbox(df: DataFrame, lat: str, lon: str, **sides: float) -> DataFrame:
    return df.filter(geo.in_box(F.col(lat), F.col(lon), **sides))


def level_kind(c: Column) -> Column:
    low = F.lower(c)
    has = lambda hints: F.lit(False) if not hints else _any([low.contains(h) for h in hints])
    return F.when(has(SURFACE_HINTS), "surface").when(has(PRESSURE_HINTS), "pressure").otherwise("model_level")


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def split_spec(c: Column) -> tuple[Column, Column]:
    """``VAR:level`` to (upper variable, level); the level defaults to surface."""
    var = F.upper(F.trim(F.split_part(c, F.lit(":"), F.lit(1))))
    at = F.instr(c, ":")
    level = F.trim(F.when(at > 0, F.substr(c, at + F.lit(1))).otherwise(F.lit("")))
    return var, F.when(level == "", "surface").otherwise(level)
