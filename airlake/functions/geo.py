"""Distances, bearings, wind and sun geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airlake.functions.numeric import clip

# Fixed values.
CITY_CENTRE = (28.6139, 77.2090)
REGION_BOX = {"lat_min": 27.5, "lat_max": 33.0, "lon_min": 73.5, "lon_max": 78.8}
NCR_BOX = {"lat_min": 28.4, "lat_max": 29.1, "lon_min": 76.7, "lon_max": 77.5}
DOMAIN_BOX = {"lat_min": 28.2, "lat_max": 29.0, "lon_min": 76.8, "lon_max": 77.6}
EARTH_RADIUS_KM = {"hourly_fire": 6371.0, "station_graph": 6371.0088}
KM_PER_DEGREE = 111.13


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    a = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    )
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0..360."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def upwind(bearing: Column, wind_from: Column | None = None) -> Column:
    """Within 90 degrees of the wind-from direction; without wind, the fixed sector 270..360."""
    sector = bearing.between(270, 360)
    if wind_from is None:
        return sector
    gap = F.abs(F.pmod(bearing - wind_from + 180, F.lit(360.0)) - 180)
    return F.when(wind_from.isNull(), sector).otherwise(gap <= 90)


def in_box(lat: Column, lon: Column, lat_min=None, lat_max=None, lon_min=None, lon_max=None) -> Column:
    """Inclusive box; every side is optional, so open boxes push down too."""
    cond = F.lit(True)
    for col, lo, hi in ((lat, lat_min, lat_max), (lon, lon_min, lon_max)):
        if lo is not None:
            cond = cond & (col >= F.lit(float(lo)))
        if hi is not None:
            cond = cond & (col <= F.lit(float(hi)))
    return cond


def padded_box_flag(lat: Column, lon: Column, pad: float = 0.2) -> Column:
    b = NCR_BOX
    return in_box(lat, lon, b["lat_min"] - pad, b["lat_max"] + pad, b["lon_min"] - pad, b["lon_max"] + pad)


def wind_uv(ws: Column, wd: Column) -> tuple[Column, Column]:
    return ws * F.sin(F.radians(wd)), ws * F.cos(F.radians(wd))


def kmh_to_ms(ws: Column) -> Column:
    return ws / F.lit(3.6)


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(-v, -u)), F.lit(360.0))


def dayness(t: Column, lat: Column, lon: Column, variant: str = "solar_time") -> Column:
    """Clipped sine of the solar elevation; two published variants."""
    doy = F.dayofyear(t)
    if variant == "solar_time":
        utc = F.hour(t) + F.minute(t) / F.lit(60.0)
        lst = F.pmod(utc + lon * F.lit(24.0) / F.lit(360.0), F.lit(24.0))
        decl = F.lit(-23.44) * F.cos(F.radians(F.lit(360.0 / 365.0) * (doy + 10)))
        angle = F.radians((lst - 12) * 15)
    else:  # "zone_time"
        decl = F.lit(23.45) * F.sin(F.radians(F.lit(360.0 / 365.0) * (doy - 81)))
        angle = F.radians(F.lit(15.0) * (F.hour(t) - 12) + (lon - F.lit(82.5)) / 15 * 15)
    elev = F.sin(F.radians(lat)) * F.sin(F.radians(decl)) + F.cos(F.radians(lat)) * F.cos(F.radians(decl)) * F.cos(angle)
    return clip(elev, 0.0, 1.0)
