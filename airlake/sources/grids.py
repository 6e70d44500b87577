"""Regular latitude / longitude grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions.geo import KM_PER_DEGREE


def grid_shape(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, dx_km: float, dy_km: float, variant: str = "nodes") -> tuple[Column, Column]:
    """(nx, ny).  ``nodes``: 111.13 km per degree, one more node than cells, at least 2; ``cells``: 111.0 km per degree."""
    mid = F.cos(F.radians((lat_min + lat_max) / 2))
    km = KM_PER_DEGREE if variant == "nodes" else 111.0
    nx = F.bround((lon_max - lon_min) * F.lit(km) * mid / F.lit(float(dx_km)), 0).cast("long")
    ny = F.bround((lat_max - lat_min) * F.lit(km) / F.lit(float(dy_km)), 0).cast("long")
    if variant == "nodes":
        return F.greatest(nx + 1, F.lit(2)), F.greatest(ny + 1, F.lit(2))
    return nx, ny


def grid_table(boxes: DataFrame, dx_km: float = 4.0, dy_km: float = 4.0, variant: str = "nodes", keys: list[str] | None = None) -> DataFrame:
    """Nodes (i, j, lat, lon) of every box row (lat_min, lat_max, lon_min, lon_max); both axes are generated."""
    b = [F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")]
    nx, ny = grid_shape(*b, dx_km, dy_km, variant)
    d = boxes.withColumns({"nx": nx, "ny": ny}).filter("nx > 0 and ny > 0")
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    lon = F.col("lon_min") + F.col("i") * (F.col("lon_max") - F.col("lon_min")) / F.greatest(F.col("nx") - 1, F.lit(1))
    lat = F.col("lat_min") + F.col("j") * (F.col("lat_max") - F.col("lat_min")) / F.greatest(F.col("ny") - 1, F.lit(1))
    return d.select(*(keys or []), "nx", "ny", "i", "j", lat.alias("lat"), lon.alias("lon"))
