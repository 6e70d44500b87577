"""Grouped summaries of fields, fires, diagnostics and decoded forecast rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import geo, physics
from airlake.functions.numeric import to_double


def fires_summary(fires: DataFrame, lat: str, lon: str, frp: str, t: str, box: dict = geo.NCR_BOX) -> DataFrame:
    return fires.filter(geo.in_box(F.col(lat), F.col(lon), **box)).agg(
        F.count("*").alias("n_detections"), F.round(F.coalesce(F.sum(to_double(F.col(frp))), F.lit(0.0)), 1).alias("frp_sum_mw"),
        F.max(t).alias("last_detection_at"))


def field_stats(field: DataFrame, t: str, species: list[str]) -> DataFrame:
    """Per time mean, min and max of each species over the cells."""
    return field.groupBy(t).agg(*[x for s in species for x in (
        F.avg(s).alias(f"{s}_mean"), F.min(s).alias(f"{s}_min"), F.max(s).alias(f"{s}_max"))])


def field_range(stats: DataFrame, species: list[str]) -> DataFrame:
    """Range over all times (at least one wide) and largest time mean, from the per-time table."""
    lo = {s: F.min(f"{s}_min") for s in species}
    hi = {s: F.max(f"{s}_max") for s in species}
    return stats.agg(*[x for s in species for x in (
        lo[s].alias(f"{s}_lo"), F.when(lo[s] == hi[s], lo[s] + 1).otherwise(hi[s]).alias(f"{s}_hi"), F.max(f"{s}_mean").alias(f"{s}_peak_mean"))])


def grid_pack(field: DataFrame, t: str, cols: dict[str, int]) -> DataFrame:
    """Per time one array per column, ordered by (j, i) and rounded; arrays are grid-sized."""
    cell = F.sort_array(F.collect_list(F.struct("j", "i", *cols))).alias("_c")
    d = field.groupBy(t).agg(cell, (F.max("j") + 1).alias("ny"), (F.max("i") + 1).alias("nx"))
    rounded = lambda c, n: F.transform("_c", lambda x: F.round(x[c], n)).alias(c)
    return d.select(t, "ny", "nx", *[rounded(c, n) for c, n in cols.items()])


def last_time(df: DataFrame, t: str) -> DataFrame:
    return df.filter(F.col(t) == df.agg(F.max(t).alias("m")).scalar())


def met_pivot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Decoded rows (keys, var, level, value) to one wide row per key, in display units.

    The terrain height is needed for the surface pressure; a missing one fails the job.
    """
    # fixed values: (variable, level) of each wide column
    names = {("2t", 2): "t2m", ("2r", 2): "rh", ("gust", 0): "gust", ("orog", 0): "hgt", ("t", 925): "t925", ("t", 850): "t850", ("t", 700): "t700",
             ("u", 925): "u925", ("v", 925): "v925", ("u", 850): "u850", ("v", 850): "v850", ("u", 700): "u700", ("v", 700): "v700",
             ("10u", 10): "u10", ("10v", 10): "v10"}
    tag = F.concat_ws("@", F.col("var"), F.col("level").cast("string"))
    wide = rows.withColumn("_tag", tag).groupBy(*keys).pivot("_tag", [f"{v}@{lv}" for v, lv in names]).agg(F.first("value", ignorenulls=True))
    wide = wide.withColumnsRenamed({f"{v}@{lv}": n for (v, lv), n in names.items()})
    hgt = F.when(F.col("hgt").isNull(), F.raise_error(F.lit("terrain height missing")).cast("double")).otherwise(F.col("hgt"))
    c = lambda n: F.col(n) - F.lit(273.15)
    return wide.select(
        *keys, c("t2m").alias("t2m_c"), F.col("rh").alias("rh_pct"), F.hypot("u10", "v10").alias("ws10_ms"),
        geo.wind_direction(F.col("u10"), F.col("v10")).alias("wd_deg"), F.col("gust").alias("gust_ms"),
        physics.surface_pressure(hgt, c("t925")).alias("prmsl_hpa"), c("t925").alias("t925_c"), c("t850").alias("t850_c"), c("t700").alias("t700_c"),
        F.hypot("u925", "v925").alias("ws925_ms"), F.hypot("u850", "v850").alias("ws850_ms"), F.hypot("u700", "v700").alias("ws700_ms"))


def inversion_summary(diag: DataFrame, hour: str) -> DataFrame:
    return diag.groupBy(hour).agg(
        F.avg("strength_k").alias("strength_k_avg"), F.avg("height_m").alias("height_m_avg"), F.avg("trapping_idx").alias("trapping_idx_avg"),
        F.avg("probability").alias("probability_avg"), F.avg((F.col("probability") > 0.5).cast("int")).alias("active_fraction"), F.avg("run").alias("duration_avg"))


def long_block(df: DataFrame, block: str, item: Column, cols: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.lit(block).alias("block"), item.cast("string").alias("item"), F.explode(cells).alias("e")).select("block", "item", "e.name", "e.value")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
