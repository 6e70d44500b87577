"""Regular-grid interpolation: per-axis brackets, then equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _axis(source: DataFrame, col: str) -> Column:
    """Sorted nodes of one source axis as a scalar array (a grid axis has at most a few thousand nodes)."""
    return source.select(col).distinct().agg(F.sort_array(F.collect_list(col)).alias("a")).scalar()


def _nearest(target: DataFrame, source: DataFrame, col: str) -> DataFrame:
    d = target.select(col).distinct().withColumn("_ax", _axis(source, col))
    best = F.array_min(F.transform("_ax", lambda x: F.struct(F.abs(x - F.col(col)).alias("d"), x.alias("x"))))
    return d.select(col, best["x"].alias(f"_s_{col}"))


def regrid_nearest(source: DataFrame, target: DataFrame, values: list[str], keys: list[str], tkeys: list[str]) -> DataFrame:
    """Nearest source node per target node, each axis on its own; the lower node wins ties."""
    t = target.join(_nearest(target, source, "lat"), "lat").join(_nearest(target, source, "lon"), "lon")
    s = source.select(*keys, F.col("lat").alias("_s_lat"), F.col("lon").alias("_s_lon"), *values)
    return t.join(s, ["_s_lat", "_s_lon"]).select(*keys, *tkeys, *values)


def _bracket(target: DataFrame, source: DataFrame, col: str) -> DataFrame:
    """Two rows per target coordinate: bracketing node and weight; coordinates are clipped to the source range."""
    d = target.select(col).distinct().withColumn("_ax", _axis(source, col))
    d = d.withColumn("_c", F.least(F.greatest(F.col(col), F.element_at("_ax", 1)), F.element_at("_ax", -1)))
    below = F.size(F.filter("_ax", lambda x: x <= F.col("_c")))
    d = d.withColumn("_k", F.greatest(F.least(below, F.size("_ax") - 1), F.lit(1)))
    lo, hi = F.element_at("_ax", F.col("_k")), F.coalesce(F.try_element_at("_ax", F.col("_k") + 1), F.element_at("_ax", F.col("_k")))
    f = (F.col("_c") - lo) / F.greatest(hi - lo, F.lit(1e-12))
    pair = F.array(F.struct(lo.alias("s"), (F.lit(1.0) - f).alias("w")), F.struct(hi.alias("s"), f.alias("w")))
    return d.select(col, F.explode(pair).alias("e")).select(col, F.col("e.s").alias(f"_s_{col}"), F.col("e.w").alias(f"_w_{col}"))


def regrid_bilinear(source: DataFrame, target: DataFrame, values: list[str], keys: list[str], tkeys: list[str]) -> DataFrame:
    """Four-corner weighted sum per target node; works for ascending and descending source rows."""
    t = target.join(_bracket(target, source, "lat"), "lat").join(_bracket(target, source, "lon"), "lon")
    s = source.select(*keys, F.col("lat").alias("_s_lat"), F.col("lon").alias("_s_lon"), *values)
    w = F.col("_w_lat") * F.col("_w_lon")
    return t.join(s, ["_s_lat", "_s_lon"]).groupBy(*keys, *tkeys).agg(*[F.sum(w * F.col(v)).alias(v) for v in values])
