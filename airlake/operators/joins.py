"""Joins: registry, name matching, grid assignment and sampling, timeline and run comparisons."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import geo
from airlake.functions.numeric import div


@dataclass(frozen=True)
class GridSpec:
    """Regular node grid over a box; ``i`` runs along longitude, ``j`` along latitude."""

    nx: int
    ny: int
    box: dict = dc_field(default_factory=lambda: dict(geo.DOMAIN_BOX))


def cell_index(lat: Column, lon: Column, g: GridSpec, mode: str = "clamp") -> tuple[Column, Column]:
    """Nearest node in closed form.  ``clamp``: outside points take the edge node; ``strict``: they get null."""
    b = g.box

    def one(v: Column, lo: float, hi: float, n: int) -> Column:
        k = F.bround((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(n - 1), 0)
        return F.least(F.greatest(k, F.lit(0.0)), F.lit(float(n - 1))).cast("long")

    i, j = one(lon, b["lon_min"], b["lon_max"], g.nx), one(lat, b["lat_min"], b["lat_max"], g.ny)
    if mode == "strict":
        inside = geo.in_box(lat, lon, **b)
        return F.when(inside, i), F.when(inside, j)
    return i, j


def assign_cell(df: DataFrame, g: GridSpec, lat: str = "lat", lon: str = "lon", mode: str = "clamp") -> DataFrame:
    i, j = cell_index(F.col(lat), F.col(lon), g, mode)
    return df.withColumns({"i": i, "j": j})


def sample_at_stations(field: DataFrame, stations: DataFrame, g: GridSpec, cols: list[str], time: str, station: str = "station_id") -> DataFrame:
    """Value of the nearest cell per (station, time)."""
    cells = assign_cell(stations.select(station, "lat", "lon"), g).select(station, "i", "j")
    return field.select(time, "i", "j", *cols).join(cells, ["i", "j"]).select(station, time, *cols)


def registry_join(df: DataFrame, stations: DataFrame, name_col: str, registry_name: str = "name", membership_only: bool = False,
                  order: str = "station_id") -> DataFrame:
    """Inner join on the lower-cased, trimmed name; rows outside the registry are dropped.

    Of registry rows with one name the last by ``order`` counts.
    """
    key = F.lower(F.trim(F.col(name_col)))
    left = df.withColumn("_key", key)
    right = stations.withColumn("_key", F.lower(F.trim(F.col(registry_name))))
    if membership_only:
        return left.join(right.select("_key"), "_key", "left_semi").drop("_key")
    right = right.groupBy("_key").agg(F.max_by(F.struct(*stations.columns), order).alias("_row")).select("_key", "_row.*")
    return left.join(right, "_key").drop("_key")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def ordered_subsequence(needle: Column, hay: Column) -> Column:
    """True when all needle tokens appear in the hay tokens in order."""
    hit = F.aggregate(hay, F.lit(0), lambda p, tok: p + F.coalesce((F.get(needle, p) == tok).cast("int"), F.lit(0)))
    return hit == F.size(needle)


def match_stations(df: DataFrame, stations: DataFrame, text_col: str, order: str = "station_id") -> DataFrame:
    """Best registry entry per record: longest ordered-token match, the first registry row on ties.

    A station can only match a record that holds all of its tokens, so candidates come
    from an equi-join on each station's rarest token instead of comparing all pairs.
    Each distinct text is matched once.
    """
    reg = stations.withColumn("_need", tokens(F.col("name"))).filter(F.size("_need") > 0)
    each = reg.select(order, F.explode(F.array_distinct("_need")).alias("_tok"))
    freq = each.groupBy("_tok").agg(F.count("*").alias("_df"))
    rare = each.join(freq, "_tok").groupBy(order).agg(F.min_by("_tok", F.struct("_df", "_tok")).alias("_tok"))
    reg = reg.select(order, "_need").join(rare, order)
    texts = df.select(text_col).distinct().withColumn("_have", tokens(F.col(text_col)))
    cand = texts.withColumn("_tok", F.explode(F.array_distinct("_have"))).join(reg, "_tok")
    best = (
        cand.filter(ordered_subsequence(F.col("_need"), F.col("_have")))
        .groupBy(text_col).agg(F.min_by(order, F.struct((-F.size("_need")).alias("l"), F.col(order).alias("o"))).alias(order))
    )
    return df.join(best, text_col).join(stations, order)


def active_hours(fires: DataFrame, acq: str, life_h: float, name: str = "hour", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per fire and whole hour h with 0 <= h - acq < life; generated, not range-joined."""
    a = F.col(acq)
    floor = F.date_trunc("hour", a).cast("timestamp_ntz")
    first = F.when(floor == a, floor).otherwise(floor + F.expr("interval 1 hour"))
    last_exact = a + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(life_h * 3600.0 - 1e-6).cast("decimal(18,6)"))
    last = F.date_trunc("hour", last_exact).cast("timestamp_ntz")
    if start is not None:
        first = F.greatest(first, start)
    if end is not None:
        last = F.least(last, end)
    d = fires.withColumns({"_h0": first, "_h1": last}).filter("_h0 <= _h1")
    return d.withColumn(name, F.explode(F.sequence(F.col("_h0"), F.col("_h1"), F.expr("interval 1 hour")))).drop("_h0", "_h1")


def run_compare(on: DataFrame, off: DataFrame, lead: str, value: str) -> DataFrame:
    """Means of two runs over their common leads and the relative change."""
    j = on.select(lead, F.col(value).alias("_a")).join(off.select(lead, F.col(value).alias("_b")), lead)
    return j.agg(F.avg("_a").alias("coupled_mean"), F.avg("_b").alias("uncoupled_mean"), F.count("*").alias("n_leads")).withColumn(
        "delta_pct", (div(F.col("coupled_mean"), F.greatest(F.col("uncoupled_mean"), F.lit(1e-9))) - 1) * 100)


def idw_to_points(df: DataFrame, points: list[tuple[str, float, float]], value: str, lat: str = "lat", lon: str = "lon", keys: list[str] | None = None) -> DataFrame:
    """Inverse-squared-distance mean at a few named points; partial sums combine on the map side."""
    pts = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(float(a)).alias("pa"), F.lit(float(o)).alias("po")) for n, a, o in points])
    d = df.filter(F.col(value).isNotNull()).withColumn("_p", F.explode(pts))
    gap = F.greatest(F.hypot(F.col(lat) - F.col("_p.pa"), F.col(lon) - F.col("_p.po")), F.lit(1e-6))
    w = F.lit(1.0) / (gap * gap)
    return d.select(*(keys or []), F.col("_p.point").alias("point"), w.alias("_w"), F.col(value).alias("_v")).groupBy(*(keys or []), "point").agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("value"))
