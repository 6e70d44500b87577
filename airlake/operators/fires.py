"""Fire exposure: cleaning aggregates, gridded kernels and emissions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import geo, physics
from airlake.operators.series import trailing_sums
from airlake.session import cut_lineage


def hourly_fire_features(fires: DataFrame, hours: DataFrame, wind: DataFrame | None = None, bearing: str = "fire_to_city",
                         rolls: tuple[int, ...] = (6, 12, 24, 48)) -> DataFrame:
    """Regional detections (t, lat, lon, frp) to one row per hour of ``hours`` (t).

    ``bearing`` names the direction that is compared with the wind: from the fire to
    the city (as published) or from the city to the fire.  Hours without detections
    get zeros and a null distance.
    """
    la, lo = (F.lit(x) for x in geo.CITY_CENTRE)
    lat, lon = F.col("lat"), F.col("lon")
    ang = geo.bearing_deg(lat, lon, la, lo) if bearing == "fire_to_city" else geo.bearing_deg(la, lo, lat, lon)
    d = fires.filter(geo.in_box(lat, lon, **geo.REGION_BOX)).select(
        "t", "frp", geo.haversine_km(lat, lon, la, lo).alias("dist"), ang.alias("ang"))
    if wind is not None:
        d = d.join(wind.select("t", "wd"), "t", "left").withColumn("up", geo.upwind(F.col("ang"), F.col("wd")))
    else:
        d = d.withColumn("up", geo.upwind(F.col("ang")))
    per = d.groupBy("t").agg(
        F.count("*").alias("fire_count"), F.sum("frp").alias("total_frp"), F.avg("frp").alias("mean_frp"), F.max("frp").alias("max_frp"),
        F.count_if("up").alias("upwind_fire_count"), F.sum(F.when(F.col("up"), F.col("frp"))).alias("upwind_frp"),
        F.sum(F.when(F.col("dist") <= 50, F.col("frp"))).alias("close_frp_50km"), F.min("dist").alias("min_distance_km"))
    out = hours.select("t").join(per, "t", "left").fillna(0, subset=[c for c in per.columns if c not in ("t", "min_distance_km")])
    return trailing_sums(out, "t", "total_frp", rolls, "frp_")


def urban_base(cells: DataFrame, nx: int, ny: int, box: dict = geo.DOMAIN_BOX) -> DataFrame:
    """Diffuse urban emission (g/h) per (hour, i, j) row; the factor depends on the hour only."""
    mid = math.radians((box["lat_min"] + box["lat_max"]) / 2)
    cell_km2 = ((box["lat_max"] - box["lat_min"]) / (ny - 1) * geo.KM_PER_DEGREE) * (
        (box["lon_max"] - box["lon_min"]) / (nx - 1) * geo.KM_PER_DEGREE * math.cos(mid))
    base = physics.URBAN_KG_KM2_DAY * 1000.0 / 24.0 * cell_km2
    return cells.withColumn("g_per_h", F.lit(base) * physics.diurnal_factor(physics.local_solar_hour(F.col("hour"))))


MIN_FRP = 10.0
LIFETIME_H = 6.0
KERNEL_KM = 40.0
CELL_EF_G_PER_MJ = 0.009
#: Fires that one task adds up at a time for one key; a key with more is shared by as many tasks as it needs.
GROUP_ROWS = 50_000
#: Fire-cell terms that are held at a time, eight numbers each.
TERMS = 1 << 18
#: Fires and hours of one cell that are held at a time, so that a block stays in a core's cache.
FIRES, HOURS = 8192, 8


def _shared(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` with ``_salt``, rows (keys, _salts)): groups of about ``rows`` rows, as many per key as its measured size asks for."""
    if not keys:
        n = df.agg(F.count("*").alias("n")).scalar()
        sized = df.withColumn("_salts", F.greatest(F.lit(1), F.ceil(n / rows)).cast("int"))
        salts = None
    else:
        salts = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("_salts"))
        sized = df.join(salts, keys)
    return sized.withColumn("_salt", _salt()).drop("_salts"), salts


def _salt() -> Column:
    return F.pmod(F.xxhash64("lat", "lon"), F.col("_salts")).cast("int")


def _lat_factor(fire_lat: np.ndarray, cell_lat: np.ndarray) -> np.ndarray:
    x = (cell_lat[None] - fire_lat[:, None]) * (geo.KM_PER_DEGREE / KERNEL_KM)
    return np.exp(-(x * x))


def _lon_factor(fire_lat: np.ndarray, fire_lon: np.ndarray, cell_lon: np.ndarray) -> np.ndarray:
    x = (cell_lon[None] - fire_lon[:, None]) * np.cos(np.radians(fire_lat))[:, None] * (geo.KM_PER_DEGREE / KERNEL_KM)
    return np.exp(-(x * x))


def _axis(grid: DataFrame, idx: str, coord: str) -> tuple[np.ndarray, np.ndarray]:
    """One grid axis as (indices, coordinates): as many numbers as the grid is wide."""
    rows = grid.select(F.col(idx).cast("long").alias("k"), F.col(coord).cast("double").alias("x")).distinct().orderBy("k", "x").collect()
    return np.array([r.k for r in rows], np.int64), np.array([r.x for r in rows], np.float64)


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in columns]


def _kernel_sums(places: DataFrame, keys: list[str], grid: DataFrame, normalised: bool) -> DataFrame:
    """Rows (keys, i, j, s): sum of power x Gaussian kernel over all fires of a key.

    The kernel is a product of a latitude and a longitude factor, so a group's sums on the whole grid are one matrix
    product of the two factors.  No row is multiplied by cells before the sums: groups send a row per
    grid column, with the column's values as an array.
    """
    (i, x), (j, y) = _axis(grid, "i", "lon"), _axis(grid, "j", "lat")
    kinds = [(c, t) for c, t in places.dtypes if c in keys]

    def run(some: pa.Table) -> pa.Table:
        total = np.zeros((len(x), len(y)))
        lat, lon, frp = _numbers(some, "lat", "lon", "frp")
        step = max(1, TERMS // max(1, len(x) + len(y)))
        for at in range(0, len(lat), step):
            part = slice(at, at + step)
            up, along = _lat_factor(lat[part], y), _lon_factor(lat[part], lon[part], x)
            share = frp[part]
            if normalised:
                whole = up.sum(axis=1) * along.sum(axis=1)
                share = share / np.where(whole > 0, whole, 1.0)
            total += (along * share[:, None]).T @ up
        own = [pa.chunked_array([pa.repeat(some[c][0], len(x))]) for c in keys]
        return pa.table([*own, pa.array(i), pa.array(total.tolist(), pa.list_(pa.float64()))], names=[*keys, "i", "_s"])

    places = places.filter("lat is not null and lon is not null")
    spread, _ = _shared(places.select(*keys, "lat", "lon", F.col("frp").cast("double").alias("frp")), keys, GROUP_ROWS)
    made = "".join(f"{c} {t}, " for c, t in kinds) + "i long, _s array<double>"
    sums = spread.groupBy(*keys, "_salt").applyInArrow(run, made)
    at = F.element_at(F.lit(j.tolist()).cast("array<long>"), F.col("_at") + 1) if len(j) else F.lit(None).cast("long")
    each = sums.select(*keys, "i", F.posexplode("_s").alias("_at", "_v")).groupBy(*keys, "i", "_at").agg(F.sum("_v").alias("s"))
    return each.select(*keys, "i", at.alias("j"), "s")


def fire_density(fires: DataFrame, grid: DataFrame, min_frp: float = MIN_FRP) -> DataFrame:
    """Per cell the kernel-weighted power; fires at one place are summed first."""
    places = fires.filter(F.col("frp") >= min_frp).groupBy("lat", "lon").agg(F.sum("frp").alias("frp"))
    return _kernel_sums(places, [], grid, normalised=False).withColumnRenamed("s", "density")


def _spans(fires: DataFrame, acq: str, life_h: float) -> DataFrame:
    """First active hour and number of active hours per fire."""
    a = F.col(acq)
    floor = F.date_trunc("hour", a).cast("timestamp_ntz")
    first = F.when(floor == a, floor).otherwise(floor + F.expr("interval 1 hour"))
    gap_h = F.timestamp_diff("MICROSECOND", a, first) / F.lit(3.6e9)
    return fires.withColumns({"_first": first, "_n": F.ceil(F.lit(float(life_h)) - gap_h).cast("int")}).filter("_n > 0")


def _active() -> Column:
    """One row per active hour."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.col("_first") + F.make_dt_interval(F.lit(0), k)))


def _spread_hours(df: DataFrame, cols: list[str], values: list[str], hours: DataFrame | None) -> DataFrame:
    """Sums per first hour to sums per active hour, optionally limited to the hours of a run."""
    d = df.withColumn("hour", _active())
    if hours is not None:
        d = d.join(hours.select("hour").distinct(), "hour", "left_semi")
    return d.groupBy("hour", *cols).agg(*[F.sum(v).alias(v) for v in values])


def kernel_emissions(fires: DataFrame, grid: DataFrame, acq: str = "acq", hours: DataFrame | None = None, life_h: float = LIFETIME_H,
                     min_frp: float = MIN_FRP, fuel_scale: float = 1000.0) -> DataFrame:
    """Rows (hour, i, j, one column per species) in g/h; each fire's mass is spread by its normalised kernel."""
    d = _spans(fires.filter(F.col("frp") >= min_frp), acq, life_h)
    places = d.groupBy("_first", "_n", "lat", "lon").agg(F.sum("frp").alias("frp"))
    per = _kernel_sums(places, ["_first", "_n"], grid, normalised=True)
    out = _spread_hours(per, ["i", "j"], ["s"], hours)
    return out.select("hour", "i", "j", *[c.alias(sp) for sp, c in physics.fire_emission(F.col("s"), fuel_scale).items()])


def cell_hour_emissions(fires: DataFrame, acq: str = "acq", hours: DataFrame | None = None, life_h: float = LIFETIME_H, min_frp: float = MIN_FRP,
                        fraction: str = "surface_fraction") -> DataFrame:
    """Rows (hour, i, j, surface, elevated) in g/h; the fire's cell and surface fraction are input columns."""
    rate = F.col("frp") * F.lit(CELL_EF_G_PER_MJ * 3600.0)
    d = _spans(fires.filter((F.col("frp") >= min_frp) & F.col("i").isNotNull() & F.col("j").isNotNull()), acq, life_h)
    per = d.groupBy("_first", "_n", "i", "j").agg(F.sum(rate * F.col(fraction)).alias("surface_gph"), F.sum(rate * (F.lit(1.0) - F.col(fraction))).alias("elevated_gph"))
    return _spread_hours(per, ["i", "j"], ["surface_gph", "elevated_gph"], hours)


def fire_influence(fires: DataFrame, wind: DataFrame, acq: str = "acq", life_h: float = LIFETIME_H, min_frp: float = MIN_FRP,
                   angle: str = "math") -> DataFrame:
    """Rows (hour, i, j, influence, upwind, downwind), each scaled by its largest value over all hours and cells.

    ``wind`` holds (hour, i, j, lat, lon, wd).  Fires that burn over the same hours, in groups of a measured size, meet the wind of these
    hours in one task.  Distance, direction and kernel of a fire and a cell are the same in every hour, so they are taken once and only the
    projection on the wind is taken per hour, a block of fires at a time.  A group sends one row per hour and cell, so a fire is shuffled
    once and nothing of the size fires x cells is ever shuffled or sorted.  ``angle`` math keeps the published projection (cos, sin) on
    (east, north); ``met`` uses the direction the wind blows to.
    """
    runs = ["_first", "_n"]
    f = _spans(fires.filter((F.col("frp") >= min_frp) & F.col("lat").isNotNull() & F.col("lon").isNotNull()), acq, life_h)
    salts = f.groupBy(*runs).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("_salts"))
    d = f.groupBy(*runs, "lat", "lon").agg(F.sum(F.col("frp").cast("double")).alias("frp")).join(salts, runs).select(
        *runs, _salt().alias("_salt"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "frp")
    winds = wind.filter("wd is not null and lat is not null and lon is not null").select(
        "hour", "i", "j", *[F.col(c).cast("double").alias(c) for c in ("lat", "lon", "wd")])
    kinds = dict(winds.dtypes)
    burning = salts.withColumn("hour", _active()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    met = winds.join(burning.select("hour", F.col("_first").alias("_from"), F.col("_n").alias("_hours"), "_salt"), "hour")
    turn = (lambda w: np.radians(w)) if angle == "math" else (lambda w: np.radians(270.0 - w))
    cols = ("influence", "upwind", "downwind")

    def run(some: pa.Table, cells: pa.Table) -> pa.Table:
        if not some.num_rows or not cells.num_rows:
            return cells.slice(0, 0).select(["hour", "i", "j"]).append_column("influence", pa.array([], pa.float64())).append_column(
                "upwind", pa.array([], pa.float64())).append_column("downwind", pa.array([], pa.float64()))
        sums = _influence(*_numbers(some, "lat", "lon", "frp"), *_numbers(cells, "lat", "lon"), turn(cells["wd"].to_numpy()))
        return pa.table([cells["hour"], cells["i"], cells["j"], *map(pa.array, sums)], names=["hour", "i", "j", *cols])

    made = f"hour {kinds['hour']}, i {kinds['i']}, j {kinds['j']}, influence double, upwind double, downwind double"
    groups = d.groupBy(*runs, "_salt").cogroup(met.groupBy("_from", "_hours", "_salt"))
    return groups.applyInArrow(run, made).groupBy("hour", "i", "j").agg(*[F.sum(c).alias(c) for c in cols])


def _influence(f_lat: np.ndarray, f_lon: np.ndarray, power: np.ndarray, lat: np.ndarray, lon: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Influence, upwind and downwind sums (3 x rows) of all fires for rows of a cell's place and its wind in one hour."""
    # rows of one place lie together and take its distances and kernel once
    order = np.lexsort((lon, lat))
    lat, lon, wind = lat[order], lon[order], np.column_stack((np.cos(turned), np.sin(turned)))[order]
    ends = [*(np.flatnonzero((np.diff(lat) != 0) | (np.diff(lon) != 0)) + 1).tolist(), len(lat)]
    sums = np.zeros((len(lat), 3))
    for at in range(0, len(f_lat), FIRES):
        f_y, f_x, weight = f_lat[at:at + FIRES], f_lon[at:at + FIRES], np.empty((2, len(f_lat[at:at + FIRES])))
        to_east, toward = np.cos(np.radians(f_y)) * geo.KM_PER_DEGREE, np.empty_like(weight)
        weight[0] = power[at:at + FIRES]
        for begin, end in zip([0, *ends], ends):
            np.multiply(lon[begin] - f_x, to_east, out=toward[0])
            np.multiply(lat[begin] - f_y, geo.KM_PER_DEGREE, out=toward[1])
            d2 = toward[0] * toward[0] + toward[1] * toward[1]
            np.multiply(weight[0], np.exp(d2 * (-1.0 / (KERNEL_KM * KERNEL_KM))), out=weight[1])
            toward /= np.sqrt(d2) + 1
            kernel = weight[1].sum()
            for some in range(begin, end, HOURS):
                rows = slice(some, min(some + HOURS, end))
                # alignment of the fire-to-cell vector with the wind, -1..1; |a| + a is twice its positive part, |a| - a twice the negative
                a = wind[rows] @ toward
                twice = np.abs(a)
                twice += a
                down, kernel_down = weight @ twice.T
                a += a
                twice -= a
                sums[rows, 0] += kernel + 0.8 * kernel_down
                sums[rows, 1] += 0.5 * (twice @ weight[0])
                sums[rows, 2] += 0.5 * down
    out = np.empty((3, len(lat)))
    out[:, order] = sums.T
    return out


def normalise_by_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column over its global maximum (one aggregate row, joined as a scalar).

    The sums are checkpointed first, because both passes need them.
    """
    df = cut_lineage(df)
    top = df.agg(F.struct(*[F.max(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumn("_m", top).withColumns({
        c: F.col(c) / F.when(F.col("_m").getField(c) > 0, F.col("_m").getField(c)).otherwise(F.lit(1.0)) for c in cols}).drop("_m")


def fire_state(fires: DataFrame, hours: DataFrame, influence: DataFrame | None = None, acq: str = "acq", life_h: float = LIFETIME_H) -> DataFrame:
    """Per hour: fires known, fires active, active power and mean influence."""
    known = fires.agg(F.count("*").alias("n")).scalar()
    per = _spread_hours(_spans(fires, acq, life_h).groupBy("_first", "_n").agg(F.count("*").alias("n_active"), F.sum("frp").alias("total_frp_mw")),
                        [], ["n_active", "total_frp_mw"], None)
    out = hours.select("hour").join(per, "hour", "left").fillna(0, subset=["n_active", "total_frp_mw"]).withColumn("n_fires", known)
    if influence is not None:
        out = out.join(influence.groupBy("hour").agg(F.avg("influence").alias("mean_influence")), "hour", "left").fillna(0.0, subset=["mean_influence"])
    return out
