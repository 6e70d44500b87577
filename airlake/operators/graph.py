"""Station graph: nearest neighbours, wind and correlation edges, normalisation, smoothing.

Neighbour search never compares all pairs: places are indexed by square cells at
doubling sizes and each place is joined only with the cells that can hold its
answer.  Stations that share a place are represented by the few lowest ids that can
appear in any answer, so a crowded place does not multiply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from airlake.functions import geo
from airlake.functions.numeric import clip, div

FINEST_DEG = 0.002
LEVELS = 19
KM_PER_DEG = 111.0


def _distance(metric: str, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    if metric == "degrees":
        d = F.hypot(a_lat - b_lat, a_lon - b_lon)
    else:
        d = geo.haversine_km(a_lat, a_lon, b_lat, b_lon, geo.EARTH_RADIUS_KM["station_graph"])
    return F.round(d, 6)  # equal distances stay equal, so the id decides


def knn(stations: DataFrame, k: int, key: str = "station_id", metric: str = "km") -> DataFrame:
    """Rows (src, dst, dist): the k nearest others by (distance, id).

    For every place the smallest cell size is chosen at which its own cell holds more
    than k stations; these lie within sqrt(2) cell sizes, so the block of neighbouring
    cells that covers this radius holds the exact answer.
    """
    st = stations.select(F.col(key).alias("id"), "lat", "lon")
    in_place = W.partitionBy("lat", "lon").orderBy("id")
    reps = st.withColumn("_r", F.row_number().over(in_place)).filter(F.col("_r") <= k + 1).drop("_r")
    places = st.groupBy("lat", "lon").agg(F.count("*").alias("_n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("lv")
    size = F.lit(FINEST_DEG) * F.pow(F.lit(2.0), F.col("lv"))
    cell = lambda c: F.floor(F.col(c) / size)

    own = places.select("lat", "lon", "_n", levels).withColumns({"cy": cell("lat"), "cx": cell("lon")})
    crowd = own.groupBy("lv", "cy", "cx").agg(F.sum("_n").alias("_c")).filter((F.col("_c") > k) | (F.col("lv") == LEVELS - 1))
    level = own.join(crowd, ["lv", "cy", "cx"]).groupBy("lat", "lon").agg(F.min("lv").alias("lv"))

    if metric == "degrees":
        ring = F.lit(2)
    else:
        edge = F.least(F.abs(F.col("lat")) + F.lit(2.0) * size, F.lit(89.9))
        ring = F.least(F.ceil(F.lit(1.4143) / F.cos(F.radians(edge))), F.ceil(F.lit(360.0) / size) + 1).cast("int")
    want = (
        level.withColumns({"cy": cell("lat"), "cx": cell("lon"), "_ring": ring})
        .withColumn("_dy", F.explode(F.sequence(F.lit(-2), F.lit(2))))
        .withColumn("_dx", F.explode(F.sequence(-F.col("_ring"), F.col("_ring"))))
        .select("lat", "lon", "lv", (F.col("cy") + F.col("_dy")).alias("cy"), (F.col("cx") + F.col("_dx")).alias("cx"))
    )
    # copies shifted by a full turn let cells meet across the date line
    turns = F.array(F.lit(0.0), F.when(F.col("lon") > 0, F.lit(-360.0)).otherwise(F.lit(360.0))) if metric == "km" else F.array(F.lit(0.0))
    index = (
        reps.withColumn("_turn", F.explode(turns)).select("id", "lat", "lon", "_turn", levels)
        .select("id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "lv",
                F.floor(F.col("lat") / size).alias("cy"), F.floor((F.col("lon") + F.col("_turn")) / size).alias("cx"))
    )
    cand = want.join(index, ["lv", "cy", "cx"]).select(
        "lat", "lon", "id", _distance(metric, F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon")).alias("dist")).distinct()
    best = W.partitionBy("lat", "lon").orderBy("dist", "id")
    near = cand.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).groupBy("lat", "lon").agg(
        F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("_near"))
    mine = F.slice(F.filter("_near", lambda x: x["id"] != F.col("src")), 1, k)
    return (st.withColumnRenamed("id", "src").join(near, ["lat", "lon"])
            .select("src", F.explode(mine).alias("e")).select("src", F.col("e.id").alias("dst"), F.col("e.dist").alias("dist")))


def knn_edges(stations: DataFrame, k: int, key: str = "station_id") -> DataFrame:
    """Symmetric weights: +1 for each direction in which a pair is near."""
    e = knn(stations, k, key)
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


#: Ids of one place that a row holds, and stations of a cell that one task pairs with its neighbours at a time.
PLACE_IDS, CELL_STATIONS = 128, 256


def _places_within(stations: DataFrame, radius_km: float, key: str) -> DataFrame:
    """Rows (a_ids, a_lat, a_lon, b_ids, b_lat, b_lon, dist, own): pairs of places within a radius with the stations of both.

    A place's stations are held in lists of a bounded length, so that a distance is taken per pair of lists and not of stations.
    Every two lists appear once, a list with itself too (``own``).  Lists meet through radius-sized cells; a cell with many stations
    is shared by as many tasks as its measured size asks for.
    """
    cell = radius_km / KM_PER_DEG
    st = stations.select(F.col(key).alias("id"), "lat", "lon").filter("id is not null and lat is not null and lon is not null")
    size = st.groupBy("lat", "lon").agg(F.ceil(F.count("*") / PLACE_IDS).alias("_lists"))
    units = st.join(size, ["lat", "lon"]).groupBy("lat", "lon", F.pmod(F.xxhash64("id"), F.col("_lists")).alias("l")).agg(F.collect_list("id").alias("ids")).withColumns(
        {"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    shares = units.groupBy("cy", "cx").agg(F.ceil(F.sum(F.size("ids")) / CELL_STATIONS).cast("int").alias("_shares"))
    share = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("s")
    ring = F.least(F.ceil(F.lit(1.0) / F.cos(F.radians(F.least(F.abs(F.col("lat")) + F.lit(2 * cell), F.lit(89.9))))), F.lit(int(360 / cell) + 1)).cast("int")
    ask = (units.withColumn("_ring", ring).withColumn("_dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
           .withColumn("_dx", F.explode(F.sequence(-F.col("_ring"), F.col("_ring"))))
           .select("ids", "lat", "lon", "l", (F.col("cy") + F.col("_dy")).alias("cy"), (F.col("cx") + F.col("_dx")).alias("cx"))
           .join(shares, ["cy", "cx"]).withColumn("s", F.pmod(F.xxhash64("lat", "lon", "l"), F.col("_shares")).cast("int")))
    held = units.join(shares, ["cy", "cx"]).select("ids", "lat", "lon", "l", "cy", "cx", share)
    # the pairs that come out weigh much more than the rows that meet, so the number of tasks is not cut by the size of these
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda d, n: d.select("cy", "cx", "s", *[F.col(c).alias(f"{n}_{c}") for c in ("ids", "lat", "lon", "l")]).repartition(tasks, "cy", "cx", "s")
    a, b = (F.struct(f"{n}_lat", f"{n}_lon", f"{n}_l") for n in "ab")
    met = side(ask, "a").join(side(held, "b"), ["cy", "cx", "s"]).filter(
        (F.abs(F.col("a_lat") - F.col("b_lat")) <= cell) & (a <= b))
    d = met.withColumns({"dist": _distance("km", F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), "own": a == b})
    return d.filter(F.col("dist") <= radius_km).select("a_ids", "a_lat", "a_lon", "b_ids", "b_lat", "b_lon", "dist", "own")


def pairs_within(stations: DataFrame, radius_km: float, key: str = "station_id") -> DataFrame:
    """Pairs a < b within a radius, found through radius-sized cells."""
    d = (_places_within(stations, radius_km, key).withColumn("x", F.explode("a_ids")).withColumn("y", F.explode("b_ids"))
         .filter((F.col("x") < F.col("y")) | ((F.col("x") > F.col("y")) & ~F.col("own"))))
    first = lambda p, q: F.when(F.col("x") < F.col("y"), F.col(p)).otherwise(F.col(q))
    return d.select(first("x", "y").alias("a"), first("a_lat", "b_lat").alias("a_lat"), first("a_lon", "b_lon").alias("a_lon"),
                    first("y", "x").alias("b"), first("b_lat", "a_lat").alias("b_lat"), first("b_lon", "a_lon").alias("b_lon"), "dist")


def in_season(month: int, months: tuple[int, int]) -> bool:
    lo, hi = months
    return lo <= month <= hi if lo <= hi else month >= lo or month <= hi


def wind_edges(stations: DataFrame, radius_km: float = 60.0, wind: float = 300.0, month: int = 10, months: tuple[int, int] = (10, 11),
               key: str = "station_id") -> DataFrame:
    """Symmetric transport weights |cos(bearing - wind)|; empty outside the season."""
    p = _places_within(stations, radius_km, key)
    if not in_season(month, months):
        p = p.filter("false")
    weight = lambda a, b: F.abs(F.cos(F.radians(geo.bearing_deg(F.col(f"{a}_lat"), F.col(f"{a}_lon"), F.col(f"{b}_lat"), F.col(f"{b}_lon")) - wind)))
    p = p.select("a_ids", "b_ids", weight("a", "b").alias("ab"), weight("b", "a").alias("ba"), "own")
    # both directions are made from pairs of places; a list with itself holds them already
    way = lambda a, b: F.struct(F.col(f"{a}_ids").alias("src"), F.col(f"{b}_ids").alias("dst"), F.col(a + b).alias("up"), F.col(b + a).alias("down"))
    ways = p.select(F.explode(F.when(F.col("own"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))).alias("e")).select("e.*")
    e = ways.withColumn("src", F.explode("src")).withColumn("dst", F.explode("dst")).filter("src <> dst")
    # the bearing is that from the lower id to the higher one
    return e.select("src", "dst", F.when(F.col("src") < F.col("dst"), F.col("up")).otherwise(F.col("down")).alias("w"))


#: Stations of a block, and hours that one task holds of a pair of blocks.
BLOCK_STATIONS, BLOCK_HOURS = 256, 1 << 14


def pair_moments(series: DataFrame, key: str, t: str, value: str, block: int = BLOCK_STATIONS, hours: int = BLOCK_HOURS) -> DataFrame:
    """Rows (a, b, n, x, y, xx, yy, xy): moments of every two stations over the times both have a value; a pair appears once.

    A blocked Gram matrix: a row holds what a block of stations measured at one time, and a task sums the products of two blocks
    as matrices, with matrices of counts for what is missing.  So as many rows move as there are times and pairs of blocks, not pairs of
    stations.  Values are taken relative to their station's mean, which no result but the sums depends on.
    """
    s = series.select(F.col(key).alias("k"), F.col(t).alias("t"), F.col(value).cast("double").alias("v")).filter("k is not null and t is not null and v is not null")
    s = s.join(s.groupBy("k").agg(F.avg("v").alias("_m")), "k").withColumn("v", F.col("v") - F.col("_m"))
    size = s.agg(F.count_distinct("k").alias("k"), F.approx_count_distinct("t").alias("t")).first()
    blocks, slices = max(1, -(-size.k // block)), max(1, -(-size.t // hours))
    by_time = s.groupBy("t", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("blk")).agg(F.collect_list(F.struct("k", "v")).alias("e"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = by_time.withColumn("_o", other).select(F.least("blk", "_o").alias("a"), F.greatest("blk", "_o").alias("b"), "blk", F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int").alias("slice"), "t", "e")
    kind = dict(s.dtypes)["k"]

    def gram(some: pa.Table) -> pa.Table:
        e = some["e"].combine_chunks()
        flat = e.flatten()
        row = np.repeat(np.arange(len(e)), np.diff(np.asarray(e.offsets)))
        # the number of every row's time among the times of the group
        time = np.unique(some["t"].cast(pa.int64()).to_numpy() if pa.types.is_temporal(some["t"].type) else np.asarray(some["t"].to_pylist()), return_inverse=True)[1]
        names, at = np.unique(np.asarray(flat.field("k").to_pylist()), return_inverse=True)
        v, blk = flat.field("v").to_numpy(), some["blk"].to_numpy()[row]
        a, b = some["a"][0].as_py(), some["b"][0].as_py()
        side = {}
        for which in {a, b}:
            own = blk == which
            used, place = np.unique(at[own], return_inverse=True)
            shape, cell = (time.max() + 1, len(used)), (time[row[own]], place)
            held = [np.zeros(shape) for _ in range(3)]
            for m, w in zip(held, (np.ones(own.sum()), v[own], v[own] ** 2)):
                np.add.at(m, cell, w)
            side[which] = (names[used], *held)
        (left, an, ax, axx), (right, bn, bx, bxx) = side[a], side[b]
        sums = [an.T @ bn, ax.T @ bn, an.T @ bx, axx.T @ bn, an.T @ bxx, ax.T @ bx]
        i, j = np.nonzero(np.triu(sums[0], 1) if a == b else sums[0])
        return pa.table([pa.array(left[i].tolist()), pa.array(right[j].tolist()), *[pa.array(m[i, j]) for m in sums]], names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    made = f"a {kind}, b {kind}, n double, x double, y double, xx double, yy double, xy double"
    part = met.groupBy("a", "b", "slice").applyInArrow(_typed(gram, kind), made)
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def _typed(fn, kind: str):
    """``fn`` with its station columns in the type of ``kind``."""
    as_type = pa.string() if kind == "string" else {"int": pa.int32(), "bigint": pa.int64()}[kind]

    def run(some: pa.Table) -> pa.Table:
        out = fn(some)
        return pa.table([out["a"].cast(as_type), out["b"].cast(as_type), *out.columns[2:]], names=out.column_names)

    return run


def corr_edges(series: DataFrame, edges: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Overlay: weight = max(weight, correlation clipped to 0..1).

    The correlation matrix of the stations is the result itself (``pair_moments``); a series that doesn't vary while both are there has none.
    """
    mean = lambda c: F.col(c) / F.col("n")
    # less than what rounding leaves of the squares is no variance
    var = lambda s, q: F.when(mean(q) - mean(s) * mean(s) > mean(q) * 1e-13, mean(q) - mean(s) * mean(s)).otherwise(0.0)
    r = pair_moments(series, key, t, value).select("a", "b", div(mean("xy") - mean("x") * mean("y"), F.sqrt(var("x", "xx") * var("y", "yy"))).alias("r"))
    r = r.select("a", "b", F.coalesce(clip(F.col("r"), 0, 1), F.lit(0.0)).alias("r"))
    both = r.select(F.col("a").alias("src"), F.col("b").alias("dst"), "r").unionByName(r.select(F.col("b").alias("src"), F.col("a").alias("dst"), "r"))
    w = F.greatest(F.coalesce("w", F.lit(0.0)), F.coalesce("r", F.lit(0.0)))
    return edges.select("src", "dst", "w").join(both, ["src", "dst"], "full").select("src", "dst", w.alias("w")).filter("w > 0")


def normalize(edges: DataFrame) -> DataFrame:
    """w / sqrt(deg(src) deg(dst)) with deg = row sum."""
    deg = edges.groupBy("src").agg(F.sum("w").alias("_d"))  # one row per station
    d2 = deg.select(F.col("src").alias("dst"), F.col("_d").alias("_d2"))
    return edges.join(deg, "src").join(d2, "dst", "left").select(
        "src", "dst", F.coalesce(div(F.col("w"), F.sqrt(F.col("_d") * F.col("_d2"))), F.lit(0.0)).alias("w"))


def neighbour_smooth(values: DataFrame, stations: DataFrame, t: str, value: str, k: int = 6, key: str = "station_id") -> DataFrame:
    """Per time the inverse-degree-distance weighted mean of the k nearest others (weights sum to one).

    Means are taken per distinct list of neighbours, then handed to the stations that have it: what is summed at a time grows with the
    values and not with the stations that share a place.
    """
    e = knn(stations, k, key, metric="degrees").groupBy("src", "dst", "dist").agg(F.count("*").alias("c"))
    lists = e.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst", "c"))).alias("_list"))
    weight = lambda x: x["c"] / (x["dist"] + F.lit(0.01))
    total = F.aggregate("_list", F.lit(0.0), lambda s, x: s + weight(x))
    # a list goes by its lowest station from here on
    groups = lists.groupBy("_list").agg(F.min("src").alias("_l"))
    near = groups.select("_l", total.alias("_s"), F.explode("_list").alias("x")).select(
        "_l", F.col("x.dst").alias("dst"), (weight(F.col("x")) / F.greatest(F.col("_s"), F.lit(1e-9))).alias("_w"))
    v = values.select(t, F.col(key).alias("dst"), F.col(value).alias("_v"))
    means = v.join(near, "dst").groupBy(t, "_l").agg(F.sum(F.col("_w") * F.col("_v")).alias("smoothed"))
    return means.join(lists.join(groups, "_list").select("_l", "src"), "_l").select(t, F.col("src").alias(key), "smoothed")
