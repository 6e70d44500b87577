"""Brute-force checks of the operators that avoid gathering hot groups or comparing all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlake.operators import alerts as al, fires, graph, quantiles, series
from airlake.sources import inventory, writers
from airlake.session import new_dir


def haversine(a, b, r=6371.0088):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * r * math.asin(min(1.0, math.sqrt(x)))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot", rnd.choice([0.0, -1.5, 7.25, rnd.gauss(0, 1e6), rnd.random() * 1e-9])) for _ in range(3000)]
    rows += [(f"k{n % 7}", rnd.gauss(50, 20)) for n in range(300)] + [("single", 4.0), ("neg", -2.0), ("neg", -8.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.0, "b": 0.25, "med": 0.5, "q9": 0.9, "top": 1.0}
    got = {r.k: r for r in quantiles.quantiles_of_counts(quantiles.value_counts(df, ["k"], "v"), ["k"], probs).collect()}
    for key in {k for k, _ in rows}:
        vals = np.array([v for k, v in rows if k == key])
        for n, p in probs.items():
            assert got[key][n] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-15)
    stats = {r.k: r for r in quantiles.median_and_mad(df, ["k"], "v").collect()}
    vals = np.array([v for k, v in rows if k == "hot"])
    assert stats["hot"].mad == pytest.approx(float(np.median(np.abs(vals - np.median(vals)))), rel=1e-12)


def knn_brute(pts, k, dist):
    out = {}
    for i, a in pts.items():
        near = sorted((round(dist(a, b), 6), j) for j, b in pts.items() if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("case", ["random", "crowded", "dateline", "few", "mixed"])
def test_knn_equals_brute_force(spark, case):
    rnd = random.Random(7)
    if case == "random":
        pts = {n: (rnd.uniform(-60, 70), rnd.uniform(-170, 170)) for n in range(120)}
    elif case == "crowded":  # a third of all stations at one place
        pts = {n: ((28.6, 77.2) if n % 3 == 0 else (rnd.uniform(28, 29), rnd.uniform(77, 78))) for n in range(150)}
    elif case == "dateline":
        pts = {n: (rnd.uniform(-20, -10), rnd.choice([rnd.uniform(178, 180), rnd.uniform(-180, -178)])) for n in range(60)}
    elif case == "few":
        pts = {n: (rnd.uniform(0, 40), rnd.uniform(0, 40)) for n in range(4)}
    else:
        pts = {n: (rnd.gauss(28.6, 0.05), rnd.gauss(77.2, 0.05)) for n in range(80)} | {200 + n: (rnd.uniform(10, 45), rnd.uniform(60, 95)) for n in range(20)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "station_id bigint, lat double, lon double")
    for metric, dist in (("km", haversine), ("degrees", lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1]))):
        want = knn_brute(pts, 5, dist)
        rows = graph.knn(df, 5, metric=metric).collect()
        got = {i: [r.dst for r in sorted((r for r in rows if r.src == i), key=lambda r: (r.dist, r.dst))] for i in pts}
        assert got == want


def test_knn_edges_are_symmetric(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(n, rnd.uniform(28, 29), rnd.uniform(77, 78)) for n in range(40)], "station_id bigint, lat double, lon double")
    e = {(r.src, r.dst): r.w for r in graph.knn_edges(df, 4).collect()}
    assert all(e[b, a] == w for (a, b), w in e.items()) and all(a != b for a, b in e)


def test_pairs_within_radius_equal_brute_force(spark):
    rnd = random.Random(5)
    pts = {n: (rnd.uniform(60, 75), rnd.uniform(10, 40)) for n in range(150)}
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "station_id bigint, lat double, lon double")
    got = {(r.a, r.b) for r in graph.pairs_within(df, 150.0).collect()}
    assert got == {(a, b) for a in pts for b in pts if a < b and haversine(pts[a], pts[b]) <= 150.0}
    assert graph.wind_edges(df, 150.0, month=6).count() == 0


def make_fires(spark, n=60):
    rnd = random.Random(11)
    rows = [(rnd.uniform(27.8, 29.4), rnd.uniform(76.4, 78.0), rnd.uniform(0, 80), rnd.randrange(0, 600)) for _ in range(n)]
    df = spark.createDataFrame(rows, "lat double, lon double, frp double, m int").withColumn("acq", F.expr("timestampadd(MINUTE, m, timestamp_ntz'2024-01-01 00:00:00')"))
    g = [(i, j, 28.2 + 0.1 * j, 76.8 + 0.1 * i) for i in range(5) for j in range(4)]
    return rows, df, g, spark.createDataFrame(g, "i bigint, j bigint, lat double, lon double")


def test_kernel_and_influence_equal_array_loops(spark):
    rows, df, cells, grid = make_fires(spark)
    hours = range(0, 16)
    wind = spark.createDataFrame([(h, i, j, la, lo, float((h * 40 + i * 17 + j * 5) % 360)) for h in hours for i, j, la, lo in cells if (h, i, j) != (3, 1, 1)],
                                 "h int, i bigint, j bigint, lat double, lon double, wd double").withColumn("hour", F.expr("timestampadd(HOUR, h, timestamp_ntz'2024-01-01 00:00:00')"))
    dens, infl, emis = {}, {}, {}
    for la, lo, frp, m in rows:
        if frp < 10:
            continue
        geo = [((lo2 - lo) * math.cos(math.radians(la)) * 111.13, (la2 - la) * 111.13) for _, _, la2, lo2 in cells]
        kern = [math.exp(-((math.hypot(*g) / 40) ** 2)) for g in geo]
        for (i, j, _, _), g, k in zip(cells, geo, kern):
            dens[i, j] = dens.get((i, j), 0) + k * frp
            for h in hours:
                if 0 <= h * 60 - m < 360:
                    emis[h, i, j] = emis.get((h, i, j), 0) + k / sum(kern) * frp * 0.368 * 3600 * 1000 * 8.5
                    wd = math.radians((h * 40 + i * 17 + j * 5) % 360)
                    down = min(max((g[0] * math.cos(wd) + g[1] * math.sin(wd)) / (math.hypot(*g) + 1), 0), 1)
                    infl[h, i, j] = infl.get((h, i, j), 0) + k * (1 + 1.6 * down) * frp
    got = {(r.i, r.j): r.density for r in fires.fire_density(df, grid).collect()}
    assert got == pytest.approx(dens, rel=1e-9)
    run = wind.select("hour", "h").distinct()
    got = {(r.h, r.i, r.j): r.pm25 for r in fires.kernel_emissions(df, grid, hours=run).join(run, "hour").collect()}
    assert got == pytest.approx(emis, rel=1e-9)
    got = {(r.h, r.i, r.j): r.influence for r in fires.fire_influence(df, wind).join(run, "hour").collect()}
    infl.pop((3, 1, 1), None)
    assert got == pytest.approx(infl, rel=1e-9)


def test_trailing_sums_equal_a_row_window(spark):
    rnd = random.Random(2)
    vals = [rnd.randrange(0, 50) * 1.0 for _ in range(80)]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(vals)], "n int, v double").withColumn("t", F.expr("timestampadd(HOUR, n, timestamp_ntz'2024-01-01 00:00:00')"))
    got = {r.n: (r.s_6h, r.s_48h) for r in series.trailing_sums(df, "t", "v", (6, 48), "s_").collect()}
    assert got == {n: (sum(vals[max(0, n - 5): n + 1]), sum(vals[max(0, n - 47): n + 1])) for n in range(80)}


def test_alert_rules_on_a_literal_series(spark):
    pm = [100, 105, 110, 120, 130, 140, 215]
    rows = [(h, float(p), 310.0, 0.7 if h == 2 else 0.1, 1.0 if h >= 3 else 3.0, 0.5, 0.5) for h, p in enumerate(pm)]
    df = spark.createDataFrame(rows, "t int, pm25 double, aqi double, trapping double, ws double, plume double, fire double")
    out = al.alerts(df, []).collect()
    assert [r.alert_type for r in out] == ["HIGH_PM", "SEVERE_AQI", "INVERSION", "STAGNANT_WIND", "STUBBLE_PLUME", "RAPID_PM_RISE"]
    by = {r.alert_type: r for r in out}
    assert (by["HIGH_PM"].alert_id, by["HIGH_PM"].severity) == ("HIGH_PM-6", "critical") and by["SEVERE_AQI"].alert_id == "SEVERE_AQI-0"
    assert by["STAGNANT_WIND"].idx == 5 and by["STAGNANT_WIND"].data["consecutive_hours"] == 3 and by["RAPID_PM_RISE"].data["delta_6h"] == 115.0
    calm = al.alerts(df.withColumns({"pm25": F.lit(10.0), "aqi": F.lit(10.0), "trapping": F.lit(0.0), "ws": F.lit(5.0), "plume": F.lit(0.0)}), [])
    assert calm.count() == 0


def test_partition_write_is_idempotent(spark):
    base = new_dir(spark, "idem")
    df = spark.createDataFrame([("cpcb", "2024-01-01", "r1", 1), ("cpcb", "2024-01-01", "r2", 2)], "source string, dt string, run_id string, v int")
    writers.write_partition(df, base)
    writers.write_partition(df.filter("run_id = 'r2'").withColumn("v", F.lit(9)), base)
    assert sorted(r.v for r in spark.read.parquet(base).collect()) == [1, 9]


def test_upsert_takes_latest_present_field(spark):
    base = spark.createDataFrame([("gfs", 1, "old", "x")], "source_name string, seq int, status string, license string")
    upd = spark.createDataFrame([("gfs", 2, None, "y"), ("gfs", 3, "new", None)], "source_name string, seq int, status string, license string")
    r = inventory.upsert(base, upd, "source_name", "seq").first()
    assert (r.status, r.license) == ("new", "y")


def test_oversize_file_fails_the_job(spark):
    f = spark.createDataFrame([("a", "s1", 10), ("b", "s2", 99)], "name string, sha256 string, length bigint")
    known = f.filter("name = 'zz'")
    assert inventory.new_files(f, known).count() == 2
    with pytest.raises(Exception, match="size limit"):
        inventory.new_files(f, known, max_bytes=50).collect()


def test_ordered_bits_follow_the_values(spark):
    import struct

    rnd = random.Random(8)
    vals = [0.0, 5e-324, 2.2250738585072014e-308, 1.0, 2.0, math.nextafter(2.0, 0), 1.7976931348623157e308, math.inf, 1e9, 1e9 + 2.0**-23]
    vals += [struct.unpack("<d", struct.pack("<Q", rnd.randrange(0, 2047 << 52)))[0] for _ in range(2000)] + [2.0**e for e in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in vals + [-v for v in vals] + [math.nan]], "v double")
    got = {(r.v, r.c) for r in df.select("v", quantiles.ordered_bits(F.col("v")).alias("c")).collect() if r.v == r.v}
    want = {(v, s * struct.unpack("<Q", struct.pack("<d", abs(v)))[0]) for v in vals for v, s in ((v, 1), (-v, -1))}
    assert got == want
    assert df.filter("isnan(v)").select(quantiles.ordered_bits(F.col("v"))).first()[0] == (2047 << 52) + 1


def test_quantiles_of_a_narrow_range_rank_few_values(spark, monkeypatch):
    n, bound = 1_000_000, 4096
    monkeypatch.setattr(quantiles, "DISTINCT", bound)
    # 10**6 distinct values in [1e9, 1e9 + 1): equal upper bits; and a key that is spread
    df = spark.range(n).select(F.lit("narrow").alias("k"), (F.lit(1e9) + F.pmod(F.col("id") * 7_919, F.lit(n)) / F.lit(float(n))).alias("v"))
    df = df.union(spark.range(1001).select(F.lit("wide"), F.exp(F.col("id") / 100.0)))
    sizes, keep = [], quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda d: sizes.append((x := keep(d)).groupBy("k", "_b").count().agg(F.max("count")).first()[0]) or x)
    vc = quantiles.value_counts(df, ["k"], "v")
    got = {r.k: r for r in quantiles.quantiles_of_counts(vc, ["k"], {"a": 0.25, "b": 0.5, "c": 0.999}).collect()}
    exact = np.sort(1e9 + (np.arange(n) * 7_919 % n) / n)
    wide = np.exp(np.arange(1001) / 100.0)
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.999)):
        assert got["narrow"][name] == pytest.approx(float(np.quantile(exact, p)), rel=1e-15)
        assert got["wide"][name] == pytest.approx(float(np.quantile(wide, p)), rel=1e-12)
    # the first cut leaves them all in one bucket, the next no more than the bound
    assert sizes[0] > 800_000 and sizes[-1] <= bound and len(sizes) <= 3


def test_correlations_by_blocks_equal_pairs(spark):
    rnd = random.Random(4)
    rows = [(s, h, rnd.gauss(1e6, 1) + h * 0.1 * (s % 3 - 1)) for s in range(23) for h in range(60) if rnd.random() < 0.7]
    rows += [(50, h, 3.25) for h in range(60)] + [(51, h, None) for h in range(60)] + [(None, 1, 1.0)]
    df = spark.createDataFrame(rows, "s long, t int, v double")
    held = {}
    for s, h, v in rows:
        if s is not None and v is not None:
            held.setdefault(s, {})[h] = v
    none = spark.createDataFrame([], "src long, dst long, w double")
    want = {}
    for a in held:
        for b in held:
            both = sorted(set(held[a]) & set(held[b]))
            x, y = np.array([held[a][h] for h in both]), np.array([held[b][h] for h in both])
            if a != b and len(both) > 1 and x.std() > 0 and y.std() > 0:
                r = float(np.corrcoef(x, y)[0, 1])
                if r > 0:
                    want[a, b] = min(r, 1.0)
    got = {(r.src, r.dst): r.w for r in graph.corr_edges(df, none, "s", "t", "v").collect()}
    assert got == pytest.approx(want, abs=1e-9)
    small = graph.pair_moments(df, "s", "t", "v", block=4, hours=16)
    one = {frozenset((r.a, r.b)): sorted(round(x, 6) for x in (r.n, r.xx, r.yy, r.xy)) for r in graph.pair_moments(df, "s", "t", "v").collect()}
    many = {frozenset((r.a, r.b)): sorted(round(x, 6) for x in (r.n, r.xx, r.yy, r.xy)) for r in small.collect()}
    assert one == many and len(one) == 24 * 23 // 2
    text = df.withColumn("s", F.concat(F.lit("S"), "s"))
    assert graph.corr_edges(text, spark.createDataFrame([], "src string, dst string, w double"), "s", "t", "v").count() == len(want)


def test_a_hot_hour_is_shared_by_many_tasks(spark, monkeypatch):
    _, df, cells, grid = make_fires(spark, 400)
    wind = grid.select("*", F.lit(40.0).alias("wd"), F.explode(F.sequence(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.expr("timestamp_ntz'2024-01-01 18:00:00'"), F.expr("interval 1 hour"))).alias("hour"))
    ask = lambda: ({(r.hour, r.i, r.j): (r.influence, r.upwind, r.downwind) for r in fires.fire_influence(df, wind).collect()},
                   {(r.i, r.j): r.density for r in fires.fire_density(df, grid).collect()})
    once = ask()
    monkeypatch.setattr(fires, "GROUP_ROWS", 7)
    monkeypatch.setattr(fires, "TERMS", 50)
    salted, salts = fires._shared(df.withColumn("hour", F.lit(1)), ["hour"], 7)
    assert salted.select("_salt").distinct().count() > 30
    again = ask()
    assert again[1] == pytest.approx(once[1], rel=1e-12) and set(again[0]) == set(once[0])
    assert all(again[0][k] == pytest.approx(v, rel=1e-12) for k, v in once[0].items())
    nothing = df.filter("false")
    assert fires.fire_density(nothing, grid).count() == fires.fire_influence(nothing, wind).count() == 0


def test_gated_write_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df, path = spark.range(500).mapInPandas(count, "id long"), new_dir(spark, "gated")
    assert writers.write_gated(df, path, 500) == 500 and seen.value == 500
    with pytest.raises(ValueError, match="CRITICAL: 'stations' has 500"):
        writers.write_gated(df, path, 501, "stations")
    assert writers.write_gated(df.filter("id < 3"), path, 3) == 3 and spark.read.parquet(path).count() == 3


def test_a_fire_meets_the_wind_of_all_its_hours_at_once(spark, monkeypatch):
    rows, df, cells, grid = make_fires(spark, 60)
    wind = grid.select("*", F.explode(F.sequence(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.expr("timestamp_ntz'2024-01-01 18:00:00'"), F.expr("interval 1 hour"))).alias("hour")).withColumn(
        "wd", ((F.hour("hour") * 40 + F.col("i") * 17 + F.col("j") * 5) % 360).cast("double"))
    got = fires.fire_influence(df, wind, angle="met")
    plan = got._jdf.queryExecution().optimizedPlan()
    while "CoGroup" not in plan.nodeName():
        plan = plan.children().head()
    sent = plan.children().head().toString()
    assert "Generate" not in sent and "Aggregate" in sent  # a row per fire, not per fire and hour
    want = {}
    for la, lo, frp, m in rows:
        for i, j, la2, lo2 in cells if frp >= 10 else []:
            x, y = (lo2 - lo) * math.cos(math.radians(la)) * 111.13, (la2 - la) * 111.13
            for h in (h for h in range(19) if 0 <= h * 60 - m < 360):
                to = math.radians(270 - (h * 40 + i * 17 + j * 5) % 360)
                a = (x * math.cos(to) + y * math.sin(to)) / (math.hypot(x, y) + 1)
                old = want.get((h, i, j), (0, 0, 0))
                new = (math.exp(-(x * x + y * y) / 1600) * (1 + 1.6 * max(a, 0)), max(-a, 0), max(a, 0))
                want[h, i, j] = tuple(o + frp * n for o, n in zip(old, new))
    for size in ((8192, 8), (7, 2)):
        monkeypatch.setattr(fires, "FIRES", size[0])
        monkeypatch.setattr(fires, "HOURS", size[1])
        found = {(r.hour.hour, r.i, r.j): (r.influence, r.upwind, r.downwind) for r in got.collect()}
        assert set(found) == set(want) and all(found[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())
    pieces = np.random.default_rng(3).uniform(0, 1, (6, 23))
    whole = fires._influence(*pieces[:3], pieces[3], pieces[4], pieces[5] * 6)
    monkeypatch.setattr(fires, "FIRES", 10 ** 6)
    assert np.allclose(fires._influence(*pieces[:3], pieces[3], pieces[4], pieces[5] * 6), whole, rtol=1e-12)


def test_crowded_places_are_paired_by_their_lists(spark, monkeypatch):
    rnd = random.Random(11)
    spots = [(28.0 + rnd.random(), 77.0 + rnd.random()) for _ in range(9)] + [(10.0, 179.99)]
    rows = [(n, *rnd.choice(spots)) for n in range(90)] + [(n, *spots[0]) for n in (3, 3, 200)] + [(None, *spots[1]), (300, None, 77.0), (301, 28.0, None)]
    df = spark.createDataFrame(rows, "station_id long, lat double, lon double")
    held = [r for r in rows if None not in r]
    want = sorted((a[0], b[0]) for a in held for b in held if a[0] < b[0] and round(haversine(a[1:], b[1:]), 6) <= 40)
    edges = {}
    for a in held:
        for b in held:
            if a[0] < b[0] and round(haversine(a[1:], b[1:]), 6) <= 40:
                (la, lo), (lb, lp) = (map(math.radians, x[1:]) for x in (a, b))
                to = math.degrees(math.atan2(math.sin(lp - lo) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(lp - lo))) % 360
                for k in ((a[0], b[0]), (b[0], a[0])):
                    edges.setdefault(k, []).append(abs(math.cos(math.radians(to - 300))))
    for ids, cell in ((128, 256), (2, 3)):
        monkeypatch.setattr(graph, "PLACE_IDS", ids)
        monkeypatch.setattr(graph, "CELL_STATIONS", cell)
        assert sorted((r.a, r.b) for r in graph.pairs_within(df, 40.0).collect()) == want
        got = {}
        for r in graph.wind_edges(df, 40.0).collect():
            got.setdefault((r.src, r.dst), []).append(r.w)
        assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(sorted(v), abs=1e-9) for k, v in edges.items()}
    # one place with all stations: its pairs come from more than one task
    one = spark.createDataFrame([(n, 28.0, 77.0) for n in range(600)], "station_id long, lat double, lon double").coalesce(1)
    made = graph.wind_edges(one, 1.0).groupBy(F.spark_partition_id()).count().collect()
    assert len(made) > 1 and sum(r["count"] for r in made) == 600 * 599


def test_smoothing_sums_once_for_stations_with_the_same_neighbours(spark):
    rnd = random.Random(4)
    rows = [(n, 28.0 + n % 3 * 0.1, 77.0 + n % 3 * 0.2) for n in range(60)]
    df = spark.createDataFrame(rows + rows[20:23] + [(7, 28.05, 77.3), (None, 28.0, 77.0)], "station_id long, lat double, lon double")
    hours, vals = range(30), {}
    for h in hours:
        for s in range(12):
            if rnd.random() < 0.8:
                vals[h, s] = rnd.random() * 90
    values = spark.createDataFrame([(h, s, v) for (h, s), v in vals.items()], "t long, station_id long, v double")
    got = graph.neighbour_smooth(values, df, "t", "v")
    near = {}
    for r in graph.knn(df, 6, metric="degrees").collect():
        near.setdefault(r.src, []).append((r.dst, 1 / (r.dist + 0.01)))
    want = {}
    for s, e in near.items():
        for h in hours:
            if any((h, d) in vals for d, _ in e):
                want[h, s] = sum(w * vals[h, d] for d, w in e if (h, d) in vals) / sum(w for _, w in e)
    assert {(r.t, r.station_id): r.smoothed for r in got.collect()} == pytest.approx(want, rel=1e-9)
    # sums are held per list of neighbours: 3 places, and a list for each of the few stations that others name
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert "Join" in plan[:plan.index(top)] and "_l#" in top
