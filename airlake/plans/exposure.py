"""Fire exposure on the grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.functions.physics import EMISSION_FACTORS
from airlake.operators import fires
from airlake.plans.registry import query
from airlake.plans.windows import _rt, rsql

KM = "sqrt(power((g.lat-f.lat)*111.13e0,2)+power((g.lon-f.lon)*cos(radians(f.lat))*111.13e0,2))"


@query("fire_density", "fire grid", f"select g.i, g.j, {rsql(f'sum(f.frp*exp(-power({KM}/40,2)))', 3)} as density from (select lat, lon, sum(frp) as frp from fire where frp>=10 group by 1,2) f cross join grid g group by 1,2")
def fire_density(spark, sf):
    return fires.fire_density(fx.fire(spark, sf), fx.grid(spark, sf)).select("i", "j", _rt("density", 3).alias("density"))


def wind_field(spark, sf):
    """Wind direction for every cell and hour from the first to the last active hour."""
    span = fx.fire_t(spark, sf).agg(F.max("acq").alias("b")).select(F.explode(F.sequence(
        F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.date_trunc("hour", F.col("b")).cast("timestamp_ntz") + F.expr("interval 6 hour"), F.expr("interval 1 hour"))).alias("hour"))
    h = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', hour)")
    hours = span.select("hour", h.alias("h"))
    g = fx.grid(spark, sf).agg(F.collect_list(F.struct("i", "j", "lat", "lon")).alias("c")).scalar()
    return hours.withColumn("e", F.explode(g)).select("hour", "e.*", ((F.col("h") * 15 + F.col("e.i") * 11 + F.col("e.j") * 3) % 360 + F.lit(0.5)).alias("wd"))


ACTIVE = """fa as (select lat, lon, hour, sum(frp) as frp from (select f.lat, f.lon, f.frp, unnest([date_trunc('hour', acq) + case when date_trunc('hour', acq)=acq then interval 0 hour else interval 1 hour end + to_hours(k) for k in range(0,6)]) as hour
    from fire_t f where frp>=10) q group by 1,2,3)"""


@query("fire_influence", "fire_t grid", f"""with {ACTIVE}, fk as (select *, cos(radians(lat))*111.13e0 as kx from fa),
    wv as (select hour, i, j, lat, lon, cos(radians(wd)) as e, sin(radians(wd)) as n from (select h.hour, g.*, (datediff('hour', timestamp '2024-01-01 00:00:00', h.hour)*15+g.i*11+g.j*3)%360+0.5e0 as wd from (select distinct hour from fa) h cross join grid g) q),
    x as (select f.hour, w.i, w.j, f.frp, (w.lon-f.lon)*f.kx as ex, (w.lat-f.lat)*111.13e0 as ny, w.e, w.n from fk f join wv w on w.hour=f.hour),
    y as (select hour, i, j, frp, ex*ex+ny*ny as d2, (ex*e+ny*n)/(sqrt(ex*ex+ny*ny)+1) as a from x),
    z as materialized (select hour, i, j, sum(exp(-d2/1600)*(1+1.6e0*greatest(a,0))*frp) as a, sum(greatest(-a,0)*frp) as b, sum(greatest(a,0)*frp) as c from y group by 1,2,3)
    select hour, i, j, round(a/(select max(a) from z),6) as influence, round(b/(select max(b) from z),6) as upwind, round(c/(select max(c) from z),6) as downwind from z""")
def fire_influence(spark, sf):
    cols = ["influence", "upwind", "downwind"]
    d = fires.normalise_by_max(fires.fire_influence(fx.fire_t(spark, sf), wind_field(spark, sf)), cols)
    return d.select("hour", "i", "j", *[F.round(c, 6).alias(c) for c in cols])


@query("kernel_emissions", "fire_t grid", f"""with fp as (select date_trunc('hour', acq) + case when date_trunc('hour', acq)=acq then interval 0 hour else interval 1 hour end as h0, lat, lon, sum(frp) as frp from fire_t where frp>=10 group by 1,2,3),
    pl as (select distinct lat, lon from fp), ks as (select f.lat, f.lon, sum(exp(-power({KM}/40,2))) as tot from pl f cross join grid g group by 1,2),
    kk as (select f.h0, g.i, g.j, f.frp*exp(-power({KM}/40,2)) / ks.tot as s from fp f join ks on ks.lat=f.lat and ks.lon=f.lon cross join grid g),
    per as (select h0, i, j, sum(s) as s from kk group by 1,2,3), sp as (select i, j, s, unnest([h0 + to_hours(k) for k in range(0,6)]) as hour from per), tot as (select hour, i, j, sum(s) as s from sp group by 1,2,3)
    select hour, i, j, {', '.join(f"round(s*0.368e0*3600*1000*{EMISSION_FACTORS[k]}/1e6,3) as {k}" for k in ('pm25', 'co', 'bc'))} from tot""")
def kernel_emissions(spark, sf):
    d = fires.kernel_emissions(fx.fire_t(spark, sf), fx.grid(spark, sf))
    return d.select("hour", "i", "j", *[F.round(F.col(k) / F.lit(1e6), 3).alias(k) for k in ("pm25", "co", "bc")])


@query("cell_hour_emissions", "fire_t", """with fc2 as (select *, cast(round_even((lon-76.8e0)/(77.6e0-76.8e0)*19,0) as bigint) as i, cast(round_even((lat-28.2e0)/(29.0e0-28.2e0)*21,0) as bigint) as j, 0.25e0+0.5e0*(acq_h%3)/2 as fr
      from fire_t where frp>=10 and lat between 28.2 and 29.0 and lon between 76.8 and 77.6),
    x as (select i, j, frp, fr, unnest([date_trunc('hour', acq) + case when date_trunc('hour', acq)=acq then interval 0 hour else interval 1 hour end + to_hours(k) for k in range(0,6)]) as hour from fc2)
    select hour, i, j, round(sum(frp*0.009e0*3600*fr)*1.000000001e0,3) as surface_gph, round(sum(frp*0.009e0*3600*(1-fr))*1.000000001e0,3) as elevated_gph from x group by 1,2,3""")
def cell_hour_emissions(spark, sf):
    from airlake.operators.joins import GridSpec, assign_cell

    f = assign_cell(fx.fire_t(spark, sf), GridSpec(20, 22), mode="strict").withColumn("surface_fraction", F.lit(0.25) + F.lit(0.5) * (F.col("acq_h") % 3) / 2)
    d = fires.cell_hour_emissions(f)
    return d.select("hour", "i", "j", _rt("surface_gph", 3).alias("surface_gph"), _rt("elevated_gph", 3).alias("elevated_gph"))
