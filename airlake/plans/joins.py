"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import features, graph, joins, metrics, regrid, series, splits
from airlake.plans.registry import query
from airlake.plans.scalars import bearing_sql, hav_sql
from airlake.plans.windows import SPLIT_SQL, STATION_SQL, _rt, rsql, split_frame, station_field

G = joins.GridSpec(20, 22)


@query("registry_join", "stn", """with a as (select s_suppkey as k, case when s_suppkey%3=0 then concat('  ', upper(s_name), ' ') when s_suppkey%3=1 then lower(s_name) else concat(s_name,'x') end as location from supplier)
    select k, station_id, name, true as kept from a join stn on lower(trim(location)) = lower(trim(name))""")
def registry_join(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_name")
    loc = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper(n), F.lit(" "))).when(k % 3 == 1, F.lower(n)).otherwise(F.concat(n, F.lit("x")))
    d = fx.table(spark, sf, "supplier").select(k.alias("k"), loc.alias("location"))
    st = fx.stn(spark, sf)
    inside = joins.registry_join(d, st, "location", membership_only=True).select("k", F.lit(True).alias("kept"))
    return joins.registry_join(d, st, "location").select("k", "station_id", "name").join(inside, "k")


@query("token_match_join", "rec stn", """with rt as (select rec_id, concat(' ', array_to_string(regexp_extract_all(lower(station_text), '[a-z0-9]+'), ' '), ' ') as r from rec),
    st as (select station_id, regexp_extract_all(lower(name), '[a-z0-9]+') as tk from stn)
    select rec_id, station_id from (select rec_id, station_id, row_number() over (partition by rec_id order by len(tk) desc, station_id) rn
      from rt join st on regexp_matches(r, concat(' ', array_to_string(tk, ' (.* )?'), ' '))) x where rn=1""")
def token_match_join(spark, sf):
    return joins.match_stations(fx.rec(spark, sf), fx.stn(spark, sf), "station_text").select("rec_id", "station_id")


FIRE_HOURS = """fh as (select acq_h, count(*) as n, sum(frp) as total, avg(frp) as mean, max(frp) as mx,
      count(*) filter (where up) as upn, coalesce(sum(frp) filter (where up),0) as upf, coalesce(sum(frp) filter (where dist<=50),0) as cl, min(dist) as md
    from (select *, case when wd is null then br between 270 and 360 else abs(((br-wd+180+720)%360)-180)<=90 end as up from
      (select f.*, {dist} as dist, {br} as br, w.wd from fire f left join hw w on w.h=f.acq_h where lat between 27.5 and 33 and lon between 73.5 and 78.8
        and frp between 0 and 5000 and (confidence='nominal' or cast(confidence as int) >= 20)) q) z group by acq_h),
    hf as (select timestamp '2024-01-01 00:00:00' + to_hours(hh.h) as t, coalesce(n,0) as fire_count, coalesce(total,0) as total_frp, coalesce(mean,0) as mean_frp, coalesce(mx,0) as max_frp,
      coalesce(upn,0) as upwind_fire_count, coalesce(upf,0) as upwind_frp, coalesce(cl,0) as close_frp_50km, md as min_distance_km
    from (select unnest(range(0,(select max(acq_h)+1 from fire))) as h) hh left join fh on fh.acq_h=hh.h)"""
FIRE_HOURS = FIRE_HOURS.replace("{dist}", hav_sql("lat", "lon", "28.6139e0", "77.2090e0")).replace("{br}", bearing_sql("lat", "lon", "28.6139e0", "77.2090e0"))
FIRE_HOURS = "hw as (select h, (h*7)%360 + 0.25e0 as wd from (select unnest(range(0,(select max(acq_h)+1 from fire))) as h) q where h%5<>0), " + FIRE_HOURS
ROLLS = ", ".join(f"sum(total_frp) over (order by t rows between {h - 1} preceding and current row) as frp_{h}h" for h in (6, 12, 24, 48))


def fire_hour_features(spark, sf):
    from airlake.operators.fires import hourly_fire_features

    base = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    f = fx.fire(spark, sf)
    top = base + F.make_dt_interval(F.lit(0), F.col("last").cast("int"))
    hours = f.agg(F.max("acq_h").alias("last")).select(F.explode(F.sequence(base, top, F.expr("interval 1 hour"))).alias("t"))
    h = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', t)")
    wind = hours.filter(h % 5 != 0).select("t", ((h * 7) % 360 + F.lit(0.25)).alias("wd"))
    clean = f.filter("frp between 0 and 5000 and (confidence = 'nominal' or try_cast(confidence as int) >= 20)").withColumn(
        "t", F.expr("timestampadd(HOUR, cast(acq_h as int), timestamp_ntz'2024-01-01 00:00:00')"))
    return hourly_fire_features(clean, hours, wind)


FIRE_COLS = ["fire_count", "total_frp", "mean_frp", "max_frp", "upwind_frp", "close_frp_50km", "frp_6h", "frp_12h", "frp_24h", "frp_48h", "min_distance_km"]


@query("fire_feature_join", "fire ch", f"with {FIRE_HOURS}, rolled as (select *, {ROLLS} from hf) select city, ch.t, coalesce(fire_count,0) as fire_count, "
       + ", ".join(f"round(coalesce({c},0),3) as {c}" for c in FIRE_COLS[1:]) + " from ch left join rolled on rolled.t=ch.t")
def fire_feature_join(spark, sf):
    d = features.add_fire_features(fx.ch(spark, sf).select("city", "t"), fire_hour_features(spark, sf), "t", FIRE_COLS)
    return d.select("city", "t", "fire_count", *[F.round(c, 3).alias(c) for c in FIRE_COLS[1:]])


@query("timeline_reindex", "ch", f"""with h as (select city, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from ch group by city)
    select h.city, h.t, {rsql('pm25')} as pm25 from h left join ch on h.city=ch.city and h.t=ch.t""")
def timeline_reindex(spark, sf):
    return series.timeline_reindex(fx.ch(spark, sf).select("city", "t", "pm25"), ["city"], "t").select("city", "t", _rt("pm25").alias("pm25"))


@query("nearest_cell", "fire", """with a as (select *, cast(least(greatest(round_even((lon-76.8e0)/(77.6e0-76.8e0)*19,0),0),19) as bigint) as i, cast(least(greatest(round_even((lat-28.2e0)/(29.0e0-28.2e0)*21,0),0),21) as bigint) as j,
    lat between 28.2 and 29.0 and lon between 76.8 and 77.6 as inside from fire) select ok, ln, i, j, case when inside then i end as strict_i, case when inside then j end as strict_j from a""")
def nearest_cell(spark, sf):
    d = joins.assign_cell(fx.fire(spark, sf), G)
    si, sj = joins.cell_index(F.col("lat"), F.col("lon"), G, "strict")
    return d.select("ok", "ln", "i", "j", si.alias("strict_i"), sj.alias("strict_j"))


@query("sample_grid_at_stations", "stn field", f"with {STATION_SQL} select * from sf")
def sample_grid_at_stations(spark, sf):
    return station_field(spark, sf)


_COARSE = "src as (select hour_idx, lat, lon, pm25, ws from field where i%6=0 and j%7=0)"


def coarse(spark, sf):
    return fx.field(spark, sf).filter("i % 6 = 0 and j % 7 = 0").select("hour_idx", "lat", "lon", "pm25", "ws")


@query("regrid_nearest", "field grid", f"""with {_COARSE}, la as (select t, s from (select g.lat as t, s.lat as s, row_number() over (partition by g.lat order by abs(s.lat-g.lat), s.lat) rn from (select distinct lat from grid) g, (select distinct lat from src) s) x where rn=1),
    lo as (select t, s from (select g.lon as t, s.lon as s, row_number() over (partition by g.lon order by abs(s.lon-g.lon), s.lon) rn from (select distinct lon from grid) g, (select distinct lon from src) s) x where rn=1)
    select hour_idx, g.i, g.j, src.pm25 from grid g join la on la.t=g.lat join lo on lo.t=g.lon join src on src.lat=la.s and src.lon=lo.s""")
def regrid_nearest(spark, sf):
    return regrid.regrid_nearest(coarse(spark, sf), fx.grid(spark, sf), ["pm25"], ["hour_idx"], ["i", "j"])


@query("regrid_bilinear", "field grid", f"""with {_COARSE},
    xa as (select lat, lead(lat) over (order by lat) as nx, row_number() over (order by lat) as r, count(*) over () as n from (select distinct lat from src) q),
    xo as (select lon, lead(lon) over (order by lon) as nx, row_number() over (order by lon) as r, count(*) over () as n from (select distinct lon from src) q),
    ta as (select g.t, a.lat as s0, a.nx as s1, (c-a.lat)/greatest(a.nx-a.lat,1e-12) as f from (select distinct lat as t, least(greatest(lat,(select min(lat) from src)),(select max(lat) from src)) as c from grid) g join xa a on a.nx is not null and c >= a.lat and (c < a.nx or a.r=a.n-1)),
    tb as (select g.t, a.lon as s0, a.nx as s1, (c-a.lon)/greatest(a.nx-a.lon,1e-12) as f from (select distinct lon as t, least(greatest(lon,(select min(lon) from src)),(select max(lon) from src)) as c from grid) g join xo a on a.nx is not null and c >= a.lon and (c < a.nx or a.r=a.n-1))
    select a.hour_idx, g.i, g.j, {rsql('a.pm25*(1-ta.f)*(1-tb.f)+b.pm25*ta.f*(1-tb.f)+c.pm25*(1-ta.f)*tb.f+d.pm25*ta.f*tb.f')} as pm25 from grid g join ta on ta.t=g.lat join tb on tb.t=g.lon
      join src a on a.lat=ta.s0 and a.lon=tb.s0 join src b on b.lat=ta.s1 and b.lon=tb.s0 and b.hour_idx=a.hour_idx join src c on c.lat=ta.s0 and c.lon=tb.s1 and c.hour_idx=a.hour_idx join src d on d.lat=ta.s1 and d.lon=tb.s1 and d.hour_idx=a.hour_idx""")
def regrid_bilinear(spark, sf):
    return regrid.regrid_bilinear(coarse(spark, sf), fx.grid(spark, sf), ["pm25"], ["hour_idx"], ["i", "j"]).select("hour_idx", "i", "j", _rt("pm25").alias("pm25"))


POINTS = [("centre", 28.6139, 77.2090), ("node", 28.2, 76.8), ("far", 30.0, 76.0)]


@query("idw_to_point", "field", f"""with p as (select * from (values {', '.join(f"('{n}', {a}::double, {o}::double)" for n, a, o in POINTS)}) v(point, pa, po)),
    d as (select hour_idx, point, pm25, greatest(sqrt(power(lat-pa,2)+power(lon-po,2)),1e-6) as g from field, p)
    select hour_idx, point, {rsql('sum(pm25/(g*g))/sum(1/(g*g))')} as value from d group by 1,2""")
def idw_to_point(spark, sf):
    return joins.idw_to_points(fx.field(spark, sf), POINTS, "pm25", keys=["hour_idx"]).select("hour_idx", "point", _rt("value").alias("value"))


@query("fire_active_hours", "fire_t", """with h as (select timestamp '2024-01-01 00:00:00' + to_hours(unnest(range(0,760))) as hour)
    select fire_id, hour, 'short' as kind from fire_t join h on hour >= acq and hour < acq + interval 6 hour
    union all select fire_id, hour, 'day' from fire_t join h on hour >= acq and hour < acq + interval 24 hour """)
def fire_active_hours(spark, sf):
    f = fx.fire_t(spark, sf).select("fire_id", "acq")
    a = joins.active_hours(f, "acq", 6.0).select("fire_id", "hour", F.lit("short").alias("kind"))
    return a.unionByName(joins.active_hours(f, "acq", 24.0).select("fire_id", "hour", F.lit("day").alias("kind")))


_PAIR = "pr as (select a.station_id as a, b.station_id as b, a.lat as la, a.lon as lo, b.lat as lb, b.lon as lp, round({d},6) as dist from stn a join stn b on a.station_id<>b.station_id)"
_KM = _PAIR.replace("{d}", hav_sql("a.lat", "a.lon", "b.lat", "b.lon", 6371.0088))
_DEG = _PAIR.replace("{d}", "sqrt(power(a.lat-b.lat,2)+power(a.lon-b.lon,2))")
KNN_SQL = f"{_KM}, nn as (select a, b, dist from (select *, row_number() over (partition by a order by dist, b) rn from pr) q where rn<=6), kn as (select src, dst, count(*)::double as w from (select a as src, b as dst from nn union all select b, a from nn) u group by 1,2)"


@query("knn_edges", "stn", f"with {KNN_SQL} select * from kn")
def knn_edges(spark, sf):
    return graph.knn_edges(fx.stn(spark, sf), 6)


@query("wind_edges", "stn", f"with {_KM}, e as (select a, b, abs(cos(radians({bearing_sql('la', 'lo', 'lb', 'lp')} - 300))) as w from pr where a<b and dist<=20) select a as src, b as dst, round(w,6) as w from e union all select b, a, round(w,6) from e")
def wind_edges(spark, sf):
    return graph.wind_edges(fx.stn(spark, sf), 20.0).select("src", "dst", F.round("w", 6).alias("w"))


@query("neighbour_smooth", "stn obs", f"""with {_DEG}, nn as (select a, b, 1/(dist+0.01e0) as w from (select *, row_number() over (partition by a order by dist, b) rn from pr) q where rn<=6),
    e as (select a, b, w/greatest(sum(w) over (partition by a),1e-9) as w from nn), v as (select station_id, date_trunc('hour', observed_at_utc) as t, avg(value) as v from obs group by 1,2)
    select v.t, e.a as station_id, {rsql('sum(e.w*v.v)')} as smoothed from v join e on e.b=v.station_id group by 1,2""")
def neighbour_smooth(spark, sf):
    v = fx.obs(spark, sf).select("station_id", F.date_trunc("hour", "observed_at_utc").cast("timestamp_ntz").alias("t"), "value").groupBy("station_id", "t").agg(F.avg("value").alias("v"))
    return graph.neighbour_smooth(v, fx.stn(spark, sf), "t", "v").select("t", "station_id", _rt("smoothed").alias("smoothed"))


@query("episode_join", "fc chx", f"""select f.city, f.t, 'inversion' as regime, {rsql('f.yobs')} as yobs from fc f where exists (select 1 from chx c where c.city=f.city and c.t=f.t and c.inv>0)
    union all select f.city, f.t, 'high_aod', {rsql('f.yobs')} from fc f where exists (select 1 from chx c where c.city=f.city and c.t=f.t and c.aod>0.6)""")
def episode_join(spark, sf):
    f, c = fx.fc(spark, sf), fx.chx(spark, sf)
    one = lambda r: metrics.episode(f, c, r, ["city", "t"]).select("city", "t", F.lit(r).alias("regime"), _rt("yobs").alias("yobs"))
    return one("inversion").unionByName(one("high_aod"))


@query("run_compare", "field", """with a as (select hour_idx, avg(pm25) as x from field group by 1), b as (select hour_idx, avg(pm25*0.97e0+ws*0.1e0) as y from field where hour_idx<>7 group by 1)
    select round(avg(x),5) as coupled_mean, round(avg(y),5) as uncoupled_mean, count(*) as n_leads, round((avg(x)/greatest(avg(y),1e-9)-1)*100,4) as delta_pct from a join b using (hour_idx)""")
def run_compare(spark, sf):
    f = fx.field(spark, sf)
    on = f.groupBy("hour_idx").agg(F.avg("pm25").alias("v"))
    off = f.filter("hour_idx <> 7").groupBy("hour_idx").agg(F.avg(F.col("pm25") * F.lit(0.97) + F.col("ws") * F.lit(0.1)).alias("v"))
    return joins.run_compare(on, off, "hour_idx", "v").select(F.round("coupled_mean", 5).alias("coupled_mean"), F.round("uncoupled_mean", 5).alias("uncoupled_mean"), "n_leads", F.round("delta_pct", 4).alias("delta_pct"))


CLIM_SQL = f"""{SPLIT_SQL}, cl as (select city, cast(hour(t) as integer) as hour, cast(least((dayofyear(t)-1)//30,11) as integer) as bucket, avg(pm25) as clim from sp where split='train' group by 1,2,3)"""


@query("climatology_lookup", "chx", f"""with {CLIM_SQL}, cm as (select city, avg(pm25) as m from sp where split='train' group by 1)
    select s.city, s.t, {rsql('coalesce(cl.clim, cm.m)')} as yhat from sp s left join cl on cl.city=s.city and cl.hour=hour(s.t) and cl.bucket=least((dayofyear(s.t)-1)//30,11) left join cm on cm.city=s.city where s.split='test'""")
def climatology_lookup(spark, sf):
    d = split_frame(spark, sf)
    return splits.climatology_forecast(d.filter("split = 'train'"), d.filter("split = 'test'"), "city", "t", "pm25").select("city", "t", _rt("yhat").alias("yhat"))


@query("nearest_lead", "field", """with r as (select unnest([0, 5, 30]) as request), m as (select hour_idx*3 as lead, avg(pm25) as pm25 from field group by 1)
    select request, lead, round(pm25,6) as pm25 from (select r.request, m.*, row_number() over (partition by r.request order by abs(m.lead-r.request), m.lead) rn from r, m) x where rn=1""")
def nearest_lead(spark, sf):
    m = fx.field(spark, sf).groupBy((F.col("hour_idx") * 3).alias("lead")).agg(F.round(F.avg("pm25"), 6).alias("pm25"))
    return series.nearest_lead(m, "lead", [0, 5, 30], ["pm25"])


def city_stations(spark, sf):
    return features.station_registry(fx.chx(spark, sf), "city", "t").select(F.col("city").alias("station_id"), "lat", "lon")


@query("corr_edges", "chx", f"""with stn as (select city as station_id, min(lat) as lat, min(lon) as lon from chx group by city), {KNN_SQL.replace('rn<=6', 'rn<=3')},
    s as (select city, t, temp + coalesce(pm25,0)/10 as v from chx), c as (select a.city as src, b.city as dst, covar_pop(a.v,b.v)/nullif(sqrt(var_pop(a.v)*var_pop(b.v)),0) as r from s a join s b on a.t=b.t and a.city<>b.city group by 1,2)
    select src, dst, round(w,6) as w from (select coalesce(kn.src,c.src) as src, coalesce(kn.dst,c.dst) as dst, greatest(coalesce(kn.w,0), least(greatest(coalesce(c.r,0),0),1)) as w from kn full join c on kn.src=c.src and kn.dst=c.dst) x where w>0""")
def corr_edges(spark, sf):
    s = fx.chx(spark, sf).select("city", "t", (F.col("temp") + F.coalesce("pm25", F.lit(0.0)) / 10).alias("v"))
    e = graph.knn_edges(city_stations(spark, sf), 3)
    return graph.corr_edges(s, e, "city", "t", "v").select("src", "dst", F.round("w", 6).alias("w"))
