"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import aggregates as ag, features, fires, graph, metrics, series, splits
from airlake.plans.joins import CLIM_SQL, FIRE_COLS, FIRE_HOURS, KNN_SQL, ROLLS, fire_hour_features
from airlake.plans.registry import query
from airlake.plans.scalars import INV_SQL, INV_SRC, inversion_frame
from airlake.plans.windows import SPLIT_SQL, _rt, rsql, split_frame

R = F.round


@query("resample_hourly", "obs", f"""with a as (select station_id, date_trunc('hour', observed_at_utc) as t, avg(value) as value, max(value) as peak_value, min(seq) as first_seq from obs group by 1,2),
    h as (select station_id, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from a group by station_id)
    select h.station_id, h.t, {rsql('value')} as value, peak_value, first_seq from h left join a on a.station_id=h.station_id and a.t=h.t""")
def resample_hourly(spark, sf):
    d = fx.obs(spark, sf).select("station_id", F.col("observed_at_utc").alias("t"), "value", F.col("value").alias("peak_value"), F.col("seq").alias("first_seq"))
    return series.resample(d, ["station_id"], "t", {"first_seq": "min"}).select("station_id", "t", _rt("value").alias("value"), "peak_value", "first_seq")


@query("hourly_fire_features", "fire", f"with {FIRE_HOURS} select t, fire_count, upwind_fire_count, "
       + ", ".join(f"round({c},3) as {c}" for c in FIRE_COLS[1:]) + f" from (select *, {ROLLS} from hf) q")
def hourly_fire_features(spark, sf):
    return fire_hour_features(spark, sf).select("t", "fire_count", "upwind_fire_count", *[R(c, 3).alias(c) for c in FIRE_COLS[1:]])


@query("station_registry_agg", "chx", "select city, round(arg_min(lat,t),6) as lat, round(arg_min(lon,t),6) as lon, arg_min(state,t) as state, count(t) as n_hours from chx group by city")
def station_registry_agg(spark, sf):
    return features.station_registry(fx.chx(spark, sf), "city", "t").select("city", R("lat", 6).alias("lat"), R("lon", 6).alias("lon"), "state", "n_hours")


@query("climatology", "chx", f"with {CLIM_SQL} select city, hour, bucket, {rsql('clim')} as clim from cl")
def climatology(spark, sf):
    return splits.climatology(split_frame(spark, sf).filter("split = 'train'"), "city", "t", "pm25").select("city", "hour", "bucket", _rt("clim").alias("clim"))


@query("standardize", "chx", f"""with {SPLIT_SQL}, m as (select avg(pm25) as m1, stddev_pop(pm25)+1e-6 as s1, avg(temp) as m2, stddev_pop(temp)+1e-6 as s2 from sp where split='train')
    select city, t, split, round((pm25-m1)/s1,6) as pm25_z, round((temp-m2)/s2,6) as temp_z from sp, m""")
def standardize(spark, sf):
    d = split_frame(spark, sf).select("city", "t", "split", F.col("pm25").alias("pm25_z"), F.col("temp").alias("temp_z"))
    z = splits.standardize(d, ["pm25_z", "temp_z"], F.col("split") == "train")
    return z.select("city", "t", "split", R("pm25_z", 6).alias("pm25_z"), R("temp_z", 6).alias("temp_z"))


@query("origin_slope", "chx", """with a as (select pm25*(1+0.12e0*least(greatest((rh*3-40)/60,0),1)) as x, aod/100 as y from chx where pm25>1 and rh is not null and aod is not null)
    select round(case when count(*)<10 then 0.00023e0 else least(greatest(sum(x*y)/sum(x*x),1e-6),3e-3) end,9) as k from a""")
def origin_slope(spark, sf):
    d = fx.chx(spark, sf).select("pm25", (F.col("rh") * 3).alias("rh"), (F.col("aod") / 100).alias("aod"))
    return features.origin_slope(d).select(R("k", 9).alias("k"))


SIGNALS_SQL = """sg as (select count(*) filter (where inv>0) as inversion_hours, count(*) filter (where crop>0) as biomass_season_hours, count(*) filter (where stag>0) as stagnation_hours,
    round(avg(aod),3) as mean_aod from chx where t >= (select max(t) from chx) - interval 72 hour)"""


@query("regime_signals", "chx", f"with {SIGNALS_SQL} select * from sg")
def regime_signals(spark, sf):
    return features.regime_signals(fx.chx(spark, sf), "t")


NCR = "lat between 28.4 and 29.1 and lon between 76.7 and 77.5"


@query("fires_summary", "fire_t", f"select count(*) as n_detections, round(coalesce(sum(frp),0),1) as frp_sum_mw, max(acq) as last_detection_at from fire_t where {NCR}")
def fires_summary(spark, sf):
    return ag.fires_summary(fx.fire_t(spark, sf), "lat", "lon", "frp", "acq")


@query("field_stats", "field", """with s as (select hour_idx, avg(pm25) as pm25_mean, min(pm25) as pm25_min, max(pm25) as pm25_max, avg(ws) as ws_mean, min(ws) as ws_min, max(ws) as ws_max from field group by 1)
    select hour_idx, round(pm25_mean,6) as pm25_mean, pm25_min, pm25_max, round(ws_mean,6) as ws_mean, ws_min, ws_max, (select min(pm25) from field) as pm25_lo, (select max(pm25) from field) as pm25_hi,
    round((select max(pm25_mean) from s),6) as pm25_peak_mean from s""")
def field_stats(spark, sf):
    s = ag.field_stats(fx.field(spark, sf), "hour_idx", ["pm25", "ws"])
    g = ag.field_range(s, ["pm25"]).select(F.struct("*").alias("g")).scalar()
    return s.withColumn("g", g).select("hour_idx", R("pm25_mean", 6).alias("pm25_mean"), "pm25_min", "pm25_max", R("ws_mean", 6).alias("ws_mean"), "ws_min", "ws_max",
                                       "g.pm25_lo", "g.pm25_hi", R("g.pm25_peak_mean", 6).alias("pm25_peak_mean"))


def m_sql(sign: str = "yobs-yhat") -> str:
    return f"""count(*) as n, {rsql(f'avg({sign})')} as bias, {rsql('avg(abs(yobs-yhat))')} as mae, {rsql('sqrt(avg(power(yobs-yhat,2)))')} as rmse,
    {rsql('1-sum(power(yobs-yhat,2))/nullif(var_pop(yobs)*count(*),0)')} as r2, {rsql('avg(abs(yobs-yhat)/yobs) filter (where yobs>0.01)')} as mape,
    {rsql('covar_pop(yobs,yhat)/nullif(sqrt(var_pop(yobs)*var_pop(yhat)),0)')} as correlation"""


METRIC_NAMES = ["bias", "mae", "rmse", "r2", "mape", "correlation"]


def _rm(d, keys, extra=()):
    return d.select(*keys, "n", *[_rt(c).alias(c) for c in METRIC_NAMES], *extra)


@query("error_metrics", "fc", f"select 'obs_minus_pred' as sign, {m_sql()} from fc union all select 'pred_minus_obs', {m_sql('yhat-yobs')} from fc")
def error_metrics(spark, sf):
    f = fx.fc(spark, sf)
    one = lambda b: _rm(metrics.error_metrics(f, "yobs", "yhat", bias=b), [F.lit(b).alias("sign")])
    return one("obs_minus_pred").unionByName(one("pred_minus_obs"))


@query("spatial_pattern_error", "fc", """with a as (select t, covar_pop(yobs,yhat) as c, sqrt(var_pop(yobs)*var_pop(yhat)) as d, count(*) as n from fc group by t)
    select round(coalesce(1-avg(c/d) filter (where d*n >= 1e-9), 1),5) as spe from a""")
def spatial_pattern_error(spark, sf):
    return metrics.spatial_pattern_error(fx.fc(spark, sf), "t", "yobs", "yhat").select(R("spe", 5).alias("spe"))


@query("weighted_rmse", "", """with a as (select o_totalprice/1000 as y, o_custkey as p, case when dayofyear(o_orderdate) between 274 and 334 then 1.3e0 else 0.3e0 end * case when o_orderkey%72 between 24 and 48 then 1.5e0 else 1e0 end as w, o_orderstatus as s from orders)
    select s as status, round(sqrt(sum(w*power(y-p,2))/sum(w)),4) as wrmse from a group by s""")
def weighted_rmse(spark, sf):
    d = fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 1000).alias("y"), F.col("o_custkey").cast("double").alias("p"),
                                             F.dayofyear("o_orderdate").alias("doy"), (F.col("o_orderkey") % 72).alias("lead"))
    return metrics.weighted_rmse(d, "y", "p", metrics.seasonal_weight(F.col("doy"), F.col("lead")), ["status"]).select("status", R("wrmse", 4).alias("wrmse"))


@query("interval_coverage", "fc", "select round(avg(case when yobs between lo and hi then 1 else 0 end),6) as coverage from fc")
def interval_coverage(spark, sf):
    return metrics.interval_coverage(fx.fc(spark, sf), "yobs", "lo", "hi").select(R("coverage", 6).alias("coverage"))


@query("conformal_halfwidth", "fc", """with r as (select yobs-yhat as r from fc), m as (select median(r) as m from r)
    select 'quantile' as mode, round(quantile_cont(abs(r-m), 0.9),6) as halfwidth from r, m
    union all select 'normal', round(1.96e0*sqrt(sum(r*r)/(count(*)+1) - power(sum(r)/(count(*)+1),2)),6) from r""")
def conformal_halfwidth(spark, sf):
    f, res = fx.fc(spark, sf), F.col("yobs") - F.col("yhat")
    one = lambda m: metrics.conformal_halfwidth(f, res, m).select(F.lit(m).alias("mode"), R("halfwidth", 6).alias("halfwidth"))
    return one("quantile").unionByName(one("normal"))


@query("per_station_metrics", "fc", f"select city, {m_sql()}, round(avg(case when yobs between lo and hi then 1 else 0 end),6) as coverage from fc group by city")
def per_station_metrics(spark, sf):
    return _rm(metrics.error_metrics(fx.fc(spark, sf), "yobs", "yhat", ["city"], "lo", "hi"), ["city"], [R("coverage", 6).alias("coverage")])


EPISODE_SQL = f"""rg as (select city, t, 'inversion' as regime from chx where inv>0 union all select city, t, 'biomass_burning' from chx where crop>0 union all select city, t, 'high_aod' from chx where aod>0.6
      union all select city, t, 'stagnant_wind' from chx where stag>0),
    ep as (select rg.regime, {m_sql()} from fc join rg on rg.city=fc.city and rg.t=fc.t group by 1),
    epl as (select r.regime, coalesce(ep.n,0) as n, ep.* exclude (regime, n), ep.n is not null as present from (values ('inversion'),('biomass_burning'),('high_aod'),('stagnant_wind')) r(regime) left join ep on ep.regime=r.regime)"""


@query("episode_metrics", "fc chx", f"with {EPISODE_SQL} select * from epl")
def episode_metrics(spark, sf):
    return _rm(metrics.episode_metrics(fx.fc(spark, sf), fx.chx(spark, sf), ["city", "t"], "yobs", "yhat"), ["regime"], ["present"])


@query("improvement_pct", "fc", f"""select city, {rsql('sqrt(avg(power(yobs-yhat,2)))')} as rmse_a, {rsql('sqrt(avg(power(yobs-lo,2)))')} as rmse_b,
    {rsql('(1-sqrt(avg(power(yobs-yhat,2)))/sqrt(avg(power(yobs-lo,2))))*100')} as improvement_pct from fc group by city""")
def improvement_pct(spark, sf):
    d = metrics.improvement_pct(fx.fc(spark, sf), "yobs", "yhat", "lo", ["city"])
    return d.select("city", *[_rt(c).alias(c) for c in ("rmse_a", "rmse_b", "improvement_pct")])


@query("source_health", "ledger", "select source, count(*) filter (where complete) as n_complete, max(dt) filter (where complete) as last_date, max(run_id) filter (where complete and dt=(select max(dt) from ledger l2 where l2.complete and l2.source=ledger.source)) as last_run, count(distinct run_id) as n_runs from ledger group by source")
def source_health(spark, sf):
    from airlake.sources.ledger import source_health as health

    return health(fx.ledger(spark, sf))


@query("normalized_adjacency", "stn", f"with {KNN_SQL}, d as (select src, sum(w) as d from kn group by src) select kn.src, kn.dst, round(kn.w/sqrt(a.d*b.d),8) as w from kn join d a on a.src=kn.src join d b on b.src=kn.dst")
def normalized_adjacency(spark, sf):
    return graph.normalize(graph.knn_edges(fx.stn(spark, sf), 6)).select("src", "dst", R("w", 8).alias("w"))


@query("grid_pack", "field", """select hour_idx, max(j)+1 as ny, max(i)+1 as nx, string_agg(cast(cast(pm25 as integer) as varchar), ',' order by j, i) as pm25,
    case when hour_idx=(select max(hour_idx) from field) then string_agg(cast(cast(wd as integer) as varchar), ',' order by j, i) end as wd_last from field group by hour_idx""")
def grid_pack(spark, sf):
    f = fx.field(spark, sf)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",")
    met = ag.grid_pack(ag.last_time(f, "hour_idx"), "hour_idx", {"wd": 0}).select("hour_idx", text("wd").alias("wd_last"))
    return ag.grid_pack(f, "hour_idx", {"pm25": 1}).select("hour_idx", "ny", "nx", text("pm25").alias("pm25")).join(met, "hour_idx", "left")


@query("split_meta", "chx", f"with {SPLIT_SQL} select split, count(*) as n_rows, string_agg(distinct cast(city as varchar), ',' order by cast(city as varchar)) as cities, min(t) as t_start, max(t) as t_end from sp group by split")
def split_meta(spark, sf):
    return splits.split_meta(split_frame(spark, sf), "t", "city").select("split", "n_rows", F.array_join("cities", ",").alias("cities"), "t_start", "t_end")


@query("dashboard_blocks", "fc fire_t obs ledger", """with run as (select max_by(run_id, dt*1) as x from (select run_id, epoch(dt)*1000000+run_id as dt from ledger where source='gfs' and complete) q),
    im as (select count(distinct city)::double as stations, sqrt(avg(power(yobs-lo,2))) as raw_rmse, sqrt(avg(power(yobs-yhat,2))) as engine_rmse, (1-sqrt(avg(power(yobs-yhat,2)))/sqrt(avg(power(yobs-lo,2))))*100 as gain from fc)
    select 'forecast' as block, cast((select x from run) as varchar) as item, 'stations' as name, (select stations from im) as value
    union all select 'forecast', cast((select x from run) as varchar), 'raw_rmse', (select round(raw_rmse*1.000000001e0,4) from im) union all select 'forecast', cast((select x from run) as varchar), 'engine_rmse', (select round(engine_rmse*1.000000001e0,4) from im)
    union all select 'forecast', cast((select x from run) as varchar), 'improvement_pct', (select round(gain*1.000000001e0,4) from im)
    union all select 'fires', fire_id, 'frp', round(frp*1.000000001e0,4) from fire_t where lat between 28.4 and 29.1 and lon between 76.7 and 77.5
    union all select 'stations', cast(station_id as varchar), metric, round(value*1.000000001e0,4) from (select *, row_number() over (partition by station_id, metric order by observed_at_utc desc, seq) rn from obs) x where rn=1""")
def dashboard_blocks(spark, sf):
    from airlake.operators.serve import dashboard

    d = dashboard(fx.fc(spark, sf), fx.fire_t(spark, sf), fx.obs(spark, sf), fx.ledger(spark, sf))
    return d.select("block", "item", "name", _rt("value").alias("value"))


def decoded_rows(spark, sf):
    """Gridded fields as decoded forecast rows (one row per variable and level)."""
    f = fx.field(spark, sf)
    u, v = F.col("ws") * F.sin(F.radians("wd")), F.col("ws") * F.cos(F.radians("wd"))
    items = [("2t", 2, F.col("pm25") + 250.0), ("2r", 2, F.col("pm25")), ("gust", 0, F.col("ws") * 1.5), ("orog", 0, F.lit(200.0) + F.col("i")), ("t", 925, F.col("pm25") + 245.0),
             ("10u", 10, u), ("10v", 10, v), ("u", 925, u * 2), ("v", 925, v * 2)]
    cells = F.array(*[F.struct(F.lit(n).alias("var"), F.lit(lv).alias("level"), x.cast("double").alias("value")) for n, lv, x in items])
    return f.select("hour_idx", "i", "j", F.explode(cells).alias("e")).select("hour_idx", "i", "j", "e.*")


@query("met_pivot", "field", f"""select hour_idx, i, j, round(pm25+250-273.15e0,6) as t2m_c, pm25 as rh_pct, {rsql('ws')} as ws10_ms, round(ws*1.5e0,6) as gust_ms,
    round(925*exp((287.05e0*288.15e0/9.81e0*ln(1013.25e0/925)-(200+i))/(287.05e0*(pm25+245-273.15e0+273.15e0)/9.81e0)),4) as prmsl_hpa, round(pm25+245-273.15e0,6) as t925_c, {rsql('2*ws')} as ws925_ms, cast(null as double) as t850_c from field""")
def met_pivot(spark, sf):
    d = ag.met_pivot(decoded_rows(spark, sf), ["hour_idx", "i", "j"])
    return d.select("hour_idx", "i", "j", R("t2m_c", 6).alias("t2m_c"), "rh_pct", _rt("ws10_ms").alias("ws10_ms"), R("gust_ms", 6).alias("gust_ms"), R("prmsl_hpa", 4).alias("prmsl_hpa"),
                    R("t925_c", 6).alias("t925_c"), _rt("ws925_ms").alias("ws925_ms"), "t850_c")


@query("hourly_fire_state", "fire_t", """with h as (select unnest(generate_series(date_trunc('hour', (select min(acq) from fire_t)), date_trunc('hour', (select max(acq) from fire_t) + interval 6 hour), interval 1 hour)) as hour),
    f6 as (select hour, count(fire_id) as n_active, round(coalesce(sum(frp),0),2) as total_frp_mw from h left join fire_t on hour >= acq and hour < acq + interval 6 hour group by 1)
    select hour, (select count(*) from fire_t) as n_fires, n_active, total_frp_mw from f6""")
def hourly_fire_state(spark, sf):
    f = fx.fire_t(spark, sf)
    ends = f.agg(F.date_trunc("hour", F.min("acq")).cast("timestamp_ntz").alias("a"), F.date_trunc("hour", F.max("acq") + F.expr("interval 6 hour")).cast("timestamp_ntz").alias("b"))
    hours = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return fires.fire_state(f, hours).select("hour", "n_fires", "n_active", R("total_frp_mw", 2).alias("total_frp_mw"))


@query("inversion_summary", "chx", f"""with {INV_SRC}, {INV_SQL}, f as (select *, prob>0.5 as on_ from q), g as (select *, sum(case when on_ then 0 else 1 end) over (partition by city order by t) as isl from f),
    d as (select *, sum(case when on_ then 1 else 0 end) over (partition by city, isl order by t) as run from g)
    select t, {rsql('avg(strength)')} as strength_k_avg, {rsql('avg(hgt)')} as height_m_avg, {rsql('avg(trap)')} as trapping_idx_avg, {rsql('avg(prob)')} as probability_avg,
    {rsql('avg(case when on_ then 1 else 0 end)')} as active_fraction, {rsql('avg(run)')} as duration_avg from d group by t""")
def inversion_summary(spark, sf):
    d = series.add_run_length(inversion_frame(spark, sf), ["city"], "t", F.col("probability") > 0.5)
    s = ag.inversion_summary(d, "t")
    return s.select("t", *[_rt(c).alias(c) for c in s.columns if c != "t"])
