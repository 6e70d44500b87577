"""Window, ordering, limit and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import features, series, splits
from airlake.plans.registry import query


def _rt(c, n=4):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(1.000000001), n)


def rsql(x, n=4):
    return f"round(({x})*1.000000001e0, {n})"


_T = ("pm25", "pm10", "o3")


@query("ffill_lags", "ch", "with f as (select city, t, " + ", ".join(
    f"last_value({c} ignore nulls) over (partition by city order by t rows between unbounded preceding and current row) as {c}" for c in _T)
    + " from ch) select city, t, " + ", ".join(rsql(f"lag({c},{k}) over (partition by city order by t)") + f" as {c}_lag{k}" for c in _T for k in series.LAGS) + " from f")
def ffill_lags(spark, sf):
    d = series.add_lags(fx.ch(spark, sf), ["city"], "t", list(_T))
    return d.select("city", "t", *[_rt(c).alias(c) for c in d.columns if "_lag" in c])


@query("rolling_mean_24", "ch", f"""select city, t, {rsql('avg(pm25) over w')} as roll24, {rsql('avg(coalesce(pm25,0)) over w')} as roll24_zero,
    {rsql('avg(pm25) over (partition by city order by t rows between 24 preceding and 1 preceding)')} as roll24_past
    from ch window w as (partition by city order by t rows between 23 preceding and current row)""")
def rolling_mean_24(spark, sf):
    w = series.by(["city"], "t")
    return fx.ch(spark, sf).select("city", "t", _rt(series.rolling_mean("pm25", w)).alias("roll24"),
                                   _rt(series.rolling_mean("pm25", w, nulls_as_zero=True)).alias("roll24_zero"),
                                   _rt(series.rolling_mean("pm25", w, exclude_current=True)).alias("roll24_past"))


@query("rolling_fire_sums", "fire", """with h as (select unnest(range(0, (select max(acq_h)+1 from fire))) as acq_h), s as (select h.acq_h, coalesce(sum(frp),0) as p from h left join fire using (acq_h) group by 1)
    select timestamp '2024-01-01 00:00:00' + to_hours(acq_h) as t, round(sum(p) over (order by acq_h rows between 5 preceding and current row),2) as frp_6h,
    round(sum(p) over (order by acq_h rows between 11 preceding and current row),2) as frp_12h, round(sum(p) over (order by acq_h rows between 23 preceding and current row),2) as frp_24h,
    round(sum(p) over (order by acq_h rows between 47 preceding and current row),2) as frp_48h from s""")
def rolling_fire_sums(spark, sf):
    f = fx.fire_t(spark, sf).select(F.expr("timestampadd(HOUR, cast(acq_h as int), timestamp_ntz'2024-01-01 00:00:00')").alias("t"), "frp")
    per = f.groupBy("t").agg(F.sum("frp").alias("total_frp"))
    hourly = (f.agg(F.max("t").alias("b")).select(F.explode(F.sequence(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("b"), F.expr("interval 1 hour"))).alias("t"))
              .join(per, "t", "left").fillna(0.0, ["total_frp"]))
    d = series.trailing_sums(hourly, "t", "total_frp", (6, 12, 24, 48), "frp_", keep=["t"])
    return d.select("t", *[F.round(c, 2).alias(c) for c in d.columns if c != "t"])


@query("rolling_anomaly", "chx", f"select city, t, {rsql('temp - avg(temp) over (partition by city order by t rows between 23 preceding and current row)')} as anomaly from chx")
def rolling_anomaly(spark, sf):
    return fx.chx(spark, sf).select("city", "t", _rt(series.rolling_anomaly("temp", series.by(["city"], "t"))).alias("anomaly"))


FULL_SQL = """hh as (select city, unnest(generate_series(min(t), max(t), interval 1 hour)) as t from chx group by city),
    fulls as (select hh.city, hh.t, chx.* exclude (city, t) from hh left join chx on hh.city=chx.city and hh.t=chx.t),"""


def fill_sql(cols):
    return "filled as (select city, t, " + ", ".join(
        f"coalesce(last_value({c} ignore nulls) over (partition by city order by t rows between unbounded preceding and current row),"
        f" first_value({c} ignore nulls) over (partition by city order by t rows between current row and unbounded following)) as {c}" for c in cols) + " from fulls)"


@query("fill_both_ways", "chx", f"with {FULL_SQL} {fill_sql(_T)} select city, t, " + ", ".join(f"{rsql(c)} as {c}" for c in _T) + " from filled")
def fill_both_ways(spark, sf):
    d = series.timeline_reindex(fx.ch(spark, sf).select("city", "t", *_T), ["city"], "t")
    return series.fill_both_ways(d, ["city"], "t", list(_T)).select("city", "t", *[_rt(c).alias(c) for c in _T])


@query("trend_and_bias", "fc", f"""select city, t, {rsql('least(greatest(yhat - lag(yhat,1,0) over w,-300),300)')} as mdl_trend, {rsql('yhat-yobs')} as mdl_obs_bias,
    {rsql('lag(yobs,1,0) over w')} as lag1, {rsql('lag(yobs,24,0) over w')} as lag24, {rsql('lag(yobs,1) over w')} as lag1_null from fc window w as (partition by city order by t)""")
def trend_and_bias(spark, sf):
    w = series.by(["city"], "t")
    return fx.fc(spark, sf).select("city", "t", _rt(series.trend("yhat", w)).alias("mdl_trend"), _rt(F.col("yhat") - F.col("yobs")).alias("mdl_obs_bias"),
                                   _rt(series.lag_zero("yobs", 1, w)).alias("lag1"), _rt(series.lag_zero("yobs", 24, w)).alias("lag24"), _rt(F.lag("yobs", 1).over(w)).alias("lag1_null"))


@query("run_length", "ch", """with a as (select city, t, coalesce(pm25 < 60, false) as f from ch), b as (select *, sum(case when f then 0 else 1 end) over (partition by city order by t) as g from a)
    select city, t, cast(sum(case when f then 1 else 0 end) over (partition by city, g order by t) as integer) as run from b""")
def run_length(spark, sf):
    return series.add_run_length(fx.ch(spark, sf), ["city"], "t", F.col("pm25") < 60).select("city", "t", "run")


@query("latest_per_key", "obs", """select station_id, metric, seq, value, observed_at_utc from (select *, row_number() over (partition by station_id, metric order by observed_at_utc desc, seq) rn from obs) x where rn=1""")
def latest_per_key(spark, sf):
    return series.latest_per_key(fx.obs(spark, sf), ["station_id", "metric"], "observed_at_utc", "seq").select("station_id", "metric", "seq", "value", "observed_at_utc")


@query("timeseries_tail", "obs", """select * from obs where station_id=3 and metric='PM2.5' and observed_at_utc >= timestamp '2024-01-03 00:00:00' and observed_at_utc <= timestamp '2024-01-25 00:00:00' order by observed_at_utc desc, seq desc limit 25""")
def timeseries_tail(spark, sf):
    t = F.col("observed_at_utc")
    return series.timeseries_tail(fx.obs(spark, sf), "observed_at_utc", "seq", 25, F.col("station_id") == 3, F.col("metric") == "PM2.5",
                                  t >= F.expr("timestamp_ntz'2024-01-03 00:00:00'"), t <= F.expr("timestamp_ntz'2024-01-25 00:00:00'"))


@query("recent_topk", "fire_t", """select fire_id, lat, lon, frp, acq from fire_t where lat between 28.4 and 29.1 and lon between 76.7 and 77.5 order by acq desc, fire_id, frp, lat, lon limit 500""")
def recent_topk(spark, sf):
    from airlake.functions.geo import NCR_BOX
    from airlake.operators.normalize import bbox

    return series.recent_topk(bbox(fx.fire_t(spark, sf), "lat", "lon", **NCR_BOX), "acq", ["fire_id", "frp", "lat", "lon"], 500).select("fire_id", "lat", "lon", "frp", "acq")


@query("assets_query", "asset", "select * from asset where run_id=3 and variable='2-HIGH' order by seq limit 200")
def assets_query(spark, sf):
    return series.first_rows(fx.asset(spark, sf), ["seq"], 200, F.col("run_id") == 3, F.col("variable") == "2-HIGH")


@query("forecast_series", "fc", f"select city, t, {rsql('yobs')} as yobs, {rsql('yhat')} as yhat from fc where city in (2,5) order by t, city limit 100")
def forecast_series(spark, sf):
    return series.first_rows(fx.fc(spark, sf), ["t", "city"], 100, F.col("city").isin(2, 5)).select("city", "t", _rt("yobs").alias("yobs"), _rt("yhat").alias("yhat"))


@query("field_at_lead", "field", "select hour_idx, i, j, pm25 from (select *, dense_rank() over (order by hour_idx)-1 as k from field) x where k=12")
def field_at_lead(spark, sf):
    return series.field_at_lead(fx.field(spark, sf), "hour_idx", 12).select("hour_idx", "i", "j", "pm25")


@query("context_windows", "fc", f"""with a as (select city, t, yobs, row_number() over (partition by city order by t)-1 as i, avg(yobs) over w as m, min(yobs) over w as lo, count(*) over w as n from fc window w as (partition by city order by t rows between 24 preceding and 1 preceding))
    select city, t, cast(n as integer) as n, {rsql('m')} as mean_w, {rsql('lo')} as min_w, {rsql('yobs')} as target from a where i >= 24 and (i-24)%4=0""")
def context_windows(spark, sf):
    d = series.context_windows(fx.fc(spark, sf), ["city"], "t", "yobs", 24, 4)
    mean = F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / F.size("window")
    return d.select("city", "t", F.size("window").alias("n"), _rt(mean).alias("mean_w"), _rt(F.array_min("window")).alias("min_w"), _rt("target").alias("target"))


@query("persistence_forecast", "fc", f"""with o as (select city, min(t) as origin, arg_min(yobs, t) as y from fc where t > timestamp '2024-01-25 00:00:00' group by city)
    select city, origin, cast(unnest(range(1,73)) as integer) as lead, {rsql('y')} as yhat from o""")
def persistence_forecast(spark, sf):
    test = fx.fc(spark, sf).filter(F.col("t") > F.expr("timestamp_ntz'2024-01-25 00:00:00'"))
    return series.persistence_forecast(test, ["city"], "t", "yobs").select("city", "origin", "lead", _rt("yhat").alias("yhat"))


@query("chrono_split", "", """with m as (select max(o_orderdate) as m from orders)
    select o_orderkey as seq, case when o_orderdate < m - interval 24 month - interval 1 hour then 'train' when o_orderdate < m - interval 12 month - interval 1 hour then 'validation' else 'test' end as split from orders, m""")
def chrono_split(spark, sf):
    return splits.chrono_split(fx.table(spark, sf, "orders"), "o_orderdate").select(F.col("o_orderkey").alias("seq"), "split")


def split_frame(spark, sf):
    ts = lambda d: F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'")
    return splits.split_at(fx.chx(spark, sf), "t", ts("20"), ts("25"))


SPLIT_SQL = """sp as (select *, case when t < timestamp '2024-01-20 00:00:00' then 'train' when t < timestamp '2024-01-25 00:00:00' then 'validation' else 'test' end as split from chx)"""


@query("leakage_check", "chx", f"""with {SPLIT_SQL}, m as (select split, min(t) as a, max(t) as b from sp group by split)
    select concat('chronology ', x.split, ' < ', y.split) as "check", case when y.a <= x.b then 'FAIL' else 'OK' end as status, x.b as prev_end, y.a as next_start
    from m x join m y on (x.split='train' and y.split='validation') or (x.split='validation' and y.split='test')""")
def leakage_check(spark, sf):
    return splits.leakage_check(splits.split_meta(split_frame(spark, sf), "t", "city"))


@query("t1_features", "fc", "with a as (select *, row_number() over (partition by city order by t)-1 as i, first_value(yhat) over (partition by city order by t) as f, first_value(yobs) over (partition by city order by t) as fo from fc) select city, t, "
       + ", ".join(rsql(f"coalesce(lag(yhat,{k}) over w, f)") + f" as lag{k}" for k in range(1, 7))
       + f""", {rsql('coalesce(lag(yobs) over w, fo)')} as obs_prev, {rsql('yhat')} as physics_now, round(sin(2*pi()*(i%24)/24),4) as hour_sin, round(cos(2*pi()*(i%24)/24),4) as hour_cos,
       round(sin(2*pi()*(i%365)/365),4) as day_sin, round(cos(2*pi()*(i%365)/365),4) as day_cos, {rsql('avg(yhat) over (partition by city order by t rows between 6 preceding and current row)')} as roll7,
       {rsql('case when i>=6 then yhat - lag(yhat,6) over w else 0 end')} as trend6 from a window w as (partition by city order by t)""")
def t1_features(spark, sf):
    d = features.t1_features(fx.fc(spark, sf), ["city"], "t", "yhat", "yobs")
    cyc = {"hour_sin", "hour_cos", "day_sin", "day_cos"}
    return d.select("city", "t", *[(F.round(c, 4) if c in cyc else _rt(c)).alias(c) for c in d.columns if c not in ("city", "t")])


STATION_SQL = """sf as (select s.station_id, f.hour_idx, f.pm25, f.ws, f.wd from stn s join field f
    on f.i = cast(least(greatest(round_even((s.lon-76.8e0)/0.8e0*19,0),0),19) as bigint) and f.j = cast(least(greatest(round_even((s.lat-28.2e0)/0.8e0*21,0),0),21) as bigint))"""


def station_field(spark, sf):
    from airlake.operators.joins import GridSpec, sample_at_stations

    return sample_at_stations(fx.field(spark, sf), fx.stn(spark, sf), GridSpec(20, 22), ["pm25", "ws", "wd"], time="hour_idx")


@query("stations_at_leads", "stn field", f"with {STATION_SQL} select station_id, hour_idx, round(greatest(0, pm25 - 30.5e0),2) as pm25 from sf where hour_idx in (6,12,23)")
def stations_at_leads(spark, sf):
    d = series.at_leads(station_field(spark, sf), "hour_idx", [6, 12, 23], ["pm25"], {"pm25": -30.5})
    return d.select("station_id", "hour_idx", "pm25")


@query("peak_row", "stn field", f"with {STATION_SQL} select station_id, hour_idx, pm25, ws from (select *, row_number() over (partition by station_id order by pm25 desc, hour_idx) rn from sf) x where rn=1")
def peak_row(spark, sf):
    return series.peak_row(station_field(spark, sf), ["station_id"], "pm25", "hour_idx", ["ws"])


RAW_COLS = ("pm25", "pm10", "o3", "ws", "wd", "rh", "temp", "aod", "solar", "inv", "stag", "pbl")


@query("physics_features", "chx", f"""with k as (select case when count(*) filter (where aod is not null and coalesce(pm25,0)>1) < 10 then 0.00023e0 else
      least(greatest(sum(x*aod) filter (where aod is not null and coalesce(pm25,0)>1)/sum(x*x) filter (where aod is not null and coalesce(pm25,0)>1),1e-6),3e-3) end as k
      from (select *, greatest(coalesce(pm25,0),0)*(1+0.12e0*least(greatest((coalesce(rh,50)-40)/60,0),1)) as x from chx) q),
    a as (select *, greatest(coalesce(pm25,0),0)*0.00023e0*(1+0.12e0*least(greatest((coalesce(rh,50)-40)/60,0),1)) as est,
      least(greatest((150+1450*(0.45e0+0.55e0*greatest(sin(pi()*(hour(t)-5.5e0)/14),0)))*(1-0.35e0*cloud/100),150),2200) as base from chx),
    b as (select *, coalesce(0.7e0*aod+0.3e0*est, est) as fused from a)
    select city, t, round((select k from k),9) as aod_calibrated_k, {rsql('fused',7)} as aod_fused, {rsql('solar*(1-exp(-least(greatest(fused,0),6)))')} as solar_dimming_wm2,
      {rsql('case when solar>1 then least(greatest(1-exp(-least(greatest(fused,0),6)),0),1) else 0 end',6)} as solar_dimming_frac, {rsql('base')} as pblh_base_m,
      {rsql('greatest(base*(1-0.25e0*least(greatest(0.3e0*est,0),1)),150)')} as pblh_coupled_m, {rsql('least(greatest(0.25e0*0.3e0*est,0),1)',8)} as feedback_strength,
      {rsql('temp - avg(temp) over (partition by city order by t rows between 23 preceding and current row)')} as temperature_anomaly_c from b""")
def physics_features(spark, sf):
    d = features.physics_features(fx.chx(spark, sf), ["city"], "t")
    return d.select("city", "t", F.round("aod_calibrated_k", 9).alias("aod_calibrated_k"), _rt("aod_fused", 7).alias("aod_fused"), _rt("solar_dimming_wm2").alias("solar_dimming_wm2"),
                    _rt("solar_dimming_frac", 6).alias("solar_dimming_frac"), _rt("pblh_base_m").alias("pblh_base_m"), _rt("pblh_coupled_m").alias("pblh_coupled_m"),
                    _rt("feedback_strength", 8).alias("feedback_strength"), _rt("temperature_anomaly_c").alias("temperature_anomaly_c"))


def raw_frame(spark, sf, coupled=True):
    """Filled hourly frame with simple exposure columns, then the 17 raw features."""
    d = fx.chx(spark, sf).select("city", "t", *[c for c in RAW_COLS if c != "pbl"], (F.lit(300.0) + F.col("cloud") * 10).alias("pbl"))
    d = d.withColumns({"inv": F.col("inv").cast("double"), "stag": F.col("stag").cast("double")})
    d = series.fill_both_ways(series.timeline_reindex(d, ["city"], "t"), ["city"], "t", list(RAW_COLS))
    d = d.select("*", F.col("pbl").alias("pblh_base_m"), (F.col("pbl") * F.lit(0.9)).alias("pblh_coupled_m"), (F.col("pm25") / 600).alias("feedback_strength"),
                 F.col("pm10").alias("upwind_frp"), F.col("o3").alias("close_frp_50km"), (F.col("city") * 40).cast("double").alias("min_distance_km"))
    return features.raw_model(d, ["city"], "t", coupled)


RAW_SQL = f"""{FULL_SQL.replace('from chx group', "from chx group")} fill0 as (select * replace (cast(inv as double) as inv, cast(stag as double) as stag), 300e0+cloud*10 as pbl from fulls),
    {fill_sql(RAW_COLS).replace('from fulls)', 'from fill0)')},
    g as (select *, coalesce(lag(pm25) over w,0) as p25, coalesce(lag(pm10) over w,0) as p10, coalesce(lag(o3) over w,0) as po3, coalesce(ws,0)/3.6e0 as wsm,
      case when city>0 then city*40e0 else 300e0 end as far, coalesce(pm10,0) as up, coalesce(o3,0) as cl, pbl*0.9e0 as pc, pm25/600 as fb from filled window w as (partition by city order by t)),
    g2 as (select *, least(greatest(0.35e0/(1+0.25e0*least(greatest(pc*wsm/1000,0.05e0),30)) + 0.05e0*(case when coalesce(rh,0)>70 then 1 else 0 end),0.02e0),0.85e0) as loss,
      9e0*(1+0.03e0*8*least(greatest((18-temp)/8,0),1.5e0))*(0.6e0+0.8e0*least(greatest(stag,0),1)) as urban, exp(-far/300) as dd, least(greatest(solar/400,0),1) as dy,
      1+0.35e0*least(greatest(coalesce(fb,0),0),1)*least(greatest((p25-80)/120,0),1) as trap from g),
    g3 as (select *, 0.045e0*(up*dd+0.5e0*cl) as fi from g2),
    rawm as (select city, t, greatest(p25*(1-loss)+urban+fi,0)*trap as pm25_raw, greatest(p10*(1-loss)+1.55e0*urban+1.6e0*fi,0)*trap as pm10_raw,
      least(greatest(38e0+40e0*dy*(1+0.02e0*least(greatest(temp-15,-3),10))-0.035e0*p25*(1-dy),0),200) as o3_raw, pc as pblh_m,
      0.10e0*inv+0.05e0*stag-0.01e0*least(greatest(wsm,0),10) as gamma, 0.25e0*inv/(1+least(greatest(wsm,0),8))+0.001e0 as ri_bulk, coalesce(rh,0) as rh_pct, wsm as ws_ms, wd as wd_deg,
      coalesce(aod,0) as aod, temp as t2m_c, 0.5e0*cl+0.3e0*up as frp_local_mw, 0.045e0*dd*(up+0.5e0*cl) as fire_exposure, p25 as obs_pm25, p10 as obs_pm10, po3 as obs_o3, 0e0 as obs_manual from g3)"""


@query("raw_model_features", "chx", f"with {RAW_SQL} select city, t, " + ", ".join(f"{rsql(c)} as {c}" for c in features.RAW_FEATURES) + " from rawm")
def raw_model_features(spark, sf):
    return raw_frame(spark, sf).select("city", "t", *[_rt(c).alias(c) for c in features.RAW_FEATURES])


ENG_SQL = {
    "hour_sin": "sin(2*pi()*hour(t)/24)", "hour_cos": "cos(2*pi()*hour(t)/24)", "doy_sin": "sin(2*pi()*dayofyear(t)/365.25e0)", "doy_cos": "cos(2*pi()*dayofyear(t)/365.25e0)",
    "lag1_pm25": "lag(obs_pm25,1,0) over w", "lag1_pm10": "lag(obs_pm10,1,0) over w", "lag1_o3": "lag(obs_o3,1,0) over w", "lag24_pm25": "lag(obs_pm25,24,0) over w",
    "roll24_pm25": "avg(obs_pm25) over w24", "roll24_pm10": "avg(obs_pm10) over w24",
    "inv_strength": "1/(1+exp(-((gamma-0.5e0)/0.3e0)))*(1/(1+exp(-((ri_bulk-0.6e0)/0.4e0))))", "vent_coef": "pblh_m*ws_ms/1000",
    "log_obs_pm25": "ln(1+greatest(obs_pm25,0))", "mdl_trend": "least(greatest(pm25_raw - lag(pm25_raw,1,0) over w,-300),300)", "mdl_obs_bias": "pm25_raw-obs_pm25"}


@query("feature_vector", "chx", f"with {RAW_SQL} select city, t, " + ", ".join(
    (rsql(ENG_SQL[c]) if c in ENG_SQL else rsql(c)) + f" as {c}" for c in features.FEATURES)
    + " from rawm window w as (partition by city order by t), w24 as (partition by city order by t rows between 23 preceding and current row)")
def feature_vector(spark, sf):
    return features.feature_row(raw_frame(spark, sf), ["city"], "t").select("city", "t", *[_rt(c).alias(c) for c in features.FEATURES])
