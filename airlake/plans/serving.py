"""Forecast serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import aggregates as ag, features, metrics, serve
from airlake.plans.aggregates import EPISODE_SQL, SIGNALS_SQL, NCR, m_sql
from airlake.plans.registry import query
from airlake.plans.scalars import _CAT, band_values
from airlake.plans.windows import _rt, rsql

FORECAST_SQL = """fs as (select hour_idx as lead, avg(pm25) as pm25, avg(pm25)*1.8e0 as pm10, avg(ws)*10 as o3, avg(wd)/5 as nox, avg(ws) as so2, avg(pm25)*20 as co from field group by 1)"""


def forecast_means(spark, sf):
    d = fx.field(spark, sf).groupBy(F.col("hour_idx").alias("lead")).agg(F.avg("pm25").alias("pm25"), F.avg("ws").alias("ws"), F.avg("wd").alias("wd"))
    return d.select("lead", "pm25", (F.col("pm25") * F.lit(1.8)).alias("pm10"), (F.col("ws") * 10).alias("o3"), (F.col("wd") / 5).alias("nox"), F.col("ws").alias("so2"), (F.col("pm25") * 20).alias("co"))


@query("scenario_pick", "chx fire_t", f"""with {SIGNALS_SQL}, f as (select round(coalesce(sum(frp),0),1) as p from fire_t where {NCR})
    select inversion_hours, biomass_season_hours, case when p>2000 then 'stubble_plume' when inversion_hours>0 and inversion_hours>=biomass_season_hours then 'strong_inversion' else 'normal_winter' end as scenario from sg, f""")
def scenario_pick(spark, sf):
    s = features.regime_signals(fx.chx(spark, sf), "t")
    f = ag.fires_summary(fx.fire_t(spark, sf), "lat", "lon", "frp", "acq")
    return serve.scenario_pick(s, f).select("inversion_hours", "biomass_season_hours", "scenario")


ANCHOR_SQL = f"""{FORECAST_SQL}, tm as (select max(t) as m from chx), nr as (select avg(pm25) as pm25, avg(pm10) as pm10, avg(o3) as o3 from chx, tm where t >= m - interval 1 hour and {NCR}), f1 as (select * from fs where lead=1),
    of as (select 'pm25' as species, nr.pm25-f1.pm25 as g from nr, f1 union all select 'pm10', nr.pm10-f1.pm10 from nr, f1 union all select 'o3', nr.o3-f1.o3 from nr, f1)"""


@query("anchor_offsets", "chx field", f"""with {ANCHOR_SQL} select species, coalesce(round(g,2),0) as "offset", m as data_as_of, 0.5e0 as age_days, 'applied' as mode from of, tm
    union all select species, 0e0, m, 4e0, 'stale-not-applied' from of, tm""")
def anchor_offsets(spark, sf):
    c, f = fx.chx(spark, sf), forecast_means(spark, sf)
    top = c.agg(F.max("t").alias("m")).scalar()
    fresh = serve.anchor_offsets(c, f, "t", "lead", top + F.expr("interval 12 hour"))
    return fresh.unionByName(serve.anchor_offsets(c, f, "t", "lead", top + F.expr("interval 96 hour")))


_X = "(case when p='CO' then greatest(v,0)/1000 else greatest(v,0) end)"
LIVE_SQL = f"""{ANCHOR_SQL}, a1 as (select lead, round(greatest(0, pm25+coalesce((select round(g,2) from of where species='pm25'),0)),2) as pm25, round(greatest(0, pm10+coalesce((select round(g,2) from of where species='pm10'),0)),2) as pm10,
      round(greatest(0, o3+coalesce((select round(g,2) from of where species='o3'),0)),2) as o3, nox, so2, co from fs),
    ln as (select lead, 'PM2.5' as p, 1 as o, pm25 as v from a1 union all select lead, 'PM10', 2, pm10 from a1 union all select lead, 'O3', 3, o3 from a1 union all select lead, 'NO2', 4, nox from a1 union all select lead, 'SO2', 5, so2 from a1 union all select lead, 'CO', 6, co from a1),
    sx as (select lead, ln.p, o, first(cast(round_even(b.il + ({_X.replace('p=', 'ln.p=')} - b.lo)/(b.hi-b.lo)*(b.ih-b.il), 0) as integer) order by b.k) as si from ln join (values {band_values('gapped')}) b(p,k,lo,hi,il,ih) on ln.p=b.p and {_X.replace('p=', 'ln.p=')} <= b.hi group by 1,2,3),
    aq as (select lead, max(si) as aqi, first(p order by si desc, o) as dominant from sx group by 1),
    lv as (select a1.lead, pm25, pm10, o3, round(greatest(0,pm25-12.5e0),2) as pm25_lo, round(pm25+12.5e0,2) as pm25_hi, aqi, dominant, {_CAT.format(a='aqi')} as category from a1 join aq using (lead))"""


def live(spark, sf):
    c, f = fx.chx(spark, sf), forecast_means(spark, sf)
    top = c.agg(F.max("t").alias("m")).scalar()
    off = serve.anchor_offsets(c, f, "t", "lead", top + F.expr("interval 12 hour"))
    return serve.anchored_series(f, serve.offset_map(off), {"pm25": 12.5, "pm10": 20.0, "o3": 9.0}, "lead")


@query("anchored_series", "chx field", f"with {LIVE_SQL} select * from lv")
def anchored_series(spark, sf):
    return live(spark, sf).select("lead", "pm25", "pm10", "o3", "pm25_lo", "pm25_hi", "aqi", "dominant", "category")


@query("aqi_at_lead", "chx field", f"""with {LIVE_SQL}, rl as (select *, dense_rank() over (order by lead) - 1 as k from lv)
    select lead, aqi, category from rl where k in (least(5, (select max(k) from rl)), least(72, (select max(k) from rl)))""")
def aqi_at_lead(spark, sf):
    d = live(spark, sf)
    pick = lambda k: serve.at_lead_clamped(d, "lead", k).select("lead", "aqi", "category")
    return pick(5).unionByName(pick(72))


@query("current_observations", "chx", """select city, t, round(pm25,2) as pm25, round(pm10,2) as pm10, temp, inv, stag, round(aod,2) as aod from (select *, row_number() over (partition by city order by t desc) rn from chx where t >= (select max(t) from chx) - interval 72 hour) x where rn=1""")
def current_observations(spark, sf):
    return serve.current_observations(fx.chx(spark, sf), "city", "t", ["pm25", "pm10", "temp", "inv", "stag", "aod"])


@query("lead_map", "field", """select hour_idx, string_agg(cast(cast(pm25 as integer) as varchar), ',' order by j, i) as pm25 from field where hour_idx=(select hour_idx from field group by 1 order by abs(hour_idx-14.4e0), hour_idx limit 1) group by 1 union all select hour_idx, string_agg(cast(cast(pm25 as integer) as varchar), ',' order by j, i) from field where hour_idx=(select hour_idx from field group by 1 order by abs(hour_idx-72), hour_idx limit 1) group by 1""")
def lead_map(spark, sf):
    f = fx.field(spark, sf)
    text = F.array_join(F.transform("pm25", lambda x: x.cast("int").cast("string")), ",").alias("pm25")
    return serve.lead_map(f, "hour_idx", "pm25", 14.4).select("hour_idx", text).unionByName(serve.lead_map(f, "hour_idx", "pm25", 72).select("hour_idx", text))


def _melt(section: str, label: str, names: list[str], src: str) -> str:
    return " union all ".join(f"select '{section}' as section, {label} as label, '{n}' as metric, {n}::double as value from {src}" for n in names)


_N = ["n", "bias", "mae", "rmse", "r2", "correlation"]


@query("validation_report", "fc chx", f"""with {EPISODE_SQL}, mo as (select 'persistence' as model, {m_sql()} from fc union all select 'shifted', {m_sql().replace('yhat', 'lo')} from fc),
    st as (select cast(city as varchar) as c, {m_sql()}, avg(case when yobs between lo and hi then 1 else 0 end) as coverage from fc group by 1),
    ab as (select {rsql('sqrt(avg(power(yobs-yhat,2)))')} as rmse_a, {rsql('sqrt(avg(power(yobs-lo,2)))')} as rmse_b, {rsql('(1-sqrt(avg(power(yobs-yhat,2)))/sqrt(avg(power(yobs-lo,2))))*100')} as improvement_pct from fc),
    al as ({_melt('models', 'model', _N, 'mo')} union all {_melt('stations', 'c', [*_N, 'coverage'], 'st')} union all {_melt('episodes', 'regime', _N, 'epl')} union all {_melt('ablation', "'coupling'", ['rmse_a', 'rmse_b', 'improvement_pct'], 'ab')})
    select section, label, metric, round(value*1.000000001e0,4) as value from al""")
def validation_report(spark, sf):
    d = serve.validation_report(fx.fc(spark, sf), fx.chx(spark, sf), {"persistence": "yhat", "shifted": "lo"}, "yobs", ["city", "t"], "yhat", "lo")
    return d.select("section", "label", "metric", _rt("value", 4).alias("value"))
