"""Station feed to hourly air-quality index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from airlake import fixtures as fx
from airlake.functions import aqi
from airlake.functions.timing import hour_floor
from airlake.operators import qc
from airlake.plans.quality import MAD_SQL
from airlake.plans.registry import query
from airlake.plans.scalars import _CAT, band_values

METRICS = ("PM2.5", "PM10", "O3", "NO2", "CO")

_SQL = f"""with o1 as (select * from (select *, row_number() over (partition by observed_at_utc, station_id, metric order by seq desc) rn from obs) x where rn=1 and value between 0 and 2000),
    {MAD_SQL.replace('from obs)', 'from o1)')}, k as (select station_id, date_trunc('hour', observed_at_utc) as t, metric, avg(value) as v from m2 where not coalesce(case when mad=0 then value<>med else abs(value-med)/(1.4826e0*mad) > 5 end, false) group by 1,2,3),
    s as (select station_id, t, metric, first(cast(round_even((b.ih-b.il)/(b.hi-b.lo)*(k.v-b.lo)+b.il, 0) as integer) order by b.k) as si from k join (values {band_values('contiguous')}) b(p,k,lo,hi,il,ih) on k.metric=b.p and k.v <= b.hi group by 1,2,3),
    a as (select station_id, t, max(si) as aqi, first(metric order by si desc, list_position(['PM2.5','PM10','O3','NO2','CO'], metric)) as dominant from s group by 1,2)
    select station_id, t, aqi, dominant, {_CAT.format(a='aqi')} as category, case when aqi>=451 then 4 when aqi>=401 then 3 when aqi>=301 then 2 when aqi>=201 then 1 else 0 end as stage from a"""


@query("hourly_index", "obs", _SQL)
def hourly_index(spark: SparkSession, sf: str) -> DataFrame:
    """De-duplicate, range and spike checks, hourly means, index, category and action stage per station."""
    o = qc.keep_last(fx.obs(spark, sf), ["observed_at_utc", "station_id", "metric"], "seq")
    o = o.filter(~qc.out_of_range(F.col("value")))
    o = qc.mad_flag(o, ["station_id", "metric"], "value").filter("not is_spike")
    v = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m.replace(".", ""))
    hourly = o.groupBy("station_id", hour_floor(F.col("observed_at_utc")).alias("t")).agg(*[v(m) for m in METRICS])
    comp = aqi.composite({m: F.col(m.replace(".", "")) for m in METRICS})
    d = hourly.select("station_id", "t", comp["aqi"].alias("aqi"), comp["dominant"].alias("dominant"))
    return d.withColumns({"category": aqi.category(F.col("aqi")), "stage": aqi.action_stage(F.col("aqi"))})
