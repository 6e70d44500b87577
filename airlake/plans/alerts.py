"""Alert queries over station series sampled from the gridded forecast."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake.operators import alerts as al
from airlake.plans.registry import query
from airlake.plans.windows import STATION_SQL, station_field

SERIES_SQL = f"""{STATION_SQL}, se as (select station_id, hour_idx as t, pm25*4-60 as pm25, 180e0+(station_id*13+hour_idx*31)%260 as aqi, ((station_id*7+hour_idx*11)%100)/120e0 as trapping, ws/4 as ws,
    ((station_id*5+hour_idx*3)%40)/60e0 as plume, ((station_id+hour_idx*7)%30)/60e0 as fire from sf),
    si as materialized (select *, row_number() over (partition by station_id order by t)-1 as i from se)"""


def alert_series(spark, sf):
    s, h = F.col("station_id"), F.col("hour_idx")
    return station_field(spark, sf).select(
        "station_id", h.alias("t"), (F.col("pm25") * 4 - 60).alias("pm25"), (F.lit(180.0) + (s * 13 + h * 31) % 260).alias("aqi"), (((s * 7 + h * 11) % 100) / F.lit(120.0)).alias("trapping"),
        (F.col("ws") / 4).alias("ws"), (((s * 5 + h * 3) % 40) / F.lit(60.0)).alias("plume"), (((s + h * 7) % 30) / F.lit(60.0)).alias("fire"))


def _peak_sql(kind: str, value: str, cond: str, severity: str) -> str:
    return f"""select station_id, concat('{kind}-', i) as alert_id, '{kind}' as alert_type, {severity} as severity, cast(i as integer) as idx, t as "timestamp", round(v,5) as v
      from (select *, {value} as v, row_number() over (partition by station_id order by {value} desc, i) rn from si) q where rn=1 and {cond}"""


PARTS = {
    "HIGH_PM": _peak_sql("HIGH_PM", "pm25", "v>120", "case when v<201 then 'warning' else 'critical' end"),
    "SEVERE_AQI": _peak_sql("SEVERE_AQI", "aqi", "v>=301", "case when v>=401 then 'critical' else 'warning' end"),
    "INVERSION": _peak_sql("INVERSION", "trapping", "v>0.6", "'warning'"),
    "STAGNANT_WIND": """select station_id, 'STAGNANT_WIND' as alert_id, 'STAGNANT_WIND' as alert_type, 'warning' as severity, cast(i as integer) as idx, t as "timestamp", round(ws,5) as v
      from (select *, row_number() over (partition by station_id order by i) rn from (select *, ws<1.5 and lag(ws) over w <1.5 and lag(ws,2) over w <1.5 as hit from si window w as (partition by station_id order by t)) q where hit) x where rn=1""",
    "STUBBLE_PLUME": _peak_sql("STUBBLE_PLUME", "plume*(1+1.2e0*fire)", "v>0.75", "'warning'").replace("round(v,5) as v", "round(plume,5) as v"),
    "RAPID_PM_RISE": """select a.station_id, 'RAPID_PM_RISE' as alert_id, 'RAPID_PM_RISE' as alert_type, 'warning' as severity, 6 as idx, b.t as "timestamp", round(b.pm25-a.pm25,5) as v
      from si a join si b on a.station_id=b.station_id and a.i=0 and b.i=6 where b.pm25-a.pm25>40""",
}
MAIN = {"HIGH_PM": "pm25", "SEVERE_AQI": "aqi", "INVERSION": "trapping_index", "STAGNANT_WIND": "ws10_ms", "STUBBLE_PLUME": "plume_conc", "RAPID_PM_RISE": "delta_6h"}


def _flat(d):
    v = F.coalesce(*[F.try_element_at("data", F.lit(k)) for k in MAIN.values()])
    return d.select("station_id", "alert_id", "alert_type", "severity", "idx", "timestamp", F.round(v, 5).alias("v"))


def _one(name: str, rule: str) -> None:
    @query(name, "stn field", f"with {SERIES_SQL} {PARTS[rule]}")
    def run(spark, sf):
        return _flat(al.alerts(alert_series(spark, sf), ["station_id"], rules=(rule,)))


for _name, _rule in (("alert_high_pm", "HIGH_PM"), ("alert_severe_aqi", "SEVERE_AQI"), ("alert_inversion", "INVERSION"), ("alert_stagnant_wind", "STAGNANT_WIND"),
                     ("alert_plume", "STUBBLE_PLUME"), ("alert_rapid_rise", "RAPID_PM_RISE")):
    _one(_name, _rule)


@query("alerts_all", "stn field", f"with {SERIES_SQL} " + " union all ".join(f"select * from ({p})" for p in PARTS.values()))
def alerts_all(spark, sf):
    return _flat(al.alerts(alert_series(spark, sf), ["station_id"]))
