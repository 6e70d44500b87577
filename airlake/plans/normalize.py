"""Projection, coercion and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.functions import aqi, geo, timing
from airlake.functions.numeric import to_double
from airlake.operators import normalize as nz
from airlake.plans.registry import query


def wide_source(spark, sf):
    """City-hour rows under the source headers, with columns to drop."""
    return fx.chx(spark, sf).select(
        F.col("city").alias("City"), F.col("state").alias("State"), F.col("t").alias("Datetime"), F.col("lat").alias("Latitude"),
        F.col("pm25").alias("PM2_5_ugm3"), F.col("pm10").alias("PM10_ugm3"), F.col("temp").alias("Temp_2m_C"),
        F.col("ws").alias("Wind_Speed_10m_kmh"), F.lit(None).cast("double").alias("Temp_80m_C"), F.year("t").alias("Year"),
        F.lit(None).cast("double").alias("Wind_Speed_80m_kmh"), F.col("rh").alias("Wind_Speed_120m_kmh"))


@query("canonical_rename", "chx", """select city, state, t as observed_at_utc, round(lat,6) as lat, round(pm25,6) as pm25_ugm3, round(pm10,6) as pm10_ugm3,
    temp as temp_2m_c, round(ws,6) as ws_kmh, cast(null as double) as ws80_kmh, round(rh,6) as ws120_kmh from chx""")
def canonical_rename(spark, sf):
    d = nz.canonicalize(wide_source(spark, sf))
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("drop_all_null_columns", "chx", "select city, t, round(rh,6) as ws120_kmh from chx")
def drop_all_null_columns(spark, sf):
    d = nz.canonicalize(wide_source(spark, sf)).select("city", F.col("observed_at_utc").alias("t"), "ws80_kmh", F.round("ws120_kmh", 6).alias("ws120_kmh"))
    return nz.drop_all_null(d, ["ws80_kmh", "ws120_kmh", "aqi_category_num"])


@query("coerce_numeric", "rawfire", "select ok, ln, try_cast(frp as double) as frp, try_cast(bright_ti4 as double) as bright_ti4 from rawfire")
def coerce_numeric(spark, sf):
    return nz.coerce_numeric(fx.rawfire(spark, sf), ["frp", "bright_ti4"]).select("ok", "ln", "frp", "bright_ti4")


@query("trim_strings", "rawfire", "select ok, ln, trim(satellite) as satellite, trim(daynight) as daynight from rawfire")
def trim_strings(spark, sf):
    return nz.trim_all(fx.rawfire(spark, sf).select("ok", "ln", "satellite", "daynight"))


@query("hourly_utc", "obs", """with a as (select seq, case when seq%11=0 then 'not a time' else strftime(observed_at_utc, '%Y-%m-%d %H:%M:%S') end as stamp from obs)
    select seq, date_trunc('hour', try_cast(stamp as timestamp)) as stamp from a where try_cast(stamp as timestamp) is not null""")
def hourly_utc(spark, sf):
    d = fx.obs(spark, sf).select("seq", F.when(F.col("seq") % 11 == 0, "not a time").otherwise(
        F.date_format("observed_at_utc", "yyyy-MM-dd HH:mm:ss")).alias("stamp"))
    return nz.to_hour(d, "stamp")


RAW_ID = """case event_type when 'click' then 'PM2.5' when 'view' then ' pm10' when 'purchase' then 'Ozone ' when 'signup' then 'NO2' else 'DEPOSIT' end"""


def raw_ids(spark, sf):
    e = F.col("event_type")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "value",
        F.when(e == "click", "PM2.5").when(e == "view", " pm10").when(e == "purchase", "Ozone ").when(e == "signup", "NO2").otherwise("DEPOSIT").alias("pollutant_id"))


@query("map_metric_unit", "", f"""with a as (select event_id as seq, upper(trim({RAW_ID})) as p from events)
    select seq, 'ogd' as feed, case p when 'OZONE' then 'O3' else p end as metric, 'ug/m3' as unit from a where p<>'DEPOSIT'
    union all select seq, 'digest', p, case when p='NO2' then 'ppb' else 'ug/m3' end from a where p in ('PM2.5','PM10','NO2')""")
def map_metric_unit(spark, sf):
    d = raw_ids(spark, sf)
    own = {k: k for k in nz.DIGEST_METRICS}
    a = nz.map_metric(d, "pollutant_id", nz.OGD_METRICS, nz.OGD_UNITS).select("seq", F.lit("ogd").alias("feed"), "metric", "unit")
    b = nz.map_metric(d, "pollutant_id", own, nz.DIGEST_UNITS).select("seq", F.lit("digest").alias("feed"), "metric", "unit")
    return a.unionByName(b)


@query("parse_dayfirst", "obs", """with a as (select seq, case seq%5 when 0 then strftime(observed_at_utc, '%d-%m-%Y %H:%M:%S') when 1 then strftime(observed_at_utc, '%d/%m/%Y')
      when 2 then '-' when 3 then '' else 'soon' end as s from obs)
    select seq, coalesce(try_strptime(s,'%d-%m-%Y %H:%M:%S'), try_strptime(s,'%d/%m/%Y')) as parsed from a""")
def parse_dayfirst(spark, sf):
    t, k = F.col("observed_at_utc"), F.col("seq") % 5
    s = F.when(k == 0, F.date_format(t, "dd-MM-yyyy HH:mm:ss")).when(k == 1, F.date_format(t, "dd/MM/yyyy")).when(k == 2, "-").when(k == 3, "").otherwise("soon")
    return fx.obs(spark, sf).select("seq", timing.parse_dayfirst(s).alias("parsed"))


NORM_SQL = """nf as (select concat_ws('|', sat, acq_date, acq_time, latitude, longitude, scan, track) as fire_id, sat as satellite,
      cast(latitude as double) as lat, cast(longitude as double) as lon,
      try_strptime(acq_date,'%Y-%m-%d') + to_hours(acq_time//100) + to_minutes(acq_time%100) as acq,
      greatest(0e0, coalesce(try_cast(frp as double),0)) as frp_mw, coalesce(try_cast(bright_ti4 as double), 350) as brightness_kelvin,
      try_cast(replace(confidence,'%','') as double) as confidence_percent, 0.4e0 as scan_km, 0.5e0 as track_km,
      case when upper(trim(daynight)) like 'N%' then 'N' else 'D' end as day_night,
      case when try_cast(replace(confidence,'%','') as double) >= 20 then 'OK' else 'SUSPECT' end as quality_flag, ok, ln, pk
    from (select *, case upper(trim(satellite)) when 'NPP' then 'VIIRS_SNPP' when 'NOAA-20' then 'VIIRS_NOAA20' when 'NOAA-21' then 'VIIRS_NOAA20'
      when 'AQUA' then 'MODIS_AQUA' when 'TERRA' then 'MODIS_TERRA' end as sat from rawfire) x where sat is not null)"""


@query("fire_normalize", "rawfire", f"with {NORM_SQL} select * from nf")
def fire_normalize(spark, sf):
    return nz.normalize_fires(fx.rawfire(spark, sf))


@query("quality_flag", "rawfire", """select ok, ln, case when try_cast(replace(confidence,'%','') as double) >= 20 then 'OK' else 'SUSPECT' end as fire_flag,
    case when pk%3=0 then 'MISSING' else 'OK' end as asset_flag from rawfire""")
def quality_flag(spark, sf):
    return fx.rawfire(spark, sf).select("ok", "ln", nz.quality_flag(F.col("confidence")).alias("fire_flag"),
                                        nz.availability_flag(F.col("pk") % 3 != 0).alias("asset_flag"))


@query("bbox_filter", "fire", """select ok, ln, 'region' as box from fire where lat between 27.5 and 33 and lon between 73.5 and 78.8
    union all select ok, ln, 'ncr' from fire where lat between 28.4 and 29.1 and lon between 76.7 and 77.5
    union all select ok, ln, 'north' from fire where lat >= 30""")
def bbox_filter(spark, sf):
    f = fx.fire(spark, sf)
    tag = lambda d, n: d.select("ok", "ln", F.lit(n).alias("box"))
    return (tag(nz.bbox(f, "lat", "lon", **geo.REGION_BOX), "region").unionByName(tag(nz.bbox(f, "lat", "lon", **geo.NCR_BOX), "ncr"))
            .unionByName(tag(nz.bbox(f, "lat", "lon", lat_min=30), "north")))


@query("in_domain_flag", "fire", "select ok, ln, lat between 28.4-0.2 and 29.1+0.2 and lon between 76.7-0.2 and 77.5+0.2 as in_domain from fire")
def in_domain_flag(spark, sf):
    return fx.fire(spark, sf).select("ok", "ln", geo.padded_box_flag(F.col("lat"), F.col("lon")).alias("in_domain"))


@query("level_kind", "", """with a as (select o_orderkey as seq, case o_orderkey%5 when 0 then '2 m Above Ground' when 1 then '850 mb' when 2 then 'mean sea level'
      when 3 then '925 hPa' else 'hybrid 3' end as l from orders)
    select seq, case when lower(l) like '%surface%' or lower(l) like '%above ground%' or lower(l) like '%mean sea level%' then 'surface'
      when lower(l) like '%mb%' or lower(l) like '%hpa%' then 'pressure' else 'model_level' end as kind from a""")
def level_kind(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "2 m Above Ground").when(k == 1, "850 mb").when(k == 2, "mean sea level").when(k == 3, "925 hPa").otherwise("hybrid 3")
    return fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), nz.level_kind(text).alias("kind"))


@query("split_spec", "", """with a as (select o_orderkey as seq, case o_orderkey%4 when 0 then 'tmp:850 mb' when 1 then ' PRMSL' when 2 then 'rh: 2 m above ground' else 'ugrd:' end as s from orders)
    select seq, upper(trim(split_part(s,':',1))) as variable, coalesce(nullif(trim(split_part(s,':',2)),''),'surface') as level_str from a""")
def split_spec(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "tmp:850 mb").when(k == 1, " PRMSL").when(k == 2, "rh: 2 m above ground").otherwise("ugrd:")
    d = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), text.alias("s"))
    var, level = nz.split_spec(F.col("s"))
    return d.select("seq", var.alias("variable"), level.alias("level_str"))


@query("species_alias", "", """select event_id as seq, case event_type when 'click' then 'PM2.5' when 'view' then 'PM10' when 'purchase' then 'NO2' when 'signup' then 'CO' else 'error' end as pollutant from events""")
def species_alias(spark, sf):
    e = F.col("event_type")
    key = F.when(e == "click", "pm25").when(e == "view", "pm10").when(e == "purchase", "nox").when(e == "signup", "co").otherwise(e)
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("seq"), aqi.species_alias(key).alias("pollutant"))


@query("run_id_for", "obs", """select seq, strftime(observed_at_utc, '%Y-%m-%dT%H%MZ-cpcb-poll') as poll_id,
    concat('gfs.', strftime(observed_at_utc, '%Y-%m-%d'), '.', lpad(cast(hour(observed_at_utc)//6*6 as varchar), 2, '0'), 'z') as cycle_id from obs""")
def run_id_for(spark, sf):
    t = F.col("observed_at_utc")
    return fx.obs(spark, sf).select("seq", timing.run_id(t, "cpcb").alias("poll_id"), timing.run_id(t, "gfs").alias("cycle_id"))
