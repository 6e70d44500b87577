"""Source, sink, ledger and inventory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import normalize as nz
from airlake.plans.registry import query
from airlake.session import new_dir
from airlake.sources import grids, inventory, ledger as lg, readers, writers

R = F.round


@query("scan_city_hour_csv", "chx", """select city, state, t as observed_at_utc, temp as temp_2m_c, round(pm25,4) as pm25_ugm3, round(lat,4) as lat from chx""")
def scan_city_hour_csv(spark, sf):
    path = new_dir(spark, "city-hour")
    c = F.col
    src = fx.chx(spark, sf).select(
        c("city").cast("string").alias("City"), c("state").alias("State"), c("lat").alias("Latitude"), c("lon").alias("Longitude"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
        c("temp").alias("Temp_2m_C"), c("rh").alias("Humidity_Percent"), c("ws").alias("Wind_Speed_10m_kmh"), c("wd").alias("Wind_Dir_10m"), c("solar").alias("Solar_Radiation_Wm2"),
        c("cloud").alias("Cloud_Cover_Percent"), c("pm25").alias("PM2_5_ugm3"), c("pm10").alias("PM10_ugm3"), F.lit(None).cast("double").alias("CO_ugm3"), F.lit(None).cast("double").alias("NO2_ugm3"),
        F.lit(None).cast("double").alias("SO2_ugm3"), c("o3").alias("O3_ugm3"), c("aod").alias("AOD"), c("inv").alias("Temp_Inversion"), c("stag").alias("Wind_Stagnation"), c("crop").alias("Crop_Burning_Season"))
    src.write.option("header", True).csv(path)
    d = nz.to_hour(nz.trim_all(nz.canonicalize(readers.read_city_hour(spark, path))), "observed_at_utc")
    d = nz.coerce_numeric(d, ["temp_2m_c", "pm25_ugm3", "lat"])
    return d.select(F.col("city").cast("bigint").alias("city"), "state", "observed_at_utc", "temp_2m_c", R("pm25_ugm3", 4).alias("pm25_ugm3"), R("lat", 4).alias("lat"))


@query("scan_fires_union", "rawfire", """select case when satellite in ('NPP','NOAA-20') then 'snpp' else 'other' end as origin_file, cast(latitude as double) as latitude, cast(longitude as double) as longitude,
    acq_date, acq_time, try_cast(frp as double) as frp, confidence, trim(satellite) as satellite, daynight from rawfire""")
def scan_fires_union(spark, sf):
    base = new_dir(spark, "fires")
    f = fx.rawfire(spark, sf).select("latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", F.trim("satellite").alias("satellite"), F.lit("VIIRS").alias("instrument"), "confidence",
                                     F.lit("2.0").alias("version"), F.lit("300.1").alias("bright_ti5"), F.col("frp").try_cast("double").alias("frp"), "daynight")
    vi = F.col("satellite").isin("NPP", "NOAA-20")
    f.filter(vi).write.option("header", True).csv(f"{base}/snpp")
    f.filter(~vi).write.option("header", True).csv(f"{base}/other")
    return readers.read_fires(spark, base, origin="folder").drop("instrument")


DIGEST = """dg as (select o.seq, case o.seq%4 when 0 then concat(' ', upper(s.name)) when 3 then 'Unknown Town' else s.name end as location,
      case when o.seq%9=0 then '-' else strftime(o.observed_at_utc, '%d-%m-%Y') end as sampling_date, o.metric, o.value from obs o join stn s on s.station_id=o.station_id)"""


@query("wide_digest_to_long", "obs stn", f"""with {DIGEST} select s.station_id, strptime(sampling_date,'%d-%m-%Y') as observed_at_utc, metric, value, case metric when 'NO2' then 'ppb' when 'O3' then 'ppb' when 'CO' then 'mg/m3' else 'ug/m3' end as unit
    from dg join stn s on lower(trim(s.name))=lower(trim(dg.location)) where sampling_date<>'-'""")
def wide_digest_to_long(spark, sf):
    st = fx.stn(spark, sf)
    o = fx.obs(spark, sf).join(st.select("station_id", "name"), "station_id")
    k = F.col("seq") % 4
    cell = lambda m, c: F.when(F.col("metric") == m, F.col("value").cast("string")).otherwise("").alias(c)
    d = o.select(F.when(k == 0, F.concat(F.lit(" "), F.upper("name"))).when(k == 3, "Unknown Town").otherwise(F.col("name")).alias("location"),
                 F.when(F.col("seq") % 9 == 0, "-").otherwise(F.date_format("observed_at_utc", "dd-MM-yyyy")).alias("sampling_date"),
                 cell("PM2.5", "PM2.5"), cell("PM10", "PM10"), cell("O3", "OZONE"), cell("NO2", "NO2"), cell("CO", "CO"), F.lit("NA").alias("SO2"), F.lit(None).cast("string").alias("NH3"))
    return readers.digest_to_long(d, st.select("station_id", "name"))


@query("json_records_to_long", "rec", """with a as (select event_id as seq, user_id%50 as rid, case event_type when 'click' then 'PM2.5' when 'view' then 'PM10' when 'purchase' then 'O3' when 'signup' then 'NO2' end as metric,
      case when event_id%13=0 then null else value end as value, case when event_id%5=0 then timestamp '2024-02-01 00:00:00' else date_trunc('second', ts) end as observed_at_utc from events)
    select seq, rec.rec_id as station_id, metric, 'ug/m3' as unit, value, observed_at_utc from a join rec on rec.rec_id = a.rid where metric is not null and value is not null""")
def json_records_to_long(spark, sf):
    e = F.col("event_type")
    ids = F.when(e == "click", "PM2.5").when(e == "view", " pm10").when(e == "purchase", "OZONE").when(e == "signup", "NO2").otherwise("DEPOSIT")
    ev = fx.table(spark, sf, "events").withColumn("rec_id", F.col("user_id") % 50).join(fx.rec(spark, sf), "rec_id", "left")
    text = F.to_json(F.array(F.struct(
        F.lit("India").alias("country"), F.coalesce("station_text", F.lit("Elsewhere, nowhere")).alias("station"),
        F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm:ss")).alias("last_update"), ids.alias("pollutant_id"),
        F.when(F.col("event_id") % 13 == 0, "NA").otherwise(F.col("value").cast("string")).alias("avg_value"))))
    recs = readers.ogd_records(ev.select(F.col("event_id").alias("seq"), text.alias("body")), "body")
    return readers.ogd_to_long(recs, fx.stn(spark, sf), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))


@query("scan_registry", "stn", "select cast(station_id as varchar) as station_id, name, round(lat,4) as lat, round(lon,4) as lon, state, station_id%4=0 as is_manual, 'registry' as source from stn")
def scan_registry(spark, sf):
    path = new_dir(spark, "registry")
    k = F.col("station_id")
    flag = F.when(k % 4 == 0, F.when(k % 8 == 0, "TRUE").otherwise("true")).when(k % 4 == 1, "false").otherwise("")
    fx.stn(spark, sf).select(k.cast("string").alias("station_id"), "name", "lat", "lon", F.lit("d").alias("district"), "state", flag.alias("is_manual"),
                             F.lit("registry").alias("source")).write.option("header", True).csv(path)
    return readers.read_registry(spark, path).select("station_id", "name", R("lat", 4).alias("lat"), R("lon", 4).alias("lon"), "state", "is_manual", "source")


PART = """pt as (select case o_orderpriority when '1-URGENT' then 'firms' when '5-LOW' then 'gfs' else 'cpcb' end as source, cast(date_trunc('year', o_orderdate) as date) as dt,
    cast(o_custkey%4 as varchar) as run_id, o_orderkey as seq, o_totalprice as value from orders)"""


def partition_rows(spark, sf):
    p = F.col("o_orderpriority")
    return fx.table(spark, sf, "orders").select(
        F.when(p == "1-URGENT", "firms").when(p == "5-LOW", "gfs").otherwise("cpcb").alias("source"), F.date_trunc("year", "o_orderdate").cast("date").alias("dt"),
        (F.col("o_custkey") % 4).cast("string").alias("run_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))


PART_SCHEMA = "seq BIGINT, value DOUBLE, source STRING, dt DATE, run_id STRING"


@query("read_complete_partition", "", f"with {PART} select source, dt, run_id, seq, value from pt where source='cpcb' and dt=date '1998-01-01' and run_id='2'")
def read_complete_partition(spark, sf):
    base = new_dir(spark, "partitions")
    rows = partition_rows(spark, sf)
    writers.write_partition(rows, base)
    done = rows.select("source", "dt", "run_id").distinct().withColumn("complete", F.col("run_id") != "3")
    kept = writers.read_partition(spark, base, PART_SCHEMA, "cpcb", "1998-01-01", "2", done)
    open_run = writers.read_partition(spark, base, PART_SCHEMA, "cpcb", "1998-01-01", "3", done)
    return kept.unionByName(open_run).select("source", "dt", "run_id", "seq", "value")


@query("arrays_to_rows", "field", "select i, j, hour_idx as observed_at_utc, pm25/100 as aod from field where (hour_idx+i)%7<>0")
def arrays_to_rows(spark, sf):
    f = fx.field(spark, sf).withColumn("aod", F.when((F.col("hour_idx") + F.col("i")) % 7 != 0, F.col("pm25") / 100))
    arrays = f.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("hour_idx", "aod"))).alias("s")).select("i", "j", F.col("s.hour_idx").alias("time"), F.col("s.aod").alias("aod"))
    return readers.hourly_arrays_to_rows(arrays, "time", ["aod"])


@query("write_partition", "", f"with {PART} select source, dt, run_id, count(*) as n, round(sum(case when source='gfs' then value*2 else value end),2) as total from pt group by 1,2,3")
def write_partition(spark, sf):
    base = new_dir(spark, "partitions")
    rows = partition_rows(spark, sf)
    writers.write_partition(rows, base)
    again = rows.filter("source = 'gfs'").withColumn("value", F.col("value") * 2)
    writers.write_partition(again, base)  # same runs again: replaced, not doubled
    writers.write_partition(again.filter("false"), base)  # empty input leaves everything as it is
    return spark.read.schema(PART_SCHEMA).parquet(base).groupBy("source", "dt", "run_id").agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("total"))


@query("skip_completed_runs", "ledger", "select source, dt, run_id from ledger where not complete")
def skip_completed_runs(spark, sf):
    l = fx.ledger(spark, sf)
    return lg.pending_runs(l.select("source", "dt", "run_id"), l)


@query("write_lake_table", "asset", "select 'raw' as tier, 'asset' as tbl, count(*) as n_rows, 'seq,run_id,lead_h,variable,level_str,missing_fraction' as columns from asset union all select 'features', 'asset_late', count(*), 'seq,run_id,lead_h,variable,level_str,missing_fraction' from asset where lead_h>48")
def write_lake_table(spark, sf):
    root = new_dir(spark, "lake")
    a = fx.asset(spark, sf)
    writers.write_tier(a, root, "raw", "asset")
    writers.write_tier(a.filter("lead_h > 48"), root, "features", "asset_late")
    side = spark.read.schema("`table` STRING, tier STRING, rows BIGINT, columns STRING, written_at TIMESTAMP").option("recursiveFileLookup", True).json([f"{root}/raw/_meta/asset", f"{root}/features/_meta/asset_late"])
    return side.select("tier", F.col("table").alias("tbl"), F.col("rows").alias("n_rows"), "columns")


@query("publish_forecast_long", "field", "select hour_idx as time, i as station_id, round(lat,6) as lat, round(lon,6) as lon, pm25 as engine_pm25, pm25-5 as engine_lo, pm25+5 as engine_hi from field where j=0")
def publish_forecast_long(spark, sf):
    f = fx.field(spark, sf).filter("j = 0")
    arrays = f.groupBy(F.col("hour_idx").alias("time")).agg(F.sort_array(F.collect_list(F.struct("i", "pm25"))).alias("s")).select(
        "time", F.col("s.pm25").alias("engine_pm25"), F.transform("s", lambda x: x["pm25"] - 5).alias("engine_lo"), F.transform("s", lambda x: x["pm25"] + 5).alias("engine_hi"))
    stations = fx.grid(spark, sf).filter("j = 0").select(F.col("i").cast("int").alias("pos"), F.col("i").alias("station_id"), R("lat", 6).alias("lat"), R("lon", 6).alias("lon"))
    return readers.publish_forecast(arrays, stations, ["engine_pm25", "engine_lo", "engine_hi"]).select("time", "station_id", "lat", "lon", "engine_pm25", "engine_lo", "engine_hi")


@query("publish_grid_long", "field", "select hour_idx as time, i, j, round(lat,6) as lat, round(lon,6) as lon, pm25, ws from field")
def publish_grid_long(spark, sf):
    f = fx.field(spark, sf)
    rows = f.groupBy("hour_idx", "j").agg(F.sort_array(F.collect_list(F.struct("i", "pm25", "ws"))).alias("r"))
    nested = rows.groupBy(F.col("hour_idx").alias("time")).agg(F.sort_array(F.collect_list(F.struct("j", "r"))).alias("s")).select(
        "time", F.transform("s", lambda x: x["r"]["pm25"]).alias("pm25"), F.transform("s", lambda x: x["r"]["ws"]).alias("ws"))
    return readers.publish_grid(nested, fx.grid(spark, sf), ["pm25", "ws"]).select("time", "i", "j", R("lat", 6).alias("lat"), R("lon", 6).alias("lon"), "pm25", "ws")


@query("latest_partition", "ledger", """select 'latest' as kind, source, dt, run_id from (select *, row_number() over (partition by source order by dt desc, run_id desc) rn from ledger where complete) x where rn=1
    union all select 'newest', source, dt, run_id from (select * from ledger where complete and source='gfs' order by dt desc, run_id desc limit 10) y""")
def latest_partition(spark, sf):
    l = fx.ledger(spark, sf)
    a = lg.latest_partition(l).select(F.lit("latest").alias("kind"), "source", "dt", "run_id")
    return a.unionByName(lg.partitions(l, "gfs", descending=True, n=10).select(F.lit("newest").alias("kind"), "source", "dt", "run_id"))


@query("table_profile", "chx", """select 'city_hour' as tbl, count(*) as n_rows, min(t) as date_min, max(t) as date_max, round(min(lat),4) as lat_min, round(max(lat),4) as lat_max, round(min(lon),4) as lon_min, round(max(lon),4) as lon_max,
    round(100e0*(count(*)*18 - (count(city)+count(t)+count(pm25)+count(pm10)+count(o3)+count(ws)+count(rh)+count(lat)+count(lon)+count(state)+count(aod)+count(temp)+count(wd)+count(solar)+count(cloud)+count(inv)+count(stag)+count(crop)))/(count(*)*18),3) as missing_percentage from chx""")
def table_profile(spark, sf):
    return inventory.profile(fx.chx(spark, sf), "city_hour").select(F.col("table").alias("tbl"), "n_rows", "date_min", "date_max", "lat_min", "lat_max", "lon_min", "lon_max", "missing_percentage")


@query("file_inventory", "obs", """with c as (select cast(observed_at_utc as date) as d, station_id, metric, count(*) as n, cast(min(seq) as varchar) as a, cast(max(seq) as varchar) as b from obs group by 1, 2, 3),
    f as (select strftime(d, '%Y-%m-%d') as file, string_agg(concat(station_id, '|', metric, '|', n, '|', a, '|', b), chr(10) order by concat(station_id, '|', metric, '|', n, '|', a, '|', b)) || chr(10) as text from c group by d)
    select file, cast(strlen(text) as bigint) as length, sha256(text) as sha256 from f""")
def file_inventory(spark, sf):
    """Inventory of the daily station digests, one text file a day, which the query writes from the observations."""
    root = new_dir(spark, "digests")
    o = fx.obs(spark, sf)
    per = o.groupBy(F.to_date("observed_at_utc").alias("day"), "station_id", "metric").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"))
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("station_id", "metric", "n", "a", "b")])
    # a day has as many lines as stations and metrics, so its file is one task's work
    rows = per.select("day", line.alias("line")).repartition("day").sortWithinPartitions("day", "line")
    rows.write.partitionBy("day").text(root)
    files = inventory.inventory(spark, root).filter("path like '%/day=%'")
    return files.select(F.regexp_extract("path", "/day=([0-9-]+)/", 1).alias("file"), "length", "sha256")


@query("tier_sizes", "obs ch fc", """with c as (select 'raw' as tier, 1::bigint as tables, count(*) as n_rows from obs union all select 'processed', 1, count(*) from ch
      union all select 'features', 1, count(*) from fc union all select 'interim', 0, 0)
    select * from c union all select 'total', cast(sum(tables) as bigint), cast(sum(n_rows) as bigint) from c""")
def tier_sizes(spark, sf):
    root = new_dir(spark, "lake")
    writers.write_tier(fx.obs(spark, sf), root, "raw", "obs")
    writers.write_tier(fx.ch(spark, sf), root, "processed", "city_hour")
    writers.write_tier(fx.fc(spark, sf), root, "features", "forecast")
    return inventory.tier_tables(spark, root)


@query("schema_probe", "chx", """with s as (select * from chx order by t, city limit 2000) select count(*) as sample_rows, round(min(lat),6) as lat_min, round(max(lat),6) as lat_max, round(min(lon),6) as lon_min, round(max(lon),6) as lon_max, min(t) as time_min, max(t) as time_max,
    'city,t,pm25,pm10,o3,ws,rh,lat,lon,state,aod,temp,wd,solar,cloud,inv,stag,crop' as columns from s""")
def schema_probe(spark, sf):
    d = readers.probe(fx.chx(spark, sf), 2000, ["t", "city"])
    return d.select("sample_rows", *[R(c, 6).alias(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")], "time_min", "time_max", "columns")


@query("registry_upsert", "", """with u as (select o_orderpriority as source_name, o_orderkey as seq, case when o_orderkey%3=0 then o_orderstatus end as status, case when o_orderkey%5=0 then concat('v', o_custkey) end as version, o_orderdate as stamp from orders)
    select source_name, arg_max(status, seq) filter (where status is not null) as status, arg_max(version, seq) filter (where version is not null) as version, arg_max(stamp, seq) as stamp from u group by source_name""")
def registry_upsert(spark, sf):
    k = F.col("o_orderkey")
    u = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source_name"), k.alias("seq"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("status"),
                                             F.when(k % 5 == 0, F.concat(F.lit("v"), F.col("o_custkey").cast("string"))).alias("version"), F.col("o_orderdate").alias("stamp"))
    return inventory.upsert(u.filter("seq % 2 = 0"), u.filter("seq % 2 = 1"), "source_name", "seq")


@query("asset_manifest", "asset", """with r as (select distinct run_id from asset), v as (select distinct run_id, concat(lower(variable), ':', case level_str when 'O' then '850 mb' when 'F' then '2 m above ground' else '' end) as spec from asset),
      l as (select unnest(range(0,75,3)) as lead_h), av as (select run_id, lead_h, bool_or(missing_fraction<0.001) as ok from asset group by 1,2)
    select v.run_id, timestamp '2024-01-01 00:00:00' + to_hours(cast(v.run_id*6 as bigint)) as init, l.lead_h, timestamp '2024-01-01 00:00:00' + to_hours(cast(v.run_id*6 + l.lead_h as bigint)) as valid, upper(split_part(spec,':',1)) as variable,
      coalesce(nullif(split_part(spec,':',2),''),'surface') as level_str, case split_part(spec,':',2) when '850 mb' then 'pressure' else 'surface' end as level_kind,
      case when coalesce(ok,false) then 0e0 else 1e0 end as missing_fraction, case when coalesce(ok,false) then 'OK' else 'MISSING' end as quality_flag
    from v cross join l left join av on av.run_id=v.run_id and av.lead_h=l.lead_h""")
def asset_manifest(spark, sf):
    a = fx.asset(spark, sf)
    level = F.when(F.col("level_str") == "O", "850 mb").when(F.col("level_str") == "F", "2 m above ground").otherwise("")
    runs = a.select("run_id").distinct().withColumn("init", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), (F.col("run_id") * 6).cast("int")))
    specs = a.select("run_id", F.concat(F.lower("variable"), F.lit(":"), level).alias("spec")).distinct()
    avail = a.groupBy("run_id", "lead_h").agg(F.bool_or(F.col("missing_fraction") < 0.001).alias("available"))
    return readers.build_manifest(runs, list(range(0, 75, 3)), specs, avail)


@query("checksum_skip", "", """with f as (select o_orderkey%3000 as k, sha256(cast(o_custkey as varchar)) as s, cast(o_totalprice as bigint) as len, o_orderkey from orders), known as (select k, s from f where o_orderkey%4=0)
    select cast(k as varchar) as name, s as sha256, len as length from f where not exists (select 1 from known n where n.k=f.k and n.s=f.s)""")
def checksum_skip(spark, sf):
    o = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 3000).cast("string").alias("name"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("sha256"),
                                             F.bround("o_totalprice", 0).cast("bigint").alias("length"), "o_orderkey")
    return inventory.new_files(o, o.filter("o_orderkey % 4 = 0"), max_bytes=1 << 40).select("name", "sha256", "length")


@query("grid_table", "stn", """with b as (select state, floor(min(lat)*10)/10 as a0, ceil(max(lat)*10)/10 as a1, floor(min(lon)*10)/10 as o0, ceil(max(lon)*10)/10 as o1 from stn group by state),
    v as (select *, 'nodes' as variant, greatest(cast(round_even((o1-o0)*111.13e0*cos(radians((a0+a1)/2))/4,0) as bigint)+1,2) as nx, greatest(cast(round_even((a1-a0)*111.13e0/4,0) as bigint)+1,2) as ny from b
      union all select *, 'cells', cast(round_even((o1-o0)*111e0*cos(radians((a0+a1)/2))/4,0) as bigint), cast(round_even((a1-a0)*111e0/4,0) as bigint) from b)
    select variant, state, nx, ny, i.i, j.j, round(a0+j.j*(a1-a0)/greatest(ny-1,1),6) as lat, round(o0+i.i*(o1-o0)/greatest(nx-1,1),6) as lon from v, (select unnest(range(0,200)) as i) i, (select unnest(range(0,200)) as j) j where i.i<nx and j.j<ny""")
def grid_table(spark, sf):
    boxes = fx.stn(spark, sf).groupBy("state").agg((F.floor(F.min("lat") * 10) / 10).alias("lat_min"), (F.ceil(F.max("lat") * 10) / 10).alias("lat_max"),
                                                   (F.floor(F.min("lon") * 10) / 10).alias("lon_min"), (F.ceil(F.max("lon") * 10) / 10).alias("lon_max"))
    one = lambda v: grids.grid_table(boxes, 4.0, 4.0, v, ["state"]).select(F.lit(v).alias("variant"), "state", "nx", "ny", "i", "j", R("lat", 6).alias("lat"), R("lon", 6).alias("lon"))
    return one("nodes").unionByName(one("cells"))


@query("nested_series_to_long", "", """with a as (select event_id as seq, user_id%30 as station_id, value, event_id%3 as k, case when event_id%5=0 then timestamp '2024-02-01 00:00:00' else date_trunc('second', ts) end as t from events where event_id%7<>0)
    select seq, station_id, 'first' as mode, t as observed_at_utc, case k when 0 then 'NO2' when 1 then 'PM2.5' else 'O3' end as metric, value, case k when 1 then 'ug/m3' else 'ppb' end as unit from a
    union all select seq, station_id, 'all', t, case k when 0 then 'NO2' when 1 then 'PM2.5' else 'O3' end, value, case k when 1 then 'ug/m3' else 'ppb' end from a
    union all select seq, station_id, 'all', t, 'PM2.5', value+1, 'ug/m3' from a where k=0""")
def nested_series_to_long(spark, sf):
    k = F.col("event_id") % 3
    v = F.col("value").cast("string")
    item = F.struct(F.when(F.col("event_id") % 5 == 0, "").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm:ss")).alias("updated_at"), F.when(k == 0, v).alias("NO2"),
                    F.when(k == 1, v).when(k == 0, (F.col("value") + 1).cast("string")).alias("PM2.5"), F.when(k == 2, v).alias("OZONE"), F.lit("-").alias("CO"))
    body = F.to_json(F.struct((F.col("event_id") % 7 != 0).alias("success"), F.struct(F.array(item).alias("series"), F.array().cast("array<struct<updated_at:string>>").alias("empty")).alias("data")))
    d = fx.table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 30).alias("station_id"), body.alias("body"))
    asof = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    one = lambda m, f: readers.series_to_long(d, "body", asof, f).select("seq", "station_id", F.lit(m).alias("mode"), "observed_at_utc", "metric", "value", "unit")
    return one("first", True).unionByName(one("all", False))
