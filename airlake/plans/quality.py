"""Quality-control queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airlake import fixtures as fx
from airlake.functions.timing import hour_floor
from airlake.operators import qc
from airlake.operators.normalize import normalize_fires
from airlake.plans.normalize import NORM_SQL
from airlake.plans.registry import query


@query("dedupe_keep_last", "obs", """with a as (select *, date_trunc('hour', observed_at_utc) as t from obs)
    select station_id, t, seq, metric, value from (select *, row_number() over (partition by t, station_id order by seq desc) rn from a) x where rn=1""")
def dedupe_keep_last(spark, sf):
    d = fx.obs(spark, sf).withColumn("t", hour_floor(F.col("observed_at_utc")))
    return qc.keep_last(d, ["t", "station_id"], "seq").select("station_id", "t", "seq", "metric", "value")


@query("dedupe_keep_first", "asset", """select run_id, lead_h, variable, level_str, seq from
    (select *, row_number() over (partition by run_id, lead_h, variable, level_str order by seq) rn from asset) x where rn=1""")
def dedupe_keep_first(spark, sf):
    return qc.keep_first(fx.asset(spark, sf), ["run_id", "lead_h", "variable", "level_str"], "seq").select("run_id", "lead_h", "variable", "level_str", "seq")


@query("range_flag", "ch", """select city, t, coalesce(pm25<5 or pm25>200,false) or coalesce(pm10<5 or pm10>200,false) or coalesce(o3<5 or o3>200,false) as is_invalid from ch""")
def range_flag(spark, sf):
    return fx.ch(spark, sf).select("city", "t", qc.range_flag(["pm25", "pm10", "o3"], 5, 200).alias("is_invalid"))


MAD_SQL = """m1 as (select *, median(value) over (partition by station_id, metric) as med, count(*) over (partition by station_id, metric) as n from obs),
    m2 as (select *, median(abs(value-med)) over (partition by station_id, metric) as mad from m1)"""


@query("mad_spike_flag", "obs", f"""with {MAD_SQL} select seq, station_id, metric, value,
    coalesce(case when mad=0 then value<>med else abs(value-med)/(1.4826e0*mad) > 5 end, false) as is_spike,
    n>=3 and abs(value-med)/(1.4826e0*(case when mad=0 then 1 else mad end)) > 3 as is_spike_lenient from m2""")
def mad_spike_flag(spark, sf):
    d = qc.with_spike_stats(fx.obs(spark, sf), ["station_id", "metric"], "value")
    args = [F.col(c) for c in ("value", "med", "mad", "n")]
    return d.select("seq", "station_id", "metric", "value", qc.spike(*args).alias("is_spike"), qc.spike(*args, sigma=3.0, mode="lenient").alias("is_spike_lenient"))


def wide_obs(spark, sf):
    m, v = F.col("metric"), F.col("value")
    return fx.obs(spark, sf).select(
        "seq", "station_id", F.date_trunc("minute", "observed_at_utc").cast("timestamp_ntz").alias("ts"),
        F.when(m == "PM2.5", v).alias("pm25"), F.when(m == "PM10", v).alias("pm10"), F.when(m == "O3", v).alias("o3"))


WIDE_SQL = """wo as (select seq, station_id, date_trunc('minute', observed_at_utc) as ts, case when metric='PM2.5' then value end as pm25,
      case when metric='PM10' then value end as pm10, case when metric='O3' then value end as o3 from obs),
    dd as (select seq, station_id, date_trunc('hour', ts) as ts, pm25, pm10, o3 from (select *, row_number() over (partition by ts, station_id order by seq desc) rn from wo) x where rn=1),
    md as (select *, median(pm25) over w as a1, median(pm10) over w as a2, median(o3) over w as a3 from dd window w as (partition by station_id)),
    ma as (select *, median(abs(pm25-a1)) over w as b1, median(abs(pm10-a2)) over w as b2, median(abs(o3-a3)) over w as b3 from md window w as (partition by station_id)),
    fl as (select *, coalesce(pm25<0 or pm25>300,false) as r1, coalesce(pm10<0 or pm10>300,false) as r2, coalesce(o3<0 or o3>300,false) as r3,
      coalesce(case when b1=0 then pm25<>a1 else abs(pm25-a1)/(1.4826e0*b1)>5 end,false) as s1,
      coalesce(case when b2=0 then pm10<>a2 else abs(pm10-a2)/(1.4826e0*b2)>5 end,false) as s2,
      coalesce(case when b3=0 then o3<>a3 else abs(o3-a3)/(1.4826e0*b3)>5 end,false) as s3 from ma),
    fx as (select *, r1 or r2 or r3 or s1 or s2 or s3 as bad from fl)"""


@query("station_clean", "obs", f"with {WIDE_SQL} select case when bad then 'dropped' else 'kept' end as part, seq, station_id, ts, pm25, pm10, o3 from fx")
def station_clean(spark, sf):
    flagged = qc.station_flags(wide_obs(spark, sf), "station_id", "ts", "seq", hi=300)
    return flagged.select(F.when(F.col("is_invalid"), "dropped").otherwise("kept").alias("part"), "seq", "station_id", "ts", "pm25", "pm10", "o3")


@query("qc_report", "obs", f"""with {WIDE_SQL} select 'stations' as source, (select count(*) from wo) as total_rows, count(*) filter (where not bad) as valid_rows,
    cast(sum(cast(pm25 is null as int)+cast(pm10 is null as int)+cast(o3 is null as int)) as bigint) as missing_rows,
    (select count(*) from wo) - count(*) as duplicate_rows, cast(sum(cast(r1 as int)+cast(r2 as int)+cast(r3 as int)) as bigint) as invalid_rows,
    round(100e0*sum(cast(pm25 is null as int)+cast(pm10 is null as int)+cast(o3 is null as int))/(select count(*) from wo),3) as missing_percentage,
    count(distinct station_id) filter (where not bad) as stations, min(ts) filter (where not bad) as t_start, max(ts) filter (where not bad) as t_end,
    count(distinct ts) filter (where not bad) as n_hours,
    concat_ws(',', case when bool_or(r1) then 'pm25' end, case when bool_or(r2) then 'pm10' end, case when bool_or(r3) then 'o3' end,
      case when bool_or(s1) then 'pm25_spike' end, case when bool_or(s2) then 'pm10_spike' end, case when bool_or(s3) then 'o3_spike' end) as flagged_columns,
    case when count(*) filter (where not bad)=0 then 'FAIL' when 100e0*sum(cast(pm25 is null as int)+cast(pm10 is null as int)+cast(o3 is null as int))/(select count(*) from wo) > 30 then 'DEGRADED' else 'OK' end as status
    from fx""")
def qc_report(spark, sf):
    before = wide_obs(spark, sf)
    flagged = qc.station_flags(before, "station_id", "ts", "seq", hi=300)
    return qc.qc_report(before, flagged, "stations", "station_id", "ts", ["pm25", "pm10", "o3"])


CLEAN_SQL = """fcl as (select *, try_strptime(acq_date,'%Y-%m-%d') + to_hours(acq_time//100) as hr, cast(latitude as double) as la, cast(longitude as double) as lo,
      try_cast(frp as double) as p, try_cast(regexp_extract(confidence, '(\\d+)', 1) as integer) as c from rawfire)"""


@query("fire_clean", "rawfire", f"""with {CLEAN_SQL} select ok, ln, hr as observed_at_utc, la as latitude, lo as longitude, p as frp, coalesce(c,20) as confidence
    from fcl where hr is not null and la between -90 and 90 and lo between -180 and 180 and p between 0 and 5000 and (c is null or c>=20)""")
def fire_clean(spark, sf):
    return qc.clean_fires(fx.rawfire(spark, sf)).select("ok", "ln", "observed_at_utc", "latitude", "longitude", "frp", "confidence")


@query("fire_report", "rawfire", f"""with {CLEAN_SQL}, k as (select *, hr is not null and coalesce(la between -90 and 90 and lo between -180 and 180, false) and coalesce(p between 0 and 5000, false) and coalesce(c >= 20, true) as good,
      cast(hr is null as int) + cast(not coalesce(p between 0 and 5000, false) as int) + cast(coalesce(c < 20, false) as int) as bad from fcl)
    select 'fires' as source, count(*) as total_rows, count(*) filter (where good) as valid_rows, cast(sum(bad) as bigint) as invalid_rows, round(100e0*sum(bad)/count(*),3) as missing_percentage,
      min(hr) filter (where good) as t_start, max(hr) filter (where good) as t_end, count(distinct hr) filter (where good) as n_hours, round(min(la) filter (where good),4) as lat_min, round(max(la) filter (where good),4) as lat_max,
      round(min(lo) filter (where good),4) as lon_min, round(max(lo) filter (where good),4) as lon_max, case when count(*) filter (where good)=0 then 'FAIL' else 'OK' end as status from k""")
def fire_report(spark, sf):
    return qc.fire_report(fx.rawfire(spark, sf))


@query("drop_reasons", "obs rawfire asset", f"""with {NORM_SQL},
    a as (select case when value < 1 then 'below_lower_bound' when value > 250 then 'above_physical_ceiling' else 'kept' end as reason from obs),
    b as (select case when rn>1 then 'duplicate_fire_id' when not (frp_mw between 0 and 40) then 'frp_out_of_range' when confidence_percent < 20 then 'low_confidence' else 'kept' end as reason
      from (select *, row_number() over (partition by fire_id order by ok*10+ln) rn from nf) x),
    c as (select case when rn>1 then 'duplicate_asset' when missing_fraction > 0.05 then 'excessive_missing_data' else 'kept' end as reason
      from (select *, row_number() over (partition by run_id, lead_h, variable, level_str order by seq) rn from asset) x)
    select 'stations' as feed, reason, count(*) as n from a group by reason union all select 'fires', reason, count(*) from b group by reason
    union all select 'assets', reason, count(*) from c group by reason""")
def drop_reasons(spark, sf):
    o = qc.drop_reasons(fx.obs(spark, sf), [("below_lower_bound", F.col("value") < 1), ("above_physical_ceiling", F.col("value") > 250)])
    f = normalize_fires(fx.rawfire(spark, sf)).withColumn("seq", F.col("ok") * 10 + F.col("ln"))
    f = qc.drop_reasons(qc.mark_duplicates(f, ["fire_id"], "seq"), [
        ("duplicate_fire_id", F.col("is_duplicate")), ("frp_out_of_range", ~F.col("frp_mw").between(0, 40)),
        ("low_confidence", F.col("confidence_percent") < 20)])
    a = qc.drop_reasons(qc.mark_duplicates(fx.asset(spark, sf), ["run_id", "lead_h", "variable", "level_str"], "seq"), [
        ("duplicate_asset", F.col("is_duplicate")), ("excessive_missing_data", F.col("missing_fraction") > qc.MAX_MISSING)])
    tag = lambda d, n: d.select(F.lit(n).alias("feed"), "reason", "n")
    return tag(o, "stations").unionByName(tag(f, "fires")).unionByName(tag(a, "assets"))


@query("station_uptime", "obs", "select station_id, date_trunc('month', observed_at_utc) as month, count(*) as n from obs group by all")
def station_uptime(spark, sf):
    return qc.station_uptime(fx.obs(spark, sf), "station_id", "observed_at_utc")


@query("critical_gate", "ch", "select city, t from ch where pm25 is not null")
def critical_gate(spark, sf):
    from airlake.session import new_dir
    from airlake.sources.writers import write_gated

    d, path = fx.ch(spark, sf).filter("pm25 is not null").select("city", "t"), new_dir(spark, "gate")
    write_gated(d, path, 1, "stations")
    return spark.read.schema(d.schema).parquet(path)


@query("missing_fraction_gate", "asset", "select seq, run_id, missing_fraction from asset where missing_fraction <= 0.05")
def missing_fraction_gate(spark, sf):
    return qc.max_missing(fx.asset(spark, sf)).select("seq", "run_id", "missing_fraction")


@query("coverage_gate", "obs stn", """select count(*) as n_stations, count(o.station_id) as n_reporting, count(o.station_id)/count(*)::double as coverage,
    count(o.station_id)/count(*)::double >= 0.6 as passed from stn left join (select distinct station_id from obs) o on o.station_id = stn.station_id""")
def coverage_gate(spark, sf):
    return qc.coverage(fx.obs(spark, sf), fx.stn(spark, sf))


@query("ingest_fires", "rawfire", f"""with {NORM_SQL},
    b as (select lat, case when rn>1 then 'duplicate_fire_id' when not (frp_mw between 0 and 40) then 'frp_out_of_range' when confidence_percent < 20 then 'low_confidence' end as reason
      from (select *, row_number() over (partition by fire_id order by ok*10+ln) rn from nf) x)
    select 'dropped' as part, reason as name, count(*) as n from b where reason is not null group by reason union all select 'stored', 'rows', count(*) from b where reason is null
    union all select 'ledger', 'kept', count(*) from b where reason is null union all select 'ledger', 'runs', 1 union all select 'again', 'skipped', 1""")
def ingest_fires(spark, sf):
    f = normalize_fires(fx.rawfire(spark, sf)).withColumn("seq", F.col("ok") * 10 + F.col("ln"))
    f = qc.mark_duplicates(f, ["fire_id"], "seq")
    return _run_twice(spark, f, "fires", "2024-01-01T0000Z-firms-poll", [
        ("duplicate_fire_id", F.col("is_duplicate")), ("frp_out_of_range", ~F.col("frp_mw").between(0, 40)), ("low_confidence", F.col("confidence_percent") < 20)])


def _run_twice(spark, records, source: str, run_id: str, rules) -> DataFrame:
    """What a run dropped, stored and entered, and that its repetition is skipped."""
    from airlake.session import new_dir
    from airlake.sources.ingest import ingest_run, read_ledger

    base, ledger = new_dir(spark, "ingest"), new_dir(spark, "ledger")
    first, again = (ingest_run(records, rules, base, ledger, source, "2024-01-01", run_id) for _ in range(2))
    one = lambda part, name, df: df.select(F.lit(part).alias("part"), F.lit(name).alias("name"), "n")
    told = spark.createDataFrame([("dropped", k, n) for k, n in sorted(first.reasons.items())] + [("again", "skipped", int(again.skipped))], "part string, name string, n long")
    stored = spark.read.schema("source string, dt date, run_id string").parquet(base).filter((F.col("source") == source) & (F.col("run_id") == run_id)).agg(F.count("*").alias("n"))
    entered = read_ledger(spark, ledger)
    return told.unionByName(one("stored", "rows", stored)).unionByName(one("ledger", "kept", entered.agg(F.sum("kept").alias("n")))).unionByName(
        one("ledger", "runs", entered.agg(F.count("*").alias("n"))))


_RUN_SQL = """select 'dropped' as part, reason as name, count(*) as n from b where reason is not null group by reason union all select 'stored', 'rows', count(*) from b where reason is null
    union all select 'ledger', 'kept', count(*) from b where reason is null union all select 'ledger', 'runs', 1 union all select 'again', 'skipped', 1"""


@query("ingest_stations", "obs", f"""with b as (select case when value < 1 then 'below_lower_bound' when value > 250 then 'above_physical_ceiling'
    when seq % 50 = 0 then 'marked_missing' end as reason from obs) {_RUN_SQL}""")
def ingest_stations(spark, sf):
    o = fx.obs(spark, sf).withColumn("quality_flag", F.when(F.col("seq") % 50 == 0, "MISSING").otherwise("OK"))
    return _run_twice(spark, o, "cpcb", "2024-01-01T0000Z-cpcb-poll", [
        ("below_lower_bound", F.col("value") < 1), ("above_physical_ceiling", F.col("value") > 250), ("marked_missing", F.col("quality_flag") == "MISSING")])


@query("ingest_assets", "asset", f"""with b as (select case when rn>1 then 'duplicate_asset' when missing_fraction > 0.05 then 'excessive_missing_data' end as reason
    from (select *, row_number() over (partition by run_id, lead_h, variable, level_str order by seq) rn from asset) x) {_RUN_SQL}""")
def ingest_assets(spark, sf):
    a = qc.mark_duplicates(fx.asset(spark, sf).withColumnRenamed("run_id", "cycle"), ["cycle", "lead_h", "variable", "level_str"], "seq")
    return _run_twice(spark, a, "gfs", "gfs.2024-01-01.00z", [
        ("duplicate_asset", F.col("is_duplicate")), ("excessive_missing_data", F.col("missing_fraction") > qc.MAX_MISSING)])
