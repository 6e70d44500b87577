"""Monitoring views over the driver's test tables (FIXTURES.md), for Spark and as SQL text.

Each view exists twice on purpose: as a DataFrame for the library and as a plain
SELECT for the independent check in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from airlake import schemas
from airlake.functions.timing import hour_floor, ntz


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    reader = spark.read
    if name in schemas.TABLES:
        reader = reader.schema(schemas.TABLES[name])
    return reader.parquet(f"{sf}/{name}.parquet")


def _city_lat(key: Column) -> Column:
    return F.lit(28.2) + F.lit(0.8) * ((key * 37) % 101) / F.lit(100)


def _city_lon(key: Column) -> Column:
    return F.lit(76.8) + F.lit(0.8) * ((key * 61) % 101) / F.lit(100)


def stn(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return (
        table(spark, sf, "supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("station_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("state"),
            _city_lat(F.col("s_suppkey")).alias("lat"),
            _city_lon(F.col("s_suppkey")).alias("lon"),
        )
    )


def rec(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return (
        table(spark, sf, "supplier")
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("rec_id"),
            F.concat(F.lit("Ring road "), "s_name", F.lit(" east, "), "n_name", F.lit(" - Board")).alias("station_text"),
        )
    )


def metric_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "click", "PM2.5").when(event_type == "view", "PM10")
        .when(event_type == "purchase", "O3").when(event_type == "signup", "NO2").otherwise("CO")
    )


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 30).alias("station_id"),
        metric_of(F.col("event_type")).alias("metric"),
        "value",
        F.col("ts").alias("observed_at_utc"),
    )


def ch(spark: SparkSession, sf: str) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    return (
        table(spark, sf, "events")
        .groupBy((F.col("user_id") % 10).alias("city"), hour_floor(F.col("ts")).alias("t"))
        .agg(
            F.avg(F.when(e == "click", v)).alias("pm25"),
            F.avg(F.when(e == "view", v)).alias("pm10"),
            F.avg(F.when(e == "purchase", v)).alias("o3"),
            F.avg(F.when(e == "signup", v / 4)).alias("ws"),
            F.avg(F.when(e == "error", v / 4)).alias("rh"),
        )
    )


def chx(spark: SparkSession, sf: str) -> DataFrame:
    """City-hour frame with place, weather and regime columns."""
    c, h = F.col("city"), F.hour("t")
    return ch(spark, sf).select(
        "*",
        _city_lat(c).alias("lat"),
        _city_lon(c).alias("lon"),
        F.concat(F.lit("S"), (c % 3).cast("string")).alias("state"),
        (F.col("o3") / 100).alias("aod"),
        (F.lit(5.0) + (c * 7 + h) % 25).alias("temp"),
        (F.lit(0.0) + (c * 37 + h * 15) % 360).alias("wd"),
        (F.lit(0.0) + (h * 53 + c * 11) % 800).alias("solar"),
        (F.lit(0.0) + (h * 7 + c * 13) % 100).alias("cloud"),
        F.when(F.col("rh") > 15, 1).otherwise(0).alias("inv"),
        F.when(F.col("ws") < 10, 1).otherwise(0).alias("stag"),
        F.when(F.dayofmonth("t") >= 20, 1).otherwise(0).alias("crop"),
    )


def fire(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        (F.lit(27.0) + F.lit(6.5) * ((F.col("l_partkey") * 13) % 1000) / 1000).alias("lat"),
        (F.lit(73.0) + F.lit(6.5) * ((F.col("l_suppkey") * 29 + F.col("l_linenumber") * 7) % 1000) / 1000).alias("lon"),
        (F.col("l_quantity") * F.col("l_tax") * 100).alias("frp"),
        F.when(F.col("l_returnflag") == "N", "nominal").when(F.col("l_returnflag") == "A", "15")
        .otherwise("90").alias("confidence"),
        (F.col("l_orderkey") % 720).alias("acq_h"),
    )


def fire_t(spark: SparkSession, sf: str) -> DataFrame:
    """Detections with an acquisition time and an id."""
    return fire(spark, sf).select(
        F.concat_ws("|", F.col("ok").cast("string"), F.col("ln").cast("string")).alias("fire_id"),
        "lat", "lon", "frp", "confidence", "acq_h",
        F.expr("timestampadd(MINUTE, cast(acq_h * 60 + ln * 7 as int), timestamp_ntz'2024-01-01 00:00:00')").alias("acq"),
    )


def rawfire(spark: SparkSession, sf: str) -> DataFrame:
    """Fire export rows as text, the way the satellite files hold them."""
    ln = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        (F.lit(27.0) + F.lit(6.5) * ((F.col("l_partkey") * 13) % 1000) / 1000).cast("decimal(9,4)").cast("string").alias("latitude"),
        (F.lit(73.0) + F.lit(6.5) * ((F.col("l_suppkey") * 29 + ln * 7) % 1000) / 1000).cast("decimal(9,4)").cast("string").alias("longitude"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("acq_date"),
        ((F.col("l_orderkey") % 24) * 100 + (ln * 7) % 60).cast("int").alias("acq_time"),
        F.when(ln == 1, "NPP").when(ln == 2, "NOAA-20").when(ln == 3, " aqua").when(ln == 4, "Terra")
        .when(ln == 5, "noaa-21").otherwise("GOES").alias("satellite"),
        F.when(F.col("l_returnflag") == "N", "nominal").when(F.col("l_returnflag") == "A", "15")
        .otherwise("90%").alias("confidence"),
        F.when(F.col("l_suppkey") % 10 == 0, "n/a").when(F.col("l_suppkey") % 10 == 1, "-2.5")
        .otherwise((F.col("l_quantity").cast("int")).cast("string")).alias("frp"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("string")).otherwise("331.5").alias("bright_ti4"),
        F.lit("0.4").alias("scan"),
        F.lit("0.5").alias("track"),
        F.when(F.col("l_linestatus") == "F", "night").otherwise("D").alias("daynight"),
        F.col("l_orderkey").alias("ok"),
        ln.alias("ln"),
        F.col("l_partkey").alias("pk"),
    )


def fc(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("city").orderBy("t")
    return (
        ch(spark, sf).filter("pm25 is not null")
        .select("city", "t", F.col("pm25").alias("yobs"), F.lag("pm25").over(w).alias("yhat"))
        .filter("yhat is not null")
        .select("city", "t", "yobs", "yhat", (F.col("yhat") - 10).alias("lo"), (F.col("yhat") + 10).alias("hi"))
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """20 x 22 nodes; the part table only supplies the node numbers."""
    base = table(spark, sf, "part").filter("p_partkey < 20").select(F.col("p_partkey").alias("i"))
    return base.select(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(21).cast("long"))).alias("j")
    ).select(
        "i", "j",
        (F.lit(76.8) + F.lit(0.8) * F.col("i") / 19).alias("lon"),
        (F.lit(28.2) + F.lit(0.8) * F.col("j") / 21).alias("lat"),
    )


def field(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly values on the nodes, from what the events of each hour and column measured."""
    i, j, k = F.col("i"), F.col("j"), F.col("hour_idx")
    e = table(spark, sf, "events")
    begin = e.agg(F.date_trunc("day", F.min("ts")).alias("b")).scalar()
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / F.lit(3_600_000_000))
    # measured: sum of whole values per hour and column of nodes
    m = e.groupBy(hour.alias("m_hour"), (F.col("user_id") % 20).alias("m_i")).agg(F.sum(F.floor("value")).alias("m"))
    hours = e.select(hour.alias("hour_idx")).distinct()
    return (
        hours.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
        .join(grid(spark, sf), "i")
        .join(m, (F.col("hour_idx") == F.col("m_hour")) & (F.col("i") == F.col("m_i")), "left")
        .select(
            "hour_idx", "i", "j", "lat", "lon",
            ((F.abs(F.coalesce("m", F.lit(0))) + i * 7 + j * 13 + k * 3) % 50 + F.lit(20.0)).alias("pm25"),
            ((i * 3 + j * 5 + k) % 15 + F.lit(0.5)).alias("ws"),
            ((i * 11 + k * 15) % 360 + F.lit(0.0)).alias("wd"),
        )
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.when(p == "1-URGENT", "firms").when(p == "5-LOW", "gfs").otherwise("cpcb").alias("source"),
        F.col("o_orderdate").cast("date").alias("dt"),
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_orderstatus") != "P").alias("complete"),
    )


def asset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 8).alias("run_id"),
        (F.col("o_orderkey") % 25 * 3).alias("lead_h"),
        F.col("o_orderpriority").alias("variable"),
        F.col("o_orderstatus").alias("level_str"),
        ((F.col("o_orderkey") % 40) / F.lit(400.0)).alias("missing_fraction"),
    )


# --------------------------------------------------------------------------- SQL text
_LAT = "28.2e0 + 0.8e0*(({k}*37)%101)/100"
_LON = "76.8e0 + 0.8e0*(({k}*61)%101)/100"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "stn": ((), f"""select s_suppkey as station_id, s_name as name, n_name as state,
        {_LAT.format(k='s_suppkey')} as lat, {_LON.format(k='s_suppkey')} as lon
        from supplier join nation on s_nationkey = n_nationkey"""),
    "rec": ((), """select s_suppkey as rec_id, concat('Ring road ', s_name, ' east, ', n_name, ' - Board') as station_text
        from supplier join nation on s_nationkey = n_nationkey"""),
    "obs": ((), """select event_id as seq, user_id%30 as station_id,
        case event_type when 'click' then 'PM2.5' when 'view' then 'PM10' when 'purchase' then 'O3'
                        when 'signup' then 'NO2' else 'CO' end as metric,
        value, ts as observed_at_utc from events"""),
    "ch": ((), """select user_id%10 as city, date_trunc('hour', ts) as t,
        avg(case when event_type='click' then value end) as pm25,
        avg(case when event_type='view' then value end) as pm10,
        avg(case when event_type='purchase' then value end) as o3,
        avg(case when event_type='signup' then value/4 end) as ws,
        avg(case when event_type='error' then value/4 end) as rh
        from events group by user_id%10, date_trunc('hour', ts)"""),
    "chx": (("ch",), f"""select *, {_LAT.format(k='city')} as lat, {_LON.format(k='city')} as lon,
        concat('S', city%3) as state, o3/100 as aod,
        5e0 + (city*7 + hour(t))%25 as temp, 0e0 + (city*37 + hour(t)*15)%360 as wd,
        0e0 + (hour(t)*53 + city*11)%800 as solar, 0e0 + (hour(t)*7 + city*13)%100 as cloud,
        case when rh > 15 then 1 else 0 end as inv, case when ws < 10 then 1 else 0 end as stag,
        case when day(t) >= 20 then 1 else 0 end as crop from ch"""),
    "fire": ((), """select l_orderkey as ok, l_linenumber as ln, 27.0e0 + 6.5e0*((l_partkey*13)%1000)/1000 as lat,
        73.0e0 + 6.5e0*((l_suppkey*29+l_linenumber*7)%1000)/1000 as lon, l_quantity*l_tax*100 as frp,
        case when l_returnflag='N' then 'nominal' when l_returnflag='A' then '15' else '90' end as confidence,
        l_orderkey%720 as acq_h from lineitem"""),
    "fire_t": (("fire",), """select concat(ok, '|', ln) as fire_id, lat, lon, frp, confidence, acq_h,
        timestamp '2024-01-01 00:00:00' + to_minutes(acq_h*60 + ln*7) as acq from fire"""),
    "rawfire": ((), """select cast(cast(27.0e0 + 6.5e0*((l_partkey*13)%1000)/1000 as decimal(9,4)) as varchar) as latitude,
        cast(cast(73.0e0 + 6.5e0*((l_suppkey*29+l_linenumber*7)%1000)/1000 as decimal(9,4)) as varchar) as longitude,
        strftime(l_shipdate, '%Y-%m-%d') as acq_date,
        cast((l_orderkey%24)*100 + (l_linenumber*7)%60 as integer) as acq_time,
        case l_linenumber when 1 then 'NPP' when 2 then 'NOAA-20' when 3 then ' aqua' when 4 then 'Terra'
             when 5 then 'noaa-21' else 'GOES' end as satellite,
        case when l_returnflag='N' then 'nominal' when l_returnflag='A' then '15' else '90%' end as confidence,
        case when l_suppkey%10=0 then 'n/a' when l_suppkey%10=1 then '-2.5' else cast(cast(l_quantity as integer) as varchar) end as frp,
        case when l_partkey%7=0 then null else '331.5' end as bright_ti4, '0.4' as scan, '0.5' as track,
        case when l_linestatus='F' then 'night' else 'D' end as daynight,
        l_orderkey as ok, l_linenumber as ln, l_partkey as pk from lineitem"""),
    "fc": (("ch",), """select city, t, yobs, yhat, yhat-10 as lo, yhat+10 as hi
        from (select city, t, pm25 as yobs, lag(pm25) over (partition by city order by t) as yhat
              from ch where pm25 is not null) x where yhat is not null"""),
    "grid": ((), """select a.k as i, b.k as j, 76.8e0 + 0.8e0*a.k/19 as lon, 28.2e0 + 0.8e0*b.k/21 as lat
        from (select p_partkey as k from part where p_partkey<20) a
        cross join (select p_partkey as k from part where p_partkey<22) b"""),
    "evh": ((), """select user_id, value, date_diff('hour', date_trunc('day', (select min(ts) from events)), ts) as k from events"""),
    "field": (("grid", "evh"), """select h.k as hour_idx, i, j, lat, lon, (abs(coalesce(m.m,0)) + i*7 + j*13 + h.k*3)%50 + 20e0 as pm25,
        (i*3 + j*5 + h.k)%15 + 0.5e0 as ws, (i*11 + h.k*15)%360 + 0e0 as wd
        from grid cross join (select distinct k from evh) h
        left join (select k, user_id%20 as u, cast(sum(floor(value)) as bigint) as m from evh group by 1, 2) m on m.k = h.k and m.u = i"""),
    "ledger": ((), """select case o_orderpriority when '1-URGENT' then 'firms' when '5-LOW' then 'gfs' else 'cpcb' end as source,
        cast(o_orderdate as date) as dt, o_orderkey as run_id, o_orderstatus<>'P' as complete from orders"""),
    "asset": ((), """select o_orderkey as seq, o_custkey%8 as run_id, o_orderkey%25*3 as lead_h, o_orderpriority as variable,
        o_orderstatus as level_str, (o_orderkey%40)/400e0 as missing_fraction from orders"""),
}


def oracle_text(uses: str, body: str) -> str:
    """Prefix ``body`` with the named views (and what they need) as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        for d in SQL[name][0]:
            add(d)
        if name not in order:
            order.append(name)

    for u in uses.split():
        add(u)
    ctes = ", ".join(f"{n} as ({SQL[n][1]})" for n in order)
    body = body.strip()
    own = body[:5].lower() == "with "
    if not ctes:
        return body
    return f"with {ctes}, {body[5:]}" if own else f"with {ctes} {body}"
