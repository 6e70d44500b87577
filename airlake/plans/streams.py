"""Streaming queries: the tables arrive in four polls, some rows a poll too late; every poll is a run from the checkpoint.

The check SQL states for every row whether the watermark still lets it in: ``wm`` is the newest event time of all earlier
polls less the delay.  A far row in a poll of its own closes what is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airlake import fixtures as fx
from airlake.plans.registry import query
from airlake.plans.windows import _rt, rsql
from airlake.session import new_dir
from airlake.streaming import streams

R = F.round
FAR = "timestamp_ntz'2030-01-01 00:00:00'"
POLLS, POLL_H = 4, 180


def _part(hour: Column) -> Column:
    """The poll that an hour belongs to; the last takes all later ones."""
    return F.least(F.floor(hour / POLL_H), F.lit(POLLS - 1)).cast("int")


def _late(part: Column, late: Column) -> Column:
    return F.least(part + F.coalesce(late, F.lit(False)).cast("int"), F.lit(POLLS - 1))


def _closed(rows: DataFrame, t: str, **far: Column) -> DataFrame:
    """``rows`` and a last poll with one far row."""
    kinds = dict(rows.dtypes)
    last = rows.agg(F.lit(POLLS).alias("poll"), F.expr(FAR).alias(t), *[v.cast(kinds[c]).alias(c) for c, v in far.items()])
    return rows.unionByName(last, allowMissingColumns=True)


def _hours(t: Column, begin: Column) -> Column:
    return F.timestamp_diff("HOUR", begin, t)


def watermarks(rows: str, t: str, delay_h: int) -> str:
    """SQL of ``wm``: for every poll of ``rows`` the watermark that its rows meet (null in the first)."""
    return f"""wm as (select p.poll, max(date_trunc('milliseconds', q.{t})) - interval {delay_h} hour as wm
        from (select distinct poll from {rows}) p left join {rows} q on q.poll < p.poll group by 1)"""


PART = "cast(least({last}, floor({hour}/" + str(POLL_H) + ")) as integer)"


def _sql_poll(hour: str, late: str) -> str:
    return f"least({POLLS - 1}, {PART.format(last=POLLS - 1, hour=hour)} + case when {late} then 1 else 0 end)"


OBS_H = "date_diff('hour', (select date_trunc('day', min(ts)) from events), date_trunc('hour', observed_at_utc))"


def observations(spark, sf) -> DataFrame:
    """Observations with their poll: every tenth comes a poll too late."""
    o = fx.obs(spark, sf)
    begin = o.agg(F.date_trunc("day", F.min("observed_at_utc")).cast("timestamp_ntz").alias("b")).scalar()
    part = _part(_hours(F.date_trunc("hour", "observed_at_utc").cast("timestamp_ntz"), begin))
    return o.withColumn("poll", _late(part, F.col("seq") % 10 == 0))


def detections(spark, sf) -> DataFrame:
    """Detections with their poll: every third scan line's come a poll too late."""
    return fx.fire_t(spark, sf).select("fire_id", "frp", "acq", "lat", "lon", _late(_part(F.col("acq_h")), F.col("fire_id").endswith("|3")).alias("poll"))


@query("stream_ingest_clean", "obs", "select seq, station_id, metric, value, date_trunc('hour', observed_at_utc) as hour from obs where value between 5 and 250")
def stream_ingest_clean(spark, sf):
    base = new_dir(spark, "k1")
    o, store = observations(spark, sf), (f"{base}/store", f"{base}/ledger")
    schema = ", ".join(f"{c} {t}" for c, t in o.dtypes if c != "poll")
    for k in streams.arrivals(o, base):
        # the first run stops after one trigger, the others resume from the checkpoint, two files at a time
        source = streams.read_stream(spark, f"{base}/in", schema, files_per_trigger=2)
        streams.ingest(source, *store, f"{base}/ckpt", "cpcb", 5, 250, once=k == 0)
    # a batch that is handed over again changes nothing
    streams.store_batch(o.drop("poll"), 0, *store, "cpcb", 5, 250)
    d = streams.stored(spark, *store, schema + ", hour TIMESTAMP_NTZ", "cpcb")
    return d.select("seq", "station_id", "metric", "value", "hour")


@query("stream_dedupe", "fire_t", f"""with o as (select fire_id, acq, max(frp) as frp, {PART.format(last=POLLS - 1, hour='acq_h')} as poll from fire_t group by fire_id, acq, acq_h),
    r as (select fire_id, timestamp '2024-01-01 00:30:00' + to_hours({POLL_H}*(poll+1)) as acq, poll+1 as poll from o where frp>100 and poll<{POLLS - 1}),
    a as (select fire_id, acq, poll from o union all select * from r), {watermarks('a', 'acq', 6)},
    ok as (select fire_id, acq, o.poll from o join wm using (poll) where wm is null or acq>wm)
    select fire_id, acq from ok union all
    select r.fire_id, r.acq from r join wm on wm.poll=r.poll left join ok on ok.fire_id=r.fire_id
    where r.acq>wm.wm and (ok.acq is null or ok.acq + interval 6 hour <= wm.wm)""")
def stream_dedupe(spark, sf):
    """Each poll repeats the strong detections of the one before, stamped anew: repeats of what is still known are dropped."""
    base = new_dir(spark, "k2")
    f = fx.fire_t(spark, sf).select("fire_id", "frp", "acq", _part(F.col("acq_h")).alias("poll"))
    again = f.filter((F.col("frp") > 100) & (F.col("poll") < POLLS - 1)).select(
        "fire_id", "frp", F.expr(f"timestampadd(HOUR, {POLL_H} * (poll + 1), timestamp_ntz'2024-01-01 00:30:00')").alias("acq"), (F.col("poll") + 1).alias("poll"))
    streams.follow(f.unionByName(again), lambda d: streams.dedupe(d).select("fire_id", "acq"), base)
    return spark.read.schema("fire_id STRING, acq TIMESTAMP_NTZ").parquet(f"{base}/out")


@query("stream_hourly_mean", "obs", f"""with a as (select *, {_sql_poll(OBS_H, 'seq%10=0')} as poll from obs), {watermarks('a', 'observed_at_utc', 1)}
    select station_id, metric, date_trunc('hour', observed_at_utc) as t, {rsql('avg(value)')} as value, count(*) as n from a join wm using (poll)
    where wm is null or date_trunc('hour', observed_at_utc) + interval 1 hour > wm group by 1,2,3""")
def stream_hourly_mean(spark, sf):
    base = new_dir(spark, "k3")
    o = _closed(observations(spark, sf), "observed_at_utc", station_id=F.lit(-1), metric=F.lit("end"))
    streams.follow(o, streams.hourly_mean, base)
    out = spark.read.schema("station_id BIGINT, metric STRING, t TIMESTAMP_NTZ, value DOUBLE, n BIGINT").parquet(f"{base}/out").filter("station_id >= 0")
    return out.select("station_id", "metric", "t", _rt("value").alias("value"), "n")


@query("stream_rolling_sum", "fire_t", f"""with a as (select *, {_sql_poll('acq_h', "fire_id like '%|3'")} as poll from fire_t), {watermarks('a', 'acq', 1)},
    w as (select date_trunc('hour', acq) - to_hours(k) as t, acq, frp, wm from a join wm using (poll), range(0, 6) s(k))
    select t, round(sum(frp),2) as frp_6h, count(*) as n from w where wm is null or t + interval 6 hour > wm group by t""")
def stream_rolling_sum(spark, sf):
    base = new_dir(spark, "k4")
    streams.follow(_closed(detections(spark, sf), "acq", fire_id=F.lit("end"), frp=F.lit(0.0)), streams.rolling_power, base)
    out = spark.read.schema("t TIMESTAMP_NTZ, frp_6h DOUBLE, n BIGINT").parquet(f"{base}/out").filter("t < timestamp_ntz'2029-01-01 00:00:00'")
    return out.select("t", R("frp_6h", 2).alias("frp_6h"), "n")


CH_H = "date_diff('hour', (select date_trunc('day', min(ts)) from events), t)"


def calm_rows(spark, sf) -> DataFrame:
    """Wind rows with their poll: up to five hours out of order, and some a whole poll too late."""
    d = fx.chx(spark, sf).filter("ws is not null").select(F.col("city").alias("station_id"), "t", "ws")
    begin = fx.table(spark, sf, "events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("b")).scalar()
    h = _hours(F.col("t"), begin)
    return d.withColumn("poll", _late(_part(h + (F.col("station_id") * 5 + h * 7) % 6), (F.col("station_id") * 31 + h) % 20 == 0))


@query("stream_stagnation", "chx", f"""with r as (select city as station_id, t, ws, {CH_H} as h from chx where ws is not null),
    p as (select *, {_sql_poll('(h + (station_id*5 + h*7)%6)', '(station_id*31 + h)%20=0')} as poll from r), {watermarks('p', 't', 6)},
    a as (select station_id, t, ws, ws < 12 as f from p join wm using (poll) where wm is null or t > wm),
    b as (select *, sum(case when f then 0 else 1 end) over (partition by station_id order by t) as g from a),
    c as (select *, sum(case when f then 1 else 0 end) over (partition by station_id, g order by t) as n from b) select station_id, t, round(ws,5) as ws, cast(n as integer) as streak from c where f and n>=3""")
def stream_stagnation(spark, sf):
    base = new_dir(spark, "k5")
    with streams.with_rocksdb(spark):
        streams.follow(_closed(calm_rows(spark, sf), "t", station_id=F.lit(-1), ws=F.lit(99.0)), lambda d: streams.stagnation(d, 12.0, 3), base)
    out = spark.read.schema("station_id BIGINT, t TIMESTAMP_NTZ, ws DOUBLE, streak INT").parquet(f"{base}/out")
    return out.select("station_id", "t", R("ws", 5).alias("ws"), "streak")
