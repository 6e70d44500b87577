"""Late data, state bounds and restarts of the polled feeds."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from airlake.fixtures import oracle_text
from airlake.plans import streams as plans
from airlake.streaming import streams
from tests.conftest import SMALL


def _dropped(duck, uses, body):
    return duck.execute(oracle_text(uses, body)).fetchone()[0]


def test_the_watermark_drops_what_sql_says(spark, duck):
    base = tempfile.mkdtemp(prefix="airlake-")
    rows = plans._closed(plans.observations(spark, SMALL), "observed_at_utc", station_id=F.lit(-1), metric=F.lit("end"))
    progress = streams.follow(rows, streams.hourly_mean, base)
    want = _dropped(duck, "obs", f"""with a as (select *, {plans._sql_poll(plans.OBS_H, 'seq%10=0')} as poll from obs), {plans.watermarks('a', 'observed_at_utc', 1)}
        select count(*) from a join wm using (poll) where date_trunc('hour', observed_at_utc) + interval 1 hour <= wm""")
    kept = spark.read.parquet(f"{base}/out").filter("station_id >= 0").agg(F.sum("n")).first()[0]
    total = duck.execute("select count(*) from events").fetchone()[0]
    assert want > 30 and kept == total - want
    # Spark counts groups of a task, not rows
    assert 0 < streams.late_rows(progress) <= want
    # closed windows leave the state: after the last poll nothing but the far row is open
    assert streams.state_rows(progress)[-1] <= 1 and max(streams.state_rows(progress)) < total
    assert len([p for p in progress if p["numInputRows"]]) == plans.POLLS + 1


def test_a_late_row_enters_the_windows_that_are_open(spark):
    base = tempfile.mkdtemp(prefix="airlake-")
    rows = spark.sql("""select 1.0D as frp, timestamp_ntz'2024-01-01 12:30:00' as acq, 0 as poll union all select 10.0D, timestamp_ntz'2024-01-01 09:10:00', 1
        union all select 100.0D, timestamp_ntz'2024-01-01 04:10:00', 1 union all select 0.0D, timestamp_ntz'2030-01-01 00:00:00', 2""")
    progress = streams.follow(rows, streams.rolling_power, base)
    got = {r.t.hour: r.frp_6h for r in spark.read.parquet(f"{base}/out").filter("t < timestamp_ntz'2029-01-01 00:00:00'").collect()}
    # watermark 11:30: windows that end at 12:00 or later are open, so those that begin at 6:00 and after
    assert got == {6: 10.0, 7: 11.0, 8: 11.0, 9: 11.0, 10: 1.0, 11: 1.0, 12: 1.0}
    assert streams.late_rows(progress) >= 2


def test_a_repeat_is_known_as_long_as_the_delay(spark):
    base = tempfile.mkdtemp(prefix="airlake-")
    rows = spark.sql("""select concat('f', h) as fire_id, timestampadd(HOUR, cast(h as int), timestamp_ntz'2024-01-01 00:00:00') as acq, 0 as poll from range(24) as t(h)
        union all select concat('f', h), timestamp_ntz'2024-01-02 00:30:00', 1 from range(24) as t(h)
        union all select 'g', timestamp_ntz'2024-01-01 18:00:00', 1 union all select 'l', timestamp_ntz'2024-01-01 17:00:00', 1""")
    progress = streams.follow(rows, streams.dedupe, base)
    got = sorted(r.fire_id for r in spark.read.parquet(f"{base}/out").collect())
    # watermark 17:00: ids of 12:00 and after are known; what came until 11:00 appears twice; a row at the watermark is late
    assert got == sorted([f"f{h}" for h in range(24)] + [f"f{h}" for h in range(12)] + ["g"])
    assert streams.late_rows(progress) == 1
    # 24 ids, 12 of them past the delay; then the 12 that came anew and "g"
    assert streams.state_rows(progress)[:3] == [24, 12, 25]


def test_calm_streaks_in_any_order(spark):
    base = tempfile.mkdtemp(prefix="airlake-")
    ws = [1, 1, 1, 9, 1, 1, 1, 1, 9, 1, 1, 1]
    held_back = {2: 1, 7: 1, 5: 2}  # hour: poll; hour 5 is too late by then
    rows = [(7, f"2024-01-01 {h:02d}:00:00", float(w), held_back.get(h, 0 if h < 6 else 1)) for h, w in enumerate(ws)] + [(7, "2024-01-03 00:00:00", 9.0, 3)]
    rows = [r for r in reversed(rows)]
    d = spark.createDataFrame(rows, "station_id long, s string, ws double, poll int").select("station_id", F.to_timestamp_ntz("s").alias("t"), "ws", "poll")
    with streams.with_rocksdb(spark):
        progress = streams.follow(d, lambda x: streams.stagnation(x, 1.5, 3, "4 hours"), base)
    got = sorted((r.t.hour, r.streak) for r in spark.read.parquet(f"{base}/out").collect())
    # poll 0 ends at 5:00 (its hour 5 is held back): hour 2 is within 4 h of 4:00; poll 1 ends at 11:00, so hour 5 is late in poll 2
    assert got == [(2, 3), (7, 3), (11, 3)]
    assert max(streams.state_rows(progress)) <= 3 * len(ws)


@pytest.mark.parametrize("broken", [0, 1, 2])
def test_ingest_is_exactly_once(spark, broken):
    base = tempfile.mkdtemp(prefix="airlake-")
    o = plans.observations(spark, SMALL)
    schema = ", ".join(f"{c} {t}" for c, t in o.dtypes if c != "poll")
    store, ledger, ckpt = f"{base}/store", f"{base}/ledger", f"{base}/ckpt"

    def fail(k: int) -> None:
        if k == broken:
            raise RuntimeError("lost between data and entry")

    def once(**more):
        return streams.ingest(streams.read_stream(spark, f"{base}/in", schema, files_per_trigger=1), store, ledger, ckpt, "cpcb", 5, 250, **more)

    polls = streams.arrivals(o, base)
    next(polls)
    once(once=True)
    for _ in polls:
        pass
    assert streams.batch_ledger(spark, ledger).count() == 1
    before = streams.stored(spark, store, ledger, schema + ", hour TIMESTAMP_NTZ", "cpcb").count()
    if broken:
        with pytest.raises(StreamingQueryException):
            once(before_entry=fail)
        # the rows of the broken batch are there, but no one sees them
        assert streams.batch_ledger(spark, ledger).count() == broken
        assert (streams.stored(spark, store, ledger, schema + ", hour TIMESTAMP_NTZ", "cpcb").count() > before) == (broken > 1)
    once()
    got = streams.stored(spark, store, ledger, schema + ", hour TIMESTAMP_NTZ", "cpcb").select("seq", "station_id", "metric", "value", "hour")
    want = streams.clean(o, 5, 250).select("seq", "station_id", "metric", "value", "hour")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    led = streams.batch_ledger(spark, ledger)
    assert led.count() == led.select("batch_id").distinct().count() > 2
    assert led.agg(F.sum(F.col("kept") + F.col("dropped"))).first()[0] == o.count()
    assert streams.store_batch(o.drop("poll"), 0, store, ledger, "cpcb", 5, 250) is False
