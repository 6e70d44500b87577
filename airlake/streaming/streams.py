"""The polled feeds as Structured Streaming jobs.

Every function takes a streaming (or batch) DataFrame and returns a DataFrame; ``run`` drives a query over all available input and
leaves an exactly-once Parquet sink, ``follow`` does so poll after poll, each time from the checkpoint, as a scheduled job would.

What is late: Spark's watermark is the newest event time of all earlier polls less the delay.  A row is dropped if what it
belongs to (its window, or itself) ended at or before that; state older than the watermark is closed and removed, so it holds
one delay's worth of keys.  Dropped rows and state sizes are in the progress reports that ``run`` and ``follow`` return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from airlake.functions.timing import hour_floor, ntz
from airlake.operators import qc
from airlake.sources.writers import write_partition

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def run(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> list[dict]:
    """Process everything that is available, then stop; a restart resumes from the checkpoint.  Returns the progress of every trigger."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p if isinstance(p, dict) else p.json for p in q.recentProgress]


def arrivals(rows: DataFrame, base: str, poll: str = "poll") -> Iterator[int]:
    """Let rows arrive in ``base/in`` poll by poll, in the order of their numbers in ``poll``; yields the number after each."""
    spark = rows.sparkSession
    rows.write.partitionBy(poll).parquet(f"{base}/held")
    held = spark.read.schema(rows.schema).parquet(f"{base}/held")
    for k in sorted(r[0] for r in held.select(poll).distinct().collect()):
        held.filter(F.col(poll) == k).drop(poll).write.mode("append").parquet(f"{base}/in")
        yield k


def follow(rows: DataFrame, build: Callable[[DataFrame], DataFrame], base: str, poll: str = "poll") -> list[dict]:
    """Run ``build`` on the stream of ``rows`` once after every poll, from the checkpoint; the result is in ``base/out``."""
    spark, progress = rows.sparkSession, []
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != poll)
    for _ in arrivals(rows, base, poll):
        progress += run(build(read_stream(spark, f"{base}/in", schema)), f"{base}/out", f"{base}/ckpt")
    return progress


def late_rows(progress: list[dict]) -> int:
    """Rows that the watermark dropped, over all triggers; rows that are summed before the state count as one per group and task."""
    return sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])


def state_rows(progress: list[dict]) -> list[int]:
    """Rows of state after each trigger."""
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]


def clean(df: DataFrame, lo: float = qc.LOWER_BOUND, hi: float = qc.CEILING) -> DataFrame:
    """Normalise the stamp to the hour and keep physically possible values."""
    return df.withColumn("hour", hour_floor(F.col("observed_at_utc"))).filter(F.col("hour").isNotNull() & ~qc.out_of_range(F.col("value"), lo, hi))


BATCH_LEDGER = "source STRING, batch_id BIGINT, kept BIGINT, dropped BIGINT"


def batch_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Batches that are complete; none where nothing was entered yet."""
    try:
        return spark.read.schema(BATCH_LEDGER).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BATCH_LEDGER)


def store_batch(batch: DataFrame, batch_id: int, store: str, ledger: str, source: str, lo: float, hi: float, before_entry: Callable[[int], None] | None = None) -> bool:
    """Put a micro-batch of observations into the partitioned store and enter it in the ledger; False if it was there already.

    Its partitions bear the batch's number, so a batch that broke off before its entry replaces what it left; the entry comes last.  Kept and dropped
    rows are counted while they are written: one pass.
    """
    spark = batch.sparkSession
    if not batch_ledger(spark, ledger).filter((F.col("source") == source) & (F.col("batch_id") == batch_id)).isEmpty():
        return False
    hour = hour_floor(F.col("observed_at_utc"))
    good = F.coalesce(hour.isNotNull() & ~qc.out_of_range(F.col("value"), lo, hi), F.lit(False))
    seen = Observation()
    judged = batch.withColumns({"hour": hour, "_good": good}).observe(seen, F.count_if("_good").alias("kept"), F.count_if(~F.col("_good")).alias("dropped"))
    rows = judged.filter("_good").drop("_good")
    write_partition(rows.withColumns({"source": F.lit(source), "dt": F.to_date("hour"), "run_id": F.lit(f"b{batch_id:08d}")}), store)
    if before_entry:
        before_entry(batch_id)
    entry = spark.createDataFrame([(source, batch_id, seen.get["kept"], seen.get["dropped"])], BATCH_LEDGER)
    entry.coalesce(1).write.mode("append").parquet(ledger)
    return True


def ingest(df: DataFrame, store: str, ledger: str, checkpoint: str, source: str, lo: float = qc.LOWER_BOUND, hi: float = qc.CEILING, once: bool = False,
           before_entry: Callable[[int], None] | None = None) -> list[dict]:
    """Clean a stream of observations into the store, exactly once over restarts.

    The checkpoint fixes which files a batch holds, and the ledger which batches are complete: a batch that Spark hands over again is skipped or done
    over, never doubled.  ``once`` stops after the first trigger.
    """
    q = df.writeStream.foreachBatch(lambda batch, k: store_batch(batch, k, store, ledger, source, lo, hi, before_entry) and None)
    q = q.option("checkpointLocation", checkpoint)
    q = (q.trigger(once=True) if once else q.trigger(availableNow=True)).start()
    q.awaitTermination()
    return [p if isinstance(p, dict) else p.json for p in q.recentProgress]


def stored(spark: SparkSession, store: str, ledger: str, schema: str, source: str) -> DataFrame:
    """Rows of complete batches only."""
    rows = spark.read.schema(f"{schema}, source STRING, dt DATE, run_id STRING").parquet(store).filter(F.col("source") == source)
    done = batch_ledger(spark, ledger).filter(F.col("source") == source).select(F.format_string("b%08d", "batch_id").alias("run_id"))
    return rows.join(done, "run_id", "left_semi").drop("source", "dt", "run_id")


def _event_time(df: DataFrame, t: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC, so the value is the same."""
    return df.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, delay)


def dedupe(df: DataFrame, key: str = "fire_id", t: str = "acq", delay: str = "6 hours") -> DataFrame:
    """Drop repeated detections across polls; an id leaves the state once the watermark is ``delay`` past its first row."""
    return _event_time(df, t, delay).dropDuplicatesWithinWatermark([key]).withColumn(t, ntz(F.col(t)))


def hourly_mean(df: DataFrame, t: str = "observed_at_utc", delay: str = "1 hour") -> DataFrame:
    """Tumbling one-hour mean per station and metric; closed windows only."""
    return _event_time(df, t, delay).groupBy(F.window(t, "1 hour").alias("w"), "station_id", "metric").agg(
        F.avg("value").alias("value"), F.count("*").alias("n")).select("station_id", "metric", ntz(F.col("w.start")).alias("t"), "value", "n")


def rolling_power(df: DataFrame, t: str = "acq", delay: str = "1 hour") -> DataFrame:
    """Six-hour power sums that slide by one hour; a late row still enters those of its windows that are open."""
    return _event_time(df, t, delay).groupBy(F.window(t, "6 hours", "1 hour").alias("w")).agg(
        F.sum("frp").alias("frp_6h"), F.count("*").alias("n")).select(ntz(F.col("w.start")).alias("t"), "frp_6h", "n")


class CalmStreak(StatefulProcessor):
    """Length of the current run of calm rows per station; emits rows from the ``rows``-th on.

    Rows wait in a list until the watermark has passed them, so they may arrive in any order within the delay; a timer
    at the oldest one wakes the station.  What is passed is counted in time order and leaves the state, which thus holds a delay's rows and two numbers
    per station.  Rows at or before the last counted watermark are late and dropped.
    """

    def __init__(self, limit: float, rows: int) -> None:
        self.limit = limit
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streak = handle.getValueState("streak", "n INT, upto BIGINT")
        self.waiting = handle.getListState("waiting", "ms BIGINT, ws DOUBLE")

    def _known(self) -> tuple[int, int]:
        return tuple(self.streak.get()) if self.streak.exists() else (0, -1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto = max(self._known()[1], timerValues.getCurrentWatermarkInMs())
        for some in rows:
            # event times are whole milliseconds here
            ms = some["t"].astype("datetime64[ms]").astype("int64")
            fresh = [(int(m), float(w)) for m, w in zip(ms, some["ws"]) if m > upto]
            if fresh:
                self.waiting.appendList(fresh)
                self.handle.registerTimer(min(m for m, _ in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, upto = self._known()
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        out = []
        for ms, ws in due:
            n = n + 1 if ws < self.limit else 0
            if n >= self.rows:
                out.append((key[0], pd.Timestamp(ms, unit="ms"), ws, n))
        self.streak.update((n, max(now, upto)))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["station_id", "t", "ws", "streak"])

    def close(self) -> None:
        pass


def stagnation(df: DataFrame, limit: float = 1.5, rows: int = 3, delay: str = "6 hours") -> DataFrame:
    """Streaming (station_id, t, ws) to the rows at which at least ``rows`` calm rows in a row were seen, in event time."""
    return _event_time(df, "t", delay).groupBy("station_id").transformWithStateInPandas(
        statefulProcessor=CalmStreak(limit, rows), outputStructType="station_id BIGINT, t TIMESTAMP_NTZ, ws DOUBLE, streak INT",
        outputMode="Append", timeMode="EventTime")


def with_rocksdb(spark: SparkSession):
    """Context in which queries start with the RocksDB state store (needed by stateful processors)."""
    from contextlib import contextmanager

    @contextmanager
    def scope():
        name = "spark.sql.streaming.stateStore.providerClass"
        old = spark.conf.get(name, None)
        spark.conf.set(name, ROCKSDB)
        try:
            yield
        finally:
            spark.conf.set(name, old) if old else spark.conf.unset(name)

    return scope()
