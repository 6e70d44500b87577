"""Quality control: de-duplication, range and spike flags, drop accounting, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from airlake.functions import timing
from airlake.functions.numeric import div, to_double
from airlake.operators.quantiles import median_and_mad

# Fixed values.
POLLUTANT_COLUMNS = ("pm25", "pm10", "o3", "no2", "so2", "co")
LOWER_BOUND = 0.0
CEILING = 2000.0
SPIKE_SIGMA = 5.0
MAD_SCALE = 1.4826
FRP_RANGE = (0.0, 5000.0)
MIN_CONFIDENCE = 20
MAX_MISSING = 0.05
MIN_COVERAGE = 0.6


def _pick(df: DataFrame, keys: list[str], seq: list[Column]) -> DataFrame:
    """One row per key; the rank filter is applied before the shuffle as well (group limit)."""
    w = W.partitionBy(*keys).orderBy(*seq)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _pick(df, keys, [F.col(seq).desc()])


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return _pick(df, keys, [F.col(seq).asc()])


def mark_duplicates(df: DataFrame, keys: list[str], seq: str, name: str = "is_duplicate") -> DataFrame:
    """Flag every row but the first of its key.

    The first position is a map-side combined minimum and the join back may be
    split by adaptive execution, so one key with very many copies stays spread out.
    A null in a key is a value like others.
    """
    first = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(seq).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(first, same).withColumn(name, F.col(seq) != F.col("_first")).drop("_first", *[f"_key_{k}" for k in keys])


def out_of_range(c: Column, lo: float = LOWER_BOUND, hi: float = CEILING) -> Column:
    return F.coalesce((c < lo) | (c > hi), F.lit(False))


def range_flag(cols: list[str], lo: float = LOWER_BOUND, hi: float = CEILING) -> Column:
    return reduce(lambda a, b: a | b, [out_of_range(F.col(c), lo, hi) for c in cols])


def spike(value: Column, med: Column, mad: Column, n: Column, sigma: float = SPIKE_SIGMA, mode: str = "strict") -> Column:
    """Robust z-score test.

    ``strict``: with a zero deviation every value off the median is a spike.
    ``lenient``: a zero deviation counts as 1 and groups of fewer than 3 are skipped.
    """
    gap = F.abs(value - med)
    if mode == "strict":
        hit = F.when(mad == 0, gap > 0).otherwise(div(gap, F.lit(MAD_SCALE) * mad) > sigma)
    else:
        unit = F.when(mad == 0, F.lit(1.0)).otherwise(mad)
        hit = (n >= 3) & (gap / (F.lit(MAD_SCALE) * unit) > sigma)
    return F.coalesce(hit, F.lit(False))


def with_spike_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the count, median and median deviation (n, med, mad) of their key."""
    return df.join(median_and_mad(df, keys, value), keys, "left")


def mad_flag(df: DataFrame, keys: list[str], value: str, sigma: float = SPIKE_SIGMA, mode: str = "strict") -> DataFrame:
    return with_spike_stats(df, keys, value).withColumn(
        "is_spike", spike(F.col(value), F.col("med"), F.col("mad"), F.col("n"), sigma, mode)).drop("n", "med", "mad")


def station_flags(df: DataFrame, station: str, ts: str, seq: str, cols: list[str] | None = None,
                  lo: float = LOWER_BOUND, hi: float = CEILING, sigma: float = SPIKE_SIGMA) -> DataFrame:
    """De-duplicate on the raw stamp (last wins), floor to the hour, flag ranges and spikes."""
    cols = [c for c in (cols or POLLUTANT_COLUMNS) if c in df.columns]
    d = keep_last(df, [ts, station], seq)
    d = d.withColumn(ts, timing.hour_floor(F.col(ts))).filter(F.col(ts).isNotNull())
    long = d.select(station, F.explode(F.array(*[
        F.struct(F.lit(c).alias("p"), F.col(c).cast("double").alias("x")) for c in cols])).alias("e")).select(station, "e.p", "e.x")
    stats = median_and_mad(long, [station, "p"], "x").groupBy(station).agg(*[
        F.max(F.when(F.col("p") == c, F.col(s))).alias(f"_{s}_{c}") for c in cols for s in ("n", "med", "mad")])
    d = d.join(stats, station, "left")
    spikes = {f"{c}_spike": spike(F.col(c), F.col(f"_med_{c}"), F.col(f"_mad_{c}"), F.col(f"_n_{c}"), sigma) for c in cols}
    ranges = {f"{c}_range": out_of_range(F.col(c), lo, hi) for c in cols}
    d = d.withColumns({**spikes, **ranges})
    bad = reduce(lambda a, b: a | b, [F.col(n) for n in (*spikes, *ranges)])
    return d.withColumn("is_invalid", bad).drop(*[f"_{s}_{c}" for c in cols for s in ("n", "med", "mad")])


def clean_stations(df: DataFrame, station: str, ts: str, seq: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows."""
    flagged = station_flags(df, station, ts, seq, **kw)
    plain = [c for c in flagged.columns if not c.endswith(("_spike", "_range")) and c != "is_invalid"]
    return flagged.filter("not is_invalid").select(*plain), flagged.filter("is_invalid").select(*plain)


def confidence_digits(c: Column) -> Column:
    """First run of digits of a text confidence; null when there is none."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def clean_fires(df: DataFrame, frp_range: tuple[float, float] = FRP_RANGE, conf_min: int = MIN_CONFIDENCE) -> DataFrame:
    """Valid detections with an hourly stamp; text confidence without digits is kept and set to the minimum."""
    hhmm = F.col("acq_time").try_cast("int")
    day = timing.iso_day(F.col("acq_date"))
    t = timing.ntz(day) + F.make_dt_interval(F.lit(0), F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int"))
    conf = confidence_digits(F.col("confidence").cast("string"))
    d = df.withColumns({
        "observed_at_utc": timing.hour_floor(t), "latitude": to_double(F.col("latitude")),
        "longitude": to_double(F.col("longitude")), "frp": to_double(F.col("frp")), "confidence": conf,
    })
    # each derived value is named once per test: filters are evaluated where the file is read
    lo, hi = frp_range
    mid, half = (lo + hi) / 2, (hi - lo) / 2
    ok = (
        day.isNotNull() & hhmm.isNotNull() & (F.abs(F.col("latitude")) <= 90) & (F.abs(F.col("longitude")) <= 180)
        & (F.abs(F.col("frp") - F.lit(mid)) <= half) & F.coalesce(F.col("confidence") >= conf_min, F.lit(True))
    )
    return d.filter(ok).withColumn("confidence", F.coalesce("confidence", F.lit(conf_min)))


def fire_report(df: DataFrame, source: str = "fires", frp_range: tuple[float, float] = FRP_RANGE, conf_min: int = MIN_CONFIDENCE) -> DataFrame:
    """One row on raw detections: totals, coverage of the valid ones and status, in one pass.

    Unreadable times, powers out of range and low confidence count as invalid, once for each; places off the globe make a
    row invalid without counting.  ``missing_percentage`` is the share of those counts; there is no DEGRADED state.
    """
    hhmm = F.col("acq_time").try_cast("int")
    t = timing.ntz(timing.iso_day(F.col("acq_date"))) + F.make_dt_interval(F.lit(0), F.floor(hhmm / 100).cast("int"), (hhmm % 100).cast("int"))
    d = df.select(timing.hour_floor(t).alias("t"), to_double(F.col("latitude")).alias("lat"), to_double(F.col("longitude")).alias("lon"),
                  to_double(F.col("frp")).alias("frp"), confidence_digits(F.col("confidence").cast("string")).alias("conf"))
    off = lambda c: F.coalesce(~c, F.lit(True))
    d = d.withColumns({"bad_time": F.col("t").isNull(), "bad_place": off((F.abs("lat") <= 90) & (F.abs("lon") <= 180)), "bad_frp": off(F.col("frp").between(*frp_range)),
                       "low": F.coalesce(F.col("conf") < conf_min, F.lit(False))})
    valid = ~(F.col("bad_time") | F.col("bad_place") | F.col("bad_frp") | F.col("low"))
    only = lambda c: F.when(valid, F.col(c))
    bad = F.count_if("bad_time") + F.count_if("bad_frp") + F.count_if("low")
    total = F.count("*")
    return d.agg(F.lit(source).alias("source"), total.alias("total_rows"), F.count_if(valid).alias("valid_rows"), bad.alias("invalid_rows"),
                 F.round(F.lit(100.0) * bad / F.greatest(total, F.lit(1)), 3).alias("missing_percentage"), F.min(only("t")).alias("t_start"), F.max(only("t")).alias("t_end"),
                 F.countDistinct(only("t")).alias("n_hours"), *[F.round(f(only(c)), 4).alias(f"{c}_{n}") for c in ("lat", "lon") for f, n in ((F.min, "min"), (F.max, "max"))],
                 F.when(F.count_if(valid) == 0, "FAIL").otherwise("OK").alias("status"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null when the record is kept."""
    out = F.when(rules[0][1], rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(cond, name)
    return out


def drop_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Counts per reason; kept records count under ``kept``."""
    return df.groupBy(F.coalesce(first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def qc_report(before: DataFrame, flagged: DataFrame, source: str, station: str, ts: str, cols: list[str],
              lat: str | None = None, lon: str | None = None) -> DataFrame:
    """One row: totals, coverage and status.  Range hits count per column and spikes do not count as invalid."""
    total = before.agg(F.count("*").alias("c")).scalar()
    valid = ~F.col("is_invalid")
    a = flagged.agg(
        F.count("*").alias("_deduped"),
        F.count_if(valid).alias("valid_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).cast("long").alias("missing_rows"),
        sum((F.count_if(F.col(f"{c}_range")) for c in cols), F.lit(0)).cast("long").alias("invalid_rows"),
        F.countDistinct(F.when(valid, F.col(station))).alias("stations"),
        F.min(F.when(valid, F.col(ts))).alias("t_start"), F.max(F.when(valid, F.col(ts))).alias("t_end"),
        F.countDistinct(F.when(valid, F.col(ts))).alias("n_hours"),
        *([F.round(F.min(F.when(valid, F.col(lat))), 4).alias("lat_min"), F.round(F.max(F.when(valid, F.col(lat))), 4).alias("lat_max"),
           F.round(F.min(F.when(valid, F.col(lon))), 4).alias("lon_min"), F.round(F.max(F.when(valid, F.col(lon))), 4).alias("lon_max")]
          if lat and lon else []),
        *[F.max(F.col(f"{c}_{k}").cast("int")).alias(f"_f_{c}_{k}") for c in cols for k in ("range", "spike")],
    ).withColumn("total_rows", total)
    names = [F.when(F.col(f"_f_{c}_range") == 1, F.lit(c)) for c in cols] + [F.when(F.col(f"_f_{c}_spike") == 1, F.lit(f"{c}_spike")) for c in cols]
    pct = F.round(F.lit(100.0) * F.col("missing_rows") / F.greatest(F.col("total_rows"), F.lit(1)), 3)
    a = a.withColumns({
        "source": F.lit(source), "duplicate_rows": F.col("total_rows") - F.col("_deduped"), "missing_percentage": pct,
        "flagged_columns": F.concat_ws(",", *names),
    }).withColumn("status", F.when(F.col("valid_rows") == 0, "FAIL").when(F.col("missing_percentage") > 30, "DEGRADED").otherwise("OK"))
    return a.drop("_deduped", *[f"_f_{c}_{k}" for c in cols for k in ("range", "spike")])


def station_uptime(df: DataFrame, station: str, ts: str) -> DataFrame:
    return df.groupBy(station, timing.ntz(F.date_trunc("month", F.col(ts))).alias("month")).agg(F.count("*").alias("n"))


def assert_min_rows(df: DataFrame, n: int, source: str = "source") -> DataFrame:
    """The same rows; the job fails when there are fewer than ``n``.

    For a lazy result, which is counted in a pass of its own; a job that writes its rows counts them on the way (``writers.write_gated``).
    """
    rows = df.agg(F.count("*").alias("c")).scalar()
    ok = F.assert_true(rows >= n, F.lit(f"CRITICAL: '{source}' has fewer than {n} valid rows"))
    spark = df.sparkSession
    gate = spark.range(1).select(ok.alias("_gate"))
    # the gate is evaluated once, also when df itself is empty
    return df.withColumn("_gate", gate.scalar()).filter("_gate is null").drop("_gate")


def max_missing(df: DataFrame, limit: float = MAX_MISSING) -> DataFrame:
    return df.filter(F.col("missing_fraction") <= limit)


def coverage(obs: DataFrame, stations: DataFrame, key: str = "station_id", minimum: float = MIN_COVERAGE) -> DataFrame:
    """Share of registry stations that report, and whether it passes the gate."""
    seen = obs.select(key).distinct().withColumn("_seen", F.lit(1))
    return stations.select(key).join(seen, key, "left").agg(
        F.count("*").alias("n_stations"), F.count("_seen").alias("n_reporting"),
    ).withColumn("coverage", F.coalesce(div(F.col("n_reporting").cast("double"), F.col("n_stations")), F.lit(0.0))
                 ).withColumn("passed", F.col("coverage") >= minimum)
