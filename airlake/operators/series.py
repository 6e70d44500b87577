"""Ordered operators over hourly series.

Windows are partitioned by a series key (city, station, grid cell).  They are meant
for hour-unique frames, the output of ``resample`` or ``keep_last``: one row per key
and hour, so a window partition holds at most 8,784 rows per year of data whatever
the raw volume is.  Raw, non-unique rows are reduced by map-side combined aggregates
before they come here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.window import WindowSpec

from airlake.functions.numeric import clip
from airlake.functions.timing import add_hours, hour_floor

LAGS = (1, 3, 6, 12, 24, 48)


def by(keys: list[str], t: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(t)


def timeline_reindex(df: DataFrame, keys: list[str], t: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every hour between a key's first and last row (or the given bounds), with the facts left-joined."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    a = start if start is not None else F.col("_a")
    b = end if end is not None else F.col("_b")
    hours = span.select(*keys, F.explode(F.sequence(a, b, F.expr("interval 1 hour"))).alias(t))
    return hours.join(df, [*keys, t], "left")


def hour_sequence(df: DataFrame, t: str, name: str = "t") -> DataFrame:
    """All hours from the first to the last stamp of a table."""
    return df.agg(F.min(t).alias("_a"), F.max(t).alias("_b")).filter("_a is not null").select(
        F.explode(F.sequence(hour_floor(F.col("_a")), hour_floor(F.col("_b")), F.expr("interval 1 hour"))).alias(name))


def aggregation_for(name: str) -> str:
    low = name.lower()
    return "max" if "max" in low or "peak" in low else "mean"


def resample(df: DataFrame, keys: list[str], t: str, agg: dict[str, str] | None = None, fill_gaps: bool = True) -> DataFrame:
    """Hourly buckets; mean by default, max for names with max/peak, overrides in ``agg``; empty buckets stay null."""
    agg = agg or {}
    nums = [c for c, ty in df.dtypes if c not in keys and c != t and ty in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    fn = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "first": F.first}
    out = df.withColumn(t, hour_floor(F.col(t))).filter(F.col(t).isNotNull()).groupBy(*keys, t).agg(
        *[fn[agg.get(c, aggregation_for(c))](c).alias(c) for c in nums])
    return timeline_reindex(out, keys, t) if fill_gaps else out


def ffill(c: str | Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def bfill(c: str | Column, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))


def fill_both_ways(df: DataFrame, keys: list[str], t: str, cols: list[str]) -> DataFrame:
    w = by(keys, t)
    return df.withColumns({c: F.coalesce(ffill(c, w), bfill(c, w)) for c in cols})


def add_lags(df: DataFrame, keys: list[str], t: str, targets: list[str], max_lag: int = 48) -> DataFrame:
    """Lags of the forward-filled targets; both windows share one shuffle and sort."""
    w = by(keys, t)
    d = df.withColumns({f"_f_{c}": ffill(c, w) for c in targets})
    d = d.withColumns({f"{c}_lag{k}": F.lag(f"_f_{c}", k).over(w) for c in targets for k in LAGS if k <= max_lag})
    return d.drop(*[f"_f_{c}" for c in targets])


def rolling_mean(c: str | Column, w: WindowSpec, rows: int = 24, nulls_as_zero: bool = False, exclude_current: bool = False) -> Column:
    """Trailing mean over rows; nulls are skipped, or count as zero in the sum and in the divisor."""
    col = F.col(c) if isinstance(c, str) else c
    frame = w.rowsBetween(-rows, -1) if exclude_current else w.rowsBetween(-(rows - 1), 0)
    return F.avg(F.coalesce(col, F.lit(0.0)) if nulls_as_zero else col).over(frame)


def rolling_anomaly(c: str, w: WindowSpec, rows: int = 24) -> Column:
    return F.col(c) - rolling_mean(c, w, rows)


def lag_zero(c: str | Column, k: int, w: WindowSpec) -> Column:
    """Lag with zero before the start of the series."""
    return F.lag(c, k, 0.0).over(w)


def lag_clamped(c: str, k: int, w: WindowSpec) -> Column:
    """Lag that repeats the first value before the start."""
    rn = F.row_number().over(w)
    return F.when(rn > k, F.lag(c, k).over(w)).otherwise(F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)))


def trend(c: str, w: WindowSpec, limit: float = 300.0) -> Column:
    return clip(F.col(c) - lag_zero(c, 1, w), -limit, limit)


def add_run_length(df: DataFrame, keys: list[str], t: str, flag: Column, name: str = "run") -> DataFrame:
    """Consecutive true rows that end at the current row (one sort: distance to the last false row)."""
    w = by(keys, t)
    on = F.coalesce(flag, F.lit(False))
    d = df.withColumns({"_rn": F.row_number().over(w), "_on": on})
    last_off = F.max(F.when(~F.col("_on"), F.col("_rn"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(name, F.col("_rn") - F.coalesce(last_off, F.lit(0))).drop("_rn", "_on")


def trailing_sums(df: DataFrame, t: str, value: str, hours: tuple[int, ...], prefix: str, keep: list[str] | None = None) -> DataFrame:
    """Sums over the trailing hours of an hourly table, without a single-task window.

    Each hour adds itself to the following ``max(hours)`` - 1 hours; the partial sums
    combine on the map side.  Sums land only on hours present in the table.
    """
    top = max(hours)
    spread = df.select(F.col(t).alias("_t"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("_o"))
    sums = spread.groupBy(add_hours(F.col("_t"), F.col("_o")).alias(t)).agg(
        *[F.sum(F.when(F.col("_o") < h, F.col("_v"))).alias(f"{prefix}{h}h") for h in hours])
    return df.select(*(keep or df.columns)).join(sums, t, "left")


def latest_per_key(df: DataFrame, keys: list[str], t: str, seq: str) -> DataFrame:
    """Newest row per key, first in input order on equal stamps; ranked before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(F.col(t).desc(), F.col(seq).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def timeseries_tail(df: DataFrame, t: str, seq: str, n: int, *filters: Column) -> DataFrame:
    """Newest ``n`` matching rows, ascending."""
    hit = reduce(lambda d, f: d.filter(f), filters, df)
    return hit.orderBy(F.col(t).desc(), F.col(seq).desc()).limit(n).orderBy(t, seq)


def recent_topk(df: DataFrame, t: str, ties: list[str], n: int) -> DataFrame:
    return df.orderBy(F.col(t).desc(), *ties).limit(n)


def first_rows(df: DataFrame, order: list[str], n: int, *filters: Column) -> DataFrame:
    hit = reduce(lambda d, f: d.filter(f), filters, df)
    return hit.orderBy(*order).limit(n)


def sorted_times(df: DataFrame, t: str) -> Column:
    """Sorted distinct times of one forecast run as a scalar array (one entry per lead of the horizon)."""
    return df.select(t).distinct().agg(F.sort_array(F.collect_list(t)).alias("_ts")).scalar()


def field_at_lead(df: DataFrame, t: str, lead: int) -> DataFrame:
    """Rows at the ``lead``-th distinct time; none when out of range."""
    if lead < 0:
        return df.filter("false")
    return df.filter(F.col(t) == F.try_element_at(sorted_times(df, t), F.lit(lead + 1)))


def nearest_lead(df: DataFrame, lead: str, requests: list[int], value_cols: list[str]) -> DataFrame:
    """Per request the rows' first record with the smallest distance in lead; the earlier wins a tie."""
    d = df.withColumn("request", F.explode(F.array(*[F.lit(r) for r in requests])))
    best = F.min_by(F.struct(lead, *value_cols), F.struct(F.abs(F.col(lead) - F.col("request")), F.col(lead)))
    return d.groupBy("request").agg(best.alias("_b")).select("request", "_b.*")


def context_windows(df: DataFrame, keys: list[str], t: str, value: str, context: int, stride: int = 1) -> DataFrame:
    """Rows with the array of the ``context`` earlier values and the next-step target, every ``stride`` rows."""
    w = by(keys, t)
    return (
        df.withColumns({"_i": F.row_number().over(w) - 1, "window": F.collect_list(value).over(w.rowsBetween(-context, -1))})
        .filter((F.col("_i") >= context) & ((F.col("_i") - context) % stride == 0))
        .withColumn("target", F.col(value)).drop("_i")
    )


def persistence_forecast(df: DataFrame, keys: list[str], t: str, value: str, leads: int = 72) -> DataFrame:
    """Value at the forecast origin held for all leads."""
    return df.groupBy(*keys).agg(F.min(t).alias("origin"), F.min_by(value, t).alias("yhat")).select(
        *keys, "origin", F.explode(F.sequence(F.lit(1), F.lit(leads))).alias("lead"), "yhat")


def peak_row(df: DataFrame, keys: list[str], value: str, order: str, cols: list[str]) -> DataFrame:
    """Row with the largest value; the first in order on ties."""
    best = F.min_by(F.struct(order, value, *cols), F.struct((-F.col(value)).alias("v"), F.col(order).alias("o")))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def at_leads(df: DataFrame, lead: str, leads: list[int], species: list[str], offsets: dict[str, Column | float]) -> DataFrame:
    """Chosen leads with the anchor offset added, not below zero."""
    return df.filter(F.col(lead).isin(leads)).withColumns({
        s: F.round(F.greatest(F.lit(0.0), F.col(s) + (offsets[s] if isinstance(offsets[s], Column) else F.lit(float(offsets[s])))), 2) for s in species})
