"""Rule-based alerts over ordered series, per key (station or run).

All rules are evaluated in one grouped aggregate over the series; the only window
(row index and calm streak) shares one shuffle with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from airlake.operators import series

# Severity order and rule order.
SEVERITY = {"info": 0, "warning": 1, "critical": 2}
RULES = ("HIGH_PM", "SEVERE_AQI", "INVERSION", "STAGNANT_WIND", "STUBBLE_PLUME", "RAPID_PM_RISE")


@dataclass(frozen=True)
class Limits:
    pm25: float = 120.0
    pm25_critical: float = 201.0
    aqi: float = 301.0
    aqi_critical: float = 401.0
    trapping: float = 0.6
    wind: float = 1.5
    calm_rows: int = 3
    plume: float = 0.35
    fire: float = 0.4
    rise: float = 40.0
    rise_rows: int = 6


@dataclass(frozen=True)
class Inputs:
    """Column names of the series."""

    time: str = "t"
    pm25: str = "pm25"
    aqi: str = "aqi"
    trapping: str = "trapping"
    ws: str = "ws"
    plume: str = "plume"
    fire: str = "fire"


def _peak(value: Column, *more: Column) -> Column:
    """(value, idx, time, extras) of the largest value; the first row on ties."""
    row = F.struct(value.alias("v"), F.col("_i").alias("i"), F.col("_t").alias("t"), *[m.alias(f"x{n}") for n, m in enumerate(more)])
    return F.min_by(F.when(value.isNotNull(), row), F.when(value.isNotNull(), F.struct((-value).alias("a"), F.col("_i").alias("b"))))


def _first(cond: Column, *more: Column) -> Column:
    row = F.struct(F.col("_i").alias("i"), F.col("_t").alias("t"), *[m.alias(f"x{n}") for n, m in enumerate(more)])
    return F.min(F.when(cond, row))


def _alert(kind: str, severity: Column, idx: Column, t: Column, data: dict[str, Column], with_idx: bool = True) -> Column:
    """The alert; its message lists the data it rests on."""
    name = F.concat(F.lit(f"{kind}-"), idx.cast("string")) if with_idx else F.lit(kind)
    cells = [x for k, v in data.items() for x in (F.lit(k), v.cast("double"))]
    said = F.concat_ws(", ", *[F.format_string(f"{k}=%.2f", v.cast("double")) for k, v in data.items()])
    message = F.concat(F.lit(f"{kind} at row "), idx.cast("string"), F.lit(": "), said)
    return F.struct(name.alias("alert_id"), F.lit(kind).alias("alert_type"), severity.alias("severity"), idx.alias("idx"), t.alias("timestamp"),
                    message.alias("message"), F.create_map(*cells).alias("data"), F.lit(RULES.index(kind)).alias("rule_order"))


def alerts(df: DataFrame, keys: list[str], cols: Inputs = Inputs(), limits: Limits = Limits(), rules: tuple[str, ...] = RULES,
           rise: str = "first_rows") -> DataFrame:
    """Alerts of every key, highest severity first.

    ``rise``: ``first_rows`` compares rows 0 and 6 only (as published); ``sliding`` takes the first 6-row rise anywhere.
    """
    lm = limits
    w = series.by(keys, cols.time) if keys else series.by([F.lit(0)], cols.time)
    d = df.withColumns({"_t": F.col(cols.time), "_i": F.row_number().over(w) - 1})
    aggs, out = {}, {}
    if "HIGH_PM" in rules:
        aggs["_pm"] = _peak(F.col(cols.pm25))
        v = F.col("_pm.v")
        out["HIGH_PM"] = F.when(v > lm.pm25, _alert(
            "HIGH_PM", F.when(v < lm.pm25_critical, "warning").otherwise("critical"), F.col("_pm.i"), F.col("_pm.t"),
            {"pm25": v, "threshold": F.lit(lm.pm25)}))
    if "SEVERE_AQI" in rules:
        aggs["_aq"] = _peak(F.col(cols.aqi).cast("double"))
        v = F.col("_aq.v")
        out["SEVERE_AQI"] = F.when(v >= lm.aqi, _alert(
            "SEVERE_AQI", F.when(v >= lm.aqi_critical, "critical").otherwise("warning"), F.col("_aq.i"), F.col("_aq.t"),
            {"aqi": v, "threshold": F.lit(lm.aqi)}))
    if "INVERSION" in rules:
        aggs["_tr"] = _peak(F.col(cols.trapping))
        v = F.col("_tr.v")
        out["INVERSION"] = F.when(v > lm.trapping, _alert(
            "INVERSION", F.lit("warning"), F.col("_tr.i"), F.col("_tr.t"),
            {"trapping_index": v, "threshold": F.lit(lm.trapping)}))
    if "STAGNANT_WIND" in rules:
        d = series.add_run_length(d.withColumn("_k", F.lit(0)) if not keys else d, keys or ["_k"], cols.time, F.col(cols.ws) < lm.wind, "_run")
        aggs["_st"] = _first(F.col("_run") >= lm.calm_rows, F.col(cols.ws), F.col("_run"))
        out["STAGNANT_WIND"] = F.when(F.col("_st").isNotNull(), _alert(
            "STAGNANT_WIND", F.lit("warning"), F.col("_st.i"), F.col("_st.t"),
            {"ws10_ms": F.col("_st.x0"), "consecutive_hours": F.col("_st.x1")}, with_idx=False))
    if "STUBBLE_PLUME" in rules:
        both = F.col(cols.plume) * (F.lit(1.0) + F.lit(1.2) * F.col(cols.fire))
        aggs["_pl"] = _peak(both, F.col(cols.plume), F.col(cols.fire))
        out["STUBBLE_PLUME"] = F.when(F.col("_pl.v") > lm.plume + lm.fire, _alert(
            "STUBBLE_PLUME", F.lit("warning"), F.col("_pl.i"), F.col("_pl.t"),
            {"plume_conc": F.col("_pl.x0"), "fire_influence": F.col("_pl.x1")}))
    if "RAPID_PM_RISE" in rules:
        past = F.col("_past")
        d = d.withColumn("_past", F.lag(cols.pm25, lm.rise_rows).over(w))
        where = (F.col("_i") == lm.rise_rows) if rise == "first_rows" else F.lit(True)
        gap = F.col(cols.pm25) - past
        aggs["_ri"] = _first(where & (gap > lm.rise), F.col(cols.pm25), past)
        now, old = F.col("_ri.x0"), F.col("_ri.x1")
        out["RAPID_PM_RISE"] = F.when(F.col("_ri").isNotNull(), _alert(
            "RAPID_PM_RISE", F.lit("warning"), F.col("_ri.i"), F.col("_ri.t"),
            {"delta_6h": now - old, "pm25_now": now, "pm25_6h_ago": old}, with_idx=False))
    found = d.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    rows = found.select(*keys, F.explode(F.filter(F.array(*[out[r] for r in RULES if r in rules]), lambda a: a.isNotNull())).alias("a")).select(*keys, "a.*")
    rank = F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    return rows.withColumn("severity_rank", rank).orderBy(F.col("severity_rank").desc(), "rule_order", *keys)
