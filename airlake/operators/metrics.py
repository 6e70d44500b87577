"""Forecast scores: error, spatial pattern, weighted, interval and regime metrics."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions.numeric import div
from airlake.operators.quantiles import quantiles_of_counts, value_counts

# Regime name -> flag column and threshold (active when above).
REGIMES = {"inversion": ("inv", 0.0), "biomass_burning": ("crop", 0.0), "high_aod": ("aod", 0.6), "stagnant_wind": ("stag", 0.0)}


def pearson(a: str, b: str) -> Column:
    """Correlation from moments; null for constant input (the built-in raises in ANSI mode)."""
    return div(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def _scores(y: str, yhat: str, bias: str = "obs_minus_pred") -> list[Column]:
    e = F.col(y) - F.col(yhat)
    sign = 1 if bias == "obs_minus_pred" else -1
    return [
        F.count(e).alias("n"), (F.avg(e) * sign).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - div(F.sum(e * e), F.var_pop(y) * F.count(e))).alias("r2"),
        F.avg(F.when(F.col(y) > 0.01, F.abs(e) / F.when(F.col(y) > 0.01, F.col(y)))).alias("mape"),
        pearson(y, yhat).alias("correlation"),
    ]


def error_metrics(df: DataFrame, y: str, yhat: str, keys: list[str] | None = None, lo: str | None = None, hi: str | None = None,
                  bias: str = "obs_minus_pred") -> DataFrame:
    """One pass of map-side combined moments; rows without an observation are left out."""
    aggs = _scores(y, yhat, bias)
    if lo and hi:
        aggs.append(coverage_share(y, lo, hi).alias("coverage"))
    d = df.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return d.groupBy(*(keys or [])).agg(*aggs)


def coverage_share(y: str, lo: str, hi: str) -> Column:
    return F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("int"))


def interval_coverage(df: DataFrame, y: str, lo: str, hi: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(coverage_share(y, lo, hi).alias("coverage"))


def spatial_pattern_error(df: DataFrame, t: str, y: str, yhat: str) -> DataFrame:
    """1 - mean over time of the cross-station correlation; constant times are skipped; 1 when none is left."""
    per = df.groupBy(t).agg(F.covar_pop(y, yhat).alias("c"), (F.sqrt(F.var_pop(y) * F.var_pop(yhat)) * F.count("*")).alias("d"), F.count("*").alias("n"))
    return per.agg(F.coalesce(F.lit(1.0) - F.avg(F.when(F.col("d") >= 1e-9, F.col("c") * F.col("n") / F.when(F.col("d") >= 1e-9, F.col("d")))), F.lit(1.0)).alias("spe"))


def seasonal_weight(doy: Column, lead: Column | None = None) -> Column:
    w = F.when(doy.between(274, 334), F.lit(1.3)).otherwise(F.lit(0.3))
    if lead is not None:
        w = w * F.when(lead.between(24, 48), F.lit(1.5)).otherwise(F.lit(1.0))
    return w


def weighted_rmse(df: DataFrame, y: str, yhat: str, weight: Column, keys: list[str] | None = None) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    return df.groupBy(*(keys or [])).agg(F.sqrt(div(F.sum(weight * e * e), F.sum(weight))).alias("wrmse"))


def conformal_halfwidth(df: DataFrame, residual: Column, mode: str = "quantile", level: float = 0.9) -> DataFrame:
    """``quantile``: exact 90 % quantile of the distance to the median; ``normal``: 1.96 population deviations
    of the residuals with one zero appended."""
    r = df.select(residual.alias("r")).filter("r is not null")
    if mode == "normal":
        n1 = F.count("r") + 1
        var = F.sum(F.col("r") * F.col("r")) / n1 - F.pow(F.sum("r") / n1, F.lit(2))
        return r.agg((F.lit(1.96) * F.sqrt(F.greatest(var, F.lit(0.0)))).alias("halfwidth"))
    vc = value_counts(r, [], "r")
    med = quantiles_of_counts(vc, [], {"med": 0.5}).select("med").scalar()
    dist = vc.groupBy(F.abs(F.col("v") - med).alias("d")).agg(F.sum("n").alias("n")).withColumnRenamed("d", "v")
    return quantiles_of_counts(dist, [], {"halfwidth": level}).select("halfwidth")


def regime_rows(ch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, regime) rows where the regime is active."""
    rules = F.array(*[F.struct(F.lit(n).alias("regime"), (F.col(c) > thr).alias("on")) for n, (c, thr) in REGIMES.items()])
    return ch.select(*keys, F.explode(rules).alias("e")).filter("e.on").select(*keys, F.col("e.regime").alias("regime"))


def regime_list(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in REGIMES])).alias("regime"))


def episode(fc: DataFrame, ch: DataFrame, regime: str, keys: list[str]) -> DataFrame:
    """Forecast rows at places and times where the regime is active."""
    col, thr = REGIMES[regime]
    return fc.join(ch.filter(F.col(col) > thr).select(*keys), keys, "left_semi")


def episode_metrics(fc: DataFrame, ch: DataFrame, keys: list[str], y: str, yhat: str) -> DataFrame:
    scored = error_metrics(fc.join(regime_rows(ch, keys), keys), y, yhat, ["regime"])
    d = regime_list(fc).join(scored, "regime", "left")
    return d.withColumns({"present": F.col("n").isNotNull(), "n": F.coalesce("n", F.lit(0).cast("long"))})


def improvement_pct(df: DataFrame, y: str, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    rm = lambda p: F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), F.lit(2))))
    return df.groupBy(*(keys or [])).agg(rm(a).alias("rmse_a"), rm(b).alias("rmse_b")).withColumn(
        "improvement_pct", (F.lit(1.0) - div(F.col("rmse_a"), F.col("rmse_b"))) * 100)


def melt_metrics(df: DataFrame, section: str, label: str | Column, names: list[str]) -> DataFrame:
    """Long rows (section, label, metric, value)."""
    lab = F.lit(label) if isinstance(label, str) else label
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(section).alias("section"), lab.cast("string").alias("label"), F.explode(cells).alias("e")).select(
        "section", "label", "e.metric", "e.value")
