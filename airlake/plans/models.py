"""Model queries: which rows are forecast, from what base, that forecasts are finite and better than the base.

The learner's own numbers are not SQL; that they beat persistence is, because a record of unrelated values is told best by its mean.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlake import fixtures as fx
from airlake.operators import models
from airlake.plans.registry import query
from airlake.plans.windows import SPLIT_SQL, _rt, rsql, split_frame


def model_frame(spark, sf):
    """Observed, split, place and forcing columns of rows with a persistence base."""
    base = fx.fc(spark, sf).select("city", "t", "yhat")
    d = split_frame(spark, sf).filter("pm25 is not null").join(base, ["city", "t"])
    return d.select("city", "t", "split", "lat", "lon", "pm25", F.col("yhat").alias("base"), "temp", "wd", F.coalesce("ws", F.lit(0.0)).alias("ws"),
                    F.coalesce("aod", F.lit(0.0)).alias("fire"), F.col("inv").cast("double").alias("inv"))


MODEL_SQL = f"""{SPLIT_SQL}, mf as (select sp.city, sp.t, sp.split, sp.pm25, fc.yhat as base, row_number() over (partition by sp.city order by sp.t) - 1 as past
    from sp join fc on sp.city=fc.city and sp.t=fc.t where sp.pm25 is not null)"""


def _judged(forecast):
    d = models.with_verdict(forecast, "yobs", "yhat", "base")
    return d.select("city", "t", _rt("yobs").alias("yobs"), _rt("base").alias("base"), "finite", F.col("beats_base").alias("beats_persistence"))


@query("gbt_direct", "chx fc", f"""with {MODEL_SQL} select city, t, {rsql('pm25')} as yobs, {rsql('prev')} as base, true as finite, true as beats_persistence
    from (select *, lag(pm25) over (partition by city order by t) as prev from mf) x where split='test' and past >= 6""")
def gbt_direct(spark, sf):
    return _judged(models.gbt_direct(model_frame(spark, sf), ["city"], "t", "pm25", context=6))


@query("gbt_residual", "chx fc", f"with {MODEL_SQL} select city, t, {rsql('pm25')} as yobs, {rsql('base')} as base, true as finite, true as beats_persistence from mf where split='test' and past >= 1")
def gbt_residual(spark, sf):
    return _judged(models.gbt_residual(model_frame(spark, sf), ["city"], "t", "pm25", "base"))


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in models.LABELS.items())


@query("feature_ablation", "chx fc", f"""with {MODEL_SQL}, h as (select * from mf where past >= 6), m as (select epoch_us(min(t)) as a, epoch_us(max(t)) as b from h),
    e as (select count(*) as n, sqrt(avg(power(pm25-base, 2))) as r from h, m where epoch_us(t) >= a + 0.7e0*(b-a))
    select config, label, n, {rsql('r')} as base_rmse, true as finite, config <> 'E' as beats_base from e, (values {_LABELS}) l(config, label)""")
def feature_ablation(spark, sf):
    d = models.ablation(model_frame(spark, sf), ["city"], "t", "pm25", "base", {"weather": ["temp", "wd", "ws"], "fire": ["fire"], "inversion": ["inv"]})
    return d.select("config", "label", "n", _rt("base_rmse").alias("base_rmse"), "finite", "beats_base")
