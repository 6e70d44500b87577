"""Chronological splits, leakage check, train-only statistics and climatology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from airlake.functions.timing import add_hours

ORDER = ("train", "validation", "test")


def split_at(df: DataFrame, t: str, val_start, test_start) -> DataFrame:
    return df.withColumn("split", F.when(F.col(t) < val_start, "train").when(F.col(t) < test_start, "validation").otherwise("test"))


def chrono_split(df: DataFrame, t: str, test_months: int = 12, val_months: int = 24) -> DataFrame:
    """Test = last 12 months, validation = the 12 before, train = the rest; bounds from the newest row."""
    top = df.agg(F.max(t).alias("m"))
    bound = lambda months: top.select(add_hours(F.col("m") - F.make_ym_interval(F.lit(0), F.lit(months)), F.lit(-1)).alias("b")).scalar()
    return split_at(df, t, bound(val_months), bound(test_months))


def split_meta(df: DataFrame, t: str, city: str) -> DataFrame:
    """Rows, sorted cities, start and end per split; cities are made distinct before they are listed."""
    per = df.groupBy("split", city).agg(F.count("*").alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    return per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.sort_array(F.collect_list(city)).alias("cities"),
                                    F.min("a").alias("t_start"), F.max("b").alias("t_end"))


def leakage_check(meta: DataFrame) -> DataFrame:
    """One row per adjacent pair of splits (at most three rows in all)."""
    pos = F.array_position(F.array(*[F.lit(s) for s in ORDER]), F.col("split"))
    w = W.partitionBy(F.lit(0)).orderBy(pos)
    d = meta.withColumns({"next_split": F.lead("split").over(w), "next_start": F.lead("t_start").over(w)}).filter("next_split is not null")
    return d.select(F.concat(F.lit("chronology "), "split", F.lit(" < "), "next_split").alias("check"),
                    F.when(F.col("next_start") <= F.col("t_end"), "FAIL").otherwise("OK").alias("status"),
                    F.col("t_end").alias("prev_end"), "next_start")


def standardize(df: DataFrame, cols: list[str], is_train) -> DataFrame:
    """Scale by train-only mean and population deviation (+1e-6); one aggregate row joined as a scalar."""
    fit = df.filter(is_train).agg(*[x for c in cols for x in (F.avg(c).alias(f"mu_{c}"), (F.stddev_pop(c) + F.lit(1e-6)).alias(f"sd_{c}"))])
    row = fit.select(F.struct("*").alias("s")).scalar()
    return df.withColumn("_s", row).withColumns({
        c: (F.col(c) - F.col("_s").getField(f"mu_{c}")) / F.col("_s").getField(f"sd_{c}") for c in cols}).drop("_s")


def unstandardize(c, mu, sd):
    return c * sd + mu


def day_bucket(t: Column) -> Column:
    """30-day bucket of the year, 0..11."""
    return F.least(F.floor((F.dayofyear(t) - 1) / 30).cast("int"), F.lit(11))


def climatology(train: DataFrame, city: str, t: str, value: str) -> DataFrame:
    return train.groupBy(city, F.hour(t).alias("hour"), day_bucket(F.col(t)).alias("bucket")).agg(F.avg(value).alias("clim"))


def climatology_forecast(train: DataFrame, test: DataFrame, city: str, t: str, value: str) -> DataFrame:
    """Train mean of the same city, hour and season bucket; the city's train mean where there is none."""
    clim = climatology(train, city, t, value)
    fallback = train.groupBy(city).agg(F.avg(value).alias("_city_mean"))
    d = test.withColumns({"hour": F.hour(t), "bucket": day_bucket(F.col(t))})
    return (d.join(clim, [city, "hour", "bucket"], "left").join(fallback, city, "left")
            .withColumn("yhat", F.coalesce("clim", "_city_mean")).drop("clim", "_city_mean", "hour", "bucket"))
