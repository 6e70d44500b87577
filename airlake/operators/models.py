"""Boosted-tree forecasts on Spark ML: direct, on residuals, and by feature block.

Training and test rows come from one feature table, which is held while models are fitted; the fits of the ablation run side by side on
it, as those of a cross-validation do.  A boosting round is a Spark job per tree level, so several fits at a time keep the cluster busy.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from airlake.operators import features, metrics, series

# Centre and scale of the static place columns.
LAT_CENTRE, LAT_SCALE = 28.4, 0.8
LON_CENTRE, LON_SCALE = 77.2, 1.2
# Feature blocks of the ablation; E is the base forecast itself.
BLOCKS = {"A": ("history",), "B": ("history", "weather"), "C": ("history", "weather", "fire"), "D": ("history", "weather", "fire", "inversion"),
          "E": (), "F": ("history", "weather", "fire", "inversion", "base")}
LABELS = {"A": "PM history only", "B": "PM + weather", "C": "PM + weather + fire", "D": "PM + weather + fire + inversion", "E": "Base forecast",
          "F": "Full hybrid model"}


def static_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"urban": F.lit(1.0), "lat_s": (F.col("lat") - F.lit(LAT_CENTRE)) / F.lit(LAT_SCALE), "lon_s": (F.col("lon") - F.lit(LON_CENTRE)) / F.lit(LON_SCALE)})


def _regressor(label: str, rounds: int, depth: int, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_p", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed, cacheNodeIds=True)


def fit_predict(d: DataFrame, train: str, test: str, columns: dict[str, list[str]], label: str, rounds: int, depth: int, seed: int, parallelism: int = 4) -> dict[str, DataFrame]:
    """By name: the test rows with the forecast ``_p`` of a model over the named columns.

    ``train`` and ``test`` are conditions on ``d``.  ``d`` is held on the executors (spilling to disk) while the models are fitted, ``parallelism``
    at a time; what is returned reads it anew, so nothing stays behind.  Rows with a missing feature take no part.  Without any training
    row, the forecast is null.
    """
    used = list(dict.fromkeys(c for cols in columns.values() for c in cols))
    # rows in a fixed order, so that every run draws the same samples
    held = d.filter(train).select(*used, label).dropna().repartition(*used, label).sortWithinPartitions(*used, label).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(cols: list[str]):
        return _regressor(label, rounds, depth, seed).fit(VectorAssembler(inputCols=cols, outputCol="_x").transform(held).select("_x", label))

    try:
        if held.isEmpty():
            return {name: d.filter(test).dropna(subset=cols).withColumn("_p", F.lit(None).cast("double")) for name, cols in columns.items()}
        with ThreadPool(min(parallelism, len(columns))) as pool:
            models = dict(zip(columns, pool.map(inheritable_thread_target(d.sparkSession)(fit), columns.values())))
    finally:
        held.unpersist()
    rows = {name: VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip").transform(d.filter(test)) for name, cols in columns.items()}
    return {name: models[name].transform(rows[name]).drop("_x") for name in columns}


def with_verdict(scored: DataFrame, y: str, yhat: str, base: str) -> DataFrame:
    """Rows of a forecast with ``finite`` (of the row) and ``beats_base`` (its error over all rows is smaller than the base forecast's)."""
    square = lambda c: F.avg(F.pow(F.col(y) - F.col(c), F.lit(2)))
    better = scored.filter(F.col(base).isNotNull() & F.col(yhat).isNotNull()).agg((square(yhat) < square(base)).alias("b")).scalar()
    finite = F.col(yhat).isNotNull() & ~F.isnan(yhat) & (F.abs(yhat) < float("inf"))
    return scored.withColumns({"finite": F.coalesce(finite, F.lit(False)), "beats_base": F.coalesce(better, F.lit(False))})


def context_features(df: DataFrame, keys: list[str], t: str, value: str, context: int = 24) -> tuple[DataFrame, list[str]]:
    """The last ``context`` values as columns next to the target, with static place columns."""
    w = series.by(keys, t)
    cols = [f"c{k}" for k in range(1, context + 1)]
    d = static_columns(df).withColumns({f"c{k}": F.lag(value, k).over(w) for k in range(1, context + 1)}).filter(F.col(cols[-1]).isNotNull())
    return d, [*cols, "urban", "lat_s", "lon_s"]


def gbt_direct(df: DataFrame, keys: list[str], t: str, value: str, context: int = 24, rounds: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """One-step forecast of the test rows from the context window, one model for all stations; ``base`` is persistence."""
    d, cols = context_features(df, keys, t, value, context)
    out = fit_predict(d, "split = 'train'", "split = 'test'", {"direct": cols}, value, rounds, depth, seed)["direct"]
    return out.select(*keys, t, F.col(value).alias("yobs"), F.col("c1").alias("base"), F.col("_p").alias("yhat"))


def gbt_residual(df: DataFrame, keys: list[str], t: str, value: str, base: str, rounds: int = 20, depth: int = 4, seed: int = 7) -> DataFrame:
    """Trees learn the residual of a base forecast; the point forecast is base plus residual."""
    w = series.by(keys, t)
    d = static_columns(df).withColumns({**features.cyclic(F.col(t)), "_res": F.col(value) - F.col(base), "_last": F.lag(value, 1).over(w)}).filter("_last is not null")
    cols = [base, "_last", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "urban", "lat_s", "lon_s"]
    out = fit_predict(d, "split = 'train'", "split = 'test'", {"residual": cols}, "_res", rounds, depth, seed)["residual"]
    return out.select(*keys, t, F.col(value).alias("yobs"), F.col(base).alias("base"), (F.col(base) + F.col("_p")).alias("yhat"))


def ablation(df: DataFrame, keys: list[str], t: str, value: str, base: str, blocks: dict[str, list[str]], train_share: float = 0.7,
             rounds: int = 10, depth: int = 4, seed: int = 11) -> DataFrame:
    """Scores of the six block configurations on the last part of the record (split by time share), all on the same rows."""
    w = series.by(keys, t)
    d = df.withColumns({f"h{k}": F.lag(base, k).over(w) for k in range(1, 7)}).filter("h6 is not null")
    span = d.agg(F.min(t).alias("a"), F.max(t).alias("b")).select((F.unix_micros(F.col("a").cast("timestamp")) + F.lit(train_share) * (
        F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp")))).alias("c")).scalar()
    d = d.withColumn("_train", F.unix_micros(F.col(t).cast("timestamp")) < span)
    groups = {"history": [*(f"h{k}" for k in range(1, 7)), base], "base": [], **blocks}
    columns = {key: list(dict.fromkeys(c for b in use for c in groups[b])) for key, use in BLOCKS.items() if use}
    # one set of rows for all configurations
    d = d.dropna(subset=list(dict.fromkeys(c for cols in columns.values() for c in cols)))
    forecast = fit_predict(d, "_train", "not _train", columns, value, rounds, depth, seed)
    parts = []
    for key in BLOCKS:
        out, p = (forecast[key], "_p") if key in forecast else (d.filter("not _train"), base)
        judged = with_verdict(out.select(F.col(value).alias("yobs"), F.col(base).alias("base"), F.col(p).alias("yhat")), "yobs", "yhat", "base")
        scored = metrics.error_metrics(judged, "yobs", "yhat", bias="pred_minus_obs")
        flags = judged.agg(F.sqrt(F.avg(F.pow(F.col("yobs") - F.col("base"), F.lit(2)))).alias("base_rmse"), F.bool_and("finite").alias("finite"), F.bool_or("beats_base").alias("beats_base"))
        parts.append(scored.select(F.lit(key).alias("config"), F.lit(LABELS[key]).alias("label"), "*").crossJoin(flags))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
