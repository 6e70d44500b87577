"""Serving tables: anchored forecasts, current observations, maps, dashboard and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airlake.functions import aqi, geo
from airlake.operators import aggregates as ag, metrics, series
from airlake.sources.ledger import latest_partition


def dashboard(fc: DataFrame, fires: DataFrame, obs: DataFrame, ledger: DataFrame, run_source: str = "gfs") -> DataFrame:
    """Long rows (block, item, name, value): run summary, detections in the city box, newest station values."""
    run = latest_partition(ledger, run_source).select(F.col("run_id").cast("string").alias("r")).scalar()
    summary = metrics.improvement_pct(fc, "yobs", "yhat", "lo").withColumns({
        "stations": fc.agg(F.countDistinct("city").alias("n")).scalar(), "raw_rmse": F.col("rmse_b"), "engine_rmse": F.col("rmse_a")})
    box = geo.in_box(F.col("lat"), F.col("lon"), **geo.NCR_BOX)
    last = series.latest_per_key(obs, ["station_id", "metric"], "observed_at_utc", "seq")
    return ag.union_all([
        ag.long_block(summary, "forecast", run, ["stations", "raw_rmse", "engine_rmse", "improvement_pct"]),
        ag.long_block(fires.filter(box), "fires", F.col("fire_id"), ["frp"]),
        last.select(F.lit("stations").alias("block"), F.col("station_id").cast("string").alias("item"), F.col("metric").alias("name"), F.col("value").cast("double").alias("value")),
    ])


SPECIES = ("pm25", "pm10", "o3")
ANCHOR_MAX_AGE_DAYS = 3.0


def scenario_pick(signals: DataFrame, fires: DataFrame) -> DataFrame:
    """One row: the regime that sets the forecast scenario."""
    power = fires.select("frp_sum_mw").scalar()
    inv, bio = F.col("inversion_hours"), F.col("biomass_season_hours")
    return signals.withColumn("frp_sum_mw", power).withColumn("scenario", F.when(F.col("frp_sum_mw") > 2000.0, "stubble_plume")
                                                              .when((inv > 0) & (inv >= bio), "strong_inversion").otherwise("normal_winter"))


def anchor_offsets(ch: DataFrame, forecast: DataFrame, t: str, lead: str, now: Column, species: tuple[str, ...] = SPECIES,
                   max_age_days: float = ANCHOR_MAX_AGE_DAYS) -> DataFrame:
    """Per species: newest observed mean in the capital box minus the forecast's first lead; zero when the data are stale."""
    top = ch.agg(F.max(t).alias("m")).scalar()
    near = ch.filter((F.col(t) >= top - F.expr("interval 1 hour")) & geo.in_box(F.col("lat"), F.col("lon"), **geo.NCR_BOX))
    seen = near.agg(F.struct(*[F.avg(s).alias(s) for s in species]).alias("o")).scalar()
    first = forecast.filter(F.col(lead) == 1).agg(F.struct(*[F.avg(s).alias(s) for s in species]).alias("f")).scalar()
    d = ch.agg(F.max(t).alias("data_as_of")).withColumns({"_o": seen, "_f": first})
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("data_as_of").cast("timestamp"))) / F.lit(86400e6)
    d = d.withColumn("age_days", age).withColumn("mode", F.when(F.col("age_days") <= max_age_days, "applied").otherwise("stale-not-applied"))
    gap = lambda s: F.when(F.col("mode") == "applied", F.coalesce(F.round(F.col("_o").getField(s) - F.col("_f").getField(s), 2), F.lit(0.0))).otherwise(F.lit(0.0))
    cells = F.array(*[F.struct(F.lit(s).alias("species"), gap(s).alias("offset")) for s in species])
    return d.select("data_as_of", F.round("age_days", 1).alias("age_days"), "mode", F.explode(cells).alias("e")).select("e.species", "e.offset", "data_as_of", "age_days", "mode")


def offset_map(offsets: DataFrame) -> Column:
    """All offsets (one row per species) as one scalar map, so they are computed once."""
    return offsets.agg(F.map_from_entries(F.collect_list(F.struct("species", "offset"))).alias("m")).scalar()


def anchored_series(forecast: DataFrame, offsets: Column, halfwidth: dict[str, float], lead: str, species: tuple[str, ...] = SPECIES) -> DataFrame:
    """Per lead: anchored concentrations, their interval, index and category; bounds have their own columns."""
    conc = {s: F.round(F.greatest(F.lit(0.0), F.col(s) + F.col("_off")[s]), 2) for s in species}
    d = forecast.withColumn("_off", offsets).withColumns(conc).drop("_off")
    d = d.withColumns({x: c for s in species for x, c in (
        (f"{s}_lo", F.round(F.greatest(F.lit(0.0), F.col(s) - F.lit(float(halfwidth[s]))), 2)), (f"{s}_hi", F.round(F.col(s) + F.lit(float(halfwidth[s])), 2)))})
    names = {"pm25": "PM2.5", "pm10": "PM10", "o3": "O3", "nox": "NO2", "so2": "SO2", "co": "CO"}
    comp = aqi.composite({p: F.col(c) for c, p in names.items() if c in d.columns}, "gapped")
    d = d.withColumns({"aqi": comp["aqi"], "dominant": comp["dominant"]})
    return d.withColumn("category", aqi.category(F.col("aqi")))


def at_lead_clamped(df: DataFrame, lead: str, k: int) -> DataFrame:
    """Rows at the k-th distinct lead; beyond the horizon the last one."""
    times = series.sorted_times(df, lead)
    return df.filter(F.col(lead) == F.element_at(times, F.least(F.lit(k + 1), F.size(times))))


def current_observations(ch: DataFrame, city: str, t: str, cols: list[str], hours: int = 72) -> DataFrame:
    """Newest row per city within the last hours before the newest row of the table."""
    top = ch.agg(F.max(t).alias("m")).scalar()
    recent = ch.filter(F.col(t) >= top - F.make_dt_interval(F.lit(0), F.lit(hours)))
    last = series.latest_per_key(recent, [city], t, city)
    return last.select(city, t, *[F.round(c, 2).alias(c) if ty == "double" else F.col(c) for c, ty in last.select(*cols).dtypes])


def lead_map(field: DataFrame, lead: str, key: str, k: float) -> DataFrame:
    """Field of one quantity at the lead nearest to ``k`` (earlier on ties), packed by (j, i)."""
    best = field.select(lead).distinct().agg(F.min_by(lead, F.struct(F.abs(F.col(lead) - F.lit(k)), F.col(lead))).alias("b")).scalar()
    return ag.grid_pack(field.filter(F.col(lead) == best), lead, {key: 2})


def validation_report(fc: DataFrame, ch: DataFrame, models: dict[str, str], y: str, keys: list[str], coupled: str, uncoupled: str,
                      lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Long rows (section, label, metric, value): models, stations, episodes, ablation.

    All models are scored in one pass over the forecast rows.
    """
    names = ["n", "bias", "mae", "rmse", "r2", "correlation"]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("yhat")) for m, c in models.items()])
    long = fc.select(*keys, F.col(y).alias("y"), F.explode(cells).alias("e")).select(*keys, "y", "e.*")
    per_model = metrics.melt_metrics(metrics.error_metrics(long, "y", "yhat", ["model"]), "models", F.col("model"), names)
    main = next(iter(models.values()))
    stations = metrics.melt_metrics(metrics.error_metrics(fc, y, main, [keys[0]], lo, hi), "stations", F.col(keys[0]), [*names, "coverage"])
    episodes = metrics.melt_metrics(metrics.episode_metrics(fc, ch, keys, y, main), "episodes", F.col("regime"), names)
    ablation = metrics.melt_metrics(metrics.improvement_pct(fc, y, coupled, uncoupled), "ablation", "coupling", ["rmse_a", "rmse_b", "improvement_pct"])
    return ag.union_all([per_model, stations, episodes, ablation])
