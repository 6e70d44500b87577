"""Readers: files and nested records to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlake import schemas
from airlake.functions.numeric import to_double
from airlake.functions.timing import ntz, parse_dayfirst
from airlake.operators import normalize as nz
from airlake.operators.joins import match_stations, registry_join

FIRE_COLUMNS = ("latitude", "longitude", "acq_date", "acq_time", "frp", "confidence", "satellite", "instrument", "daynight")


def read_city_hour(spark: SparkSession, path: str) -> DataFrame:
    """Wide city-hour CSV as text columns with the source headers; nothing is inferred."""
    return spark.read.schema(schemas.CITY_HOUR_CSV).option("header", True).csv(path)


def read_fires(spark: SparkSession, glob: str, origin: str = "file") -> DataFrame:
    """All fire exports under a path or pattern, nine columns, tagged with the file (or folder) they came from."""
    d = spark.read.schema(schemas.FIRE_CSV).option("header", True).option("recursiveFileLookup", True).csv(glob)
    tag = F.col("_metadata.file_name") if origin == "file" else F.element_at(F.split("_metadata.file_path", "/"), -2)
    return d.select(*FIRE_COLUMNS, tag.alias("origin_file"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(schemas.REGISTRY_CSV).option("header", True).csv(path)
    return d.withColumn("is_manual", F.coalesce(F.lower(F.trim("is_manual")) == "true", F.lit(False)))


def _metric_cells(columns: dict[str, str], units: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("metric"), to_double(F.col(f"`{c}`")).alias("value"), F.lit(units[m]).alias("unit"))
                     for m, c in columns.items()])


def digest_to_long(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Station digest (one column per pollutant) to long rows; unknown places, stamps and empty cells are dropped."""
    d = registry_join(df, stations, "location").withColumn("observed_at_utc", parse_dayfirst(F.col("sampling_date"))).filter("observed_at_utc is not null")
    d = d.select("station_id", "observed_at_utc", F.explode(_metric_cells(nz.DIGEST_METRICS, nz.DIGEST_UNITS)).alias("e"))
    return d.select("station_id", "observed_at_utc", "e.*").filter("value is not null")


def ogd_records(df: DataFrame, text_col: str) -> DataFrame:
    """JSON text holding an array of records to one row per record."""
    return df.withColumn("_r", F.explode(F.from_json(text_col, f"array<struct<{schemas.OGD_JSON.replace(' STRING', ': string')}>>"))).select(
        *[c for c in df.columns if c != text_col], "_r.*")


def ogd_to_long(records: DataFrame, stations: DataFrame, asof: Column) -> DataFrame:
    """Open-data records to long observations; unknown pollutants, bad numbers and unmatched stations are dropped."""
    extra = [c for c in records.columns if c not in ("country", "state", "city", "station", "last_update", "latitude", "longitude", "pollutant_id",
                                                     "min_value", "max_value", "avg_value")]
    d = nz.map_metric(records, "pollutant_id", nz.OGD_METRICS, nz.OGD_UNITS).withColumn("value", to_double(F.col("avg_value"))).filter("value is not null")
    d = d.withColumn("observed_at_utc", F.coalesce(parse_dayfirst(F.col("last_update")), asof))
    d = d.select(*extra, "station", "metric", "unit", "value", "observed_at_utc")
    return match_stations(d, stations.select("station_id", "name"), "station").select(*extra, "station_id", "metric", "unit", "value", "observed_at_utc")


def series_to_long(df: DataFrame, text_col: str, asof: Column, first_only: bool = True) -> DataFrame:
    """``{success, data: {name: [item]}}`` to rows.

    ``first_only`` keeps the first available metric of an item (as published); otherwise all metrics.
    """
    item = "struct<" + schemas.SERIES_ITEM.replace(" STRING", ": string") + ">"
    doc = F.from_json(text_col, f"struct<success: boolean, data: map<string, array<{item}>>>")
    keep = [c for c in df.columns if c != text_col]
    d = df.withColumn("_d", doc).filter("_d.success").select(*keep, F.explode("_d.data").alias("series", "_items"))
    d = d.select(*keep, "series", F.posexplode("_items").alias("item", "_i")).select(*keep, "series", "item", "_i.*")
    cells = F.filter(_metric_cells(nz.DIGEST_METRICS, nz.DIGEST_UNITS), lambda x: x["value"].isNotNull())
    d = d.withColumn("observed_at_utc", F.coalesce(parse_dayfirst(F.col("updated_at")), asof)).withColumn("_c", cells)
    d = d.withColumn("e", F.get("_c", F.lit(0))).filter("e is not null") if first_only else d.withColumn("e", F.explode("_c"))
    return d.select(*keep, "series", "item", "observed_at_utc", "e.metric", "e.value", "e.unit")


def hourly_arrays_to_rows(df: DataFrame, time: str, values: list[str]) -> DataFrame:
    """Parallel arrays per point to rows; rows whose values are all null are dropped."""
    keep = [c for c in df.columns if c != time and c not in values]
    d = df.select(*keep, F.explode(F.arrays_zip(time, *values)).alias("e")).select(*keep, F.col(f"e.{time}").alias("observed_at_utc"), *[f"e.{v}" for v in values])
    return d.dropna(how="all", subset=values)


def publish_forecast(arrays: DataFrame, stations: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (time, station array per field) to one row per (time, station); position joins the station list."""
    d = arrays.select("time", F.explode(F.transform(F.sequence(F.lit(0), F.size(fields[0]) - 1), lambda k: F.struct(
        k.alias("pos"), *[F.get(F.col(f), k).alias(f) for f in fields]))).alias("e")).select("time", "e.*")
    return d.join(stations, "pos").drop("pos")


def publish_grid(field: DataFrame, grid: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (time, nested [j][i] array per field) to one row per (time, j, i) with the node's place."""
    first = fields[0]
    rows = field.select("time", *fields, F.posexplode(first).alias("j", "_row"))
    d = rows.select("time", F.col("j").cast("long").alias("j"), *[F.get(F.col(f), F.col("j")).alias(f) for f in fields])
    d = d.select("time", "j", *fields, F.posexplode(first).alias("i", "_v"))
    d = d.select("time", "j", F.col("i").cast("long").alias("i"), *[F.get(F.col(f), F.col("i")).alias(f) for f in fields])
    return d.join(grid.select("i", "j", "lat", "lon"), ["i", "j"])


def probe(df: DataFrame, n: int = 2000, order: list[str] | None = None) -> DataFrame:
    """Column list, types, and place and time range of a bounded sample (rows in ``order`` when given)."""
    sample = df.orderBy(*order).limit(n) if order else df.limit(n)
    pick = lambda names: next((c for c in names if c in df.columns), None)
    lat, lon = pick(("latitude", "lat", "Latitude")), pick(("longitude", "lon", "Longitude"))
    t = pick(("acq_date", "Datetime", "timestamp", "date", "observed_at_utc", "t"))
    aggs = [F.count("*").alias("sample_rows")]
    for c, tag in ((lat, "lat"), (lon, "lon"), (t, "time")):
        if c:
            aggs += [F.min(c).alias(f"{tag}_min"), F.max(c).alias(f"{tag}_max")]
    return sample.agg(*aggs).withColumns({"columns": F.lit(",".join(df.columns)), "dtypes": F.lit(",".join(ty for _, ty in df.dtypes))})


def build_manifest(runs: DataFrame, leads: list[int], specs: DataFrame, availability: DataFrame) -> DataFrame:
    """Every (run, lead, variable) with its availability; leads are generated, not cross-joined.

    ``runs`` holds (run_id, init), ``specs`` holds (run_id, spec), ``availability`` holds (run_id, lead_h, available).
    """
    var, level = nz.split_spec(F.col("spec"))
    d = runs.join(specs, "run_id").withColumn("lead_h", F.explode(F.array(*[F.lit(x).cast("long") for x in leads])))
    d = d.join(availability, ["run_id", "lead_h"], "left").withColumn("available", F.coalesce("available", F.lit(False)))
    valid = F.col("init") + F.make_dt_interval(F.lit(0), F.col("lead_h").cast("int"))
    d = d.withColumns({"variable": var, "level_str": level})
    return d.select("run_id", "init", "lead_h", ntz(valid).alias("valid"), "variable", "level_str", nz.level_kind(F.col("level_str")).alias("level_kind"),
                    F.when(F.col("available"), F.lit(0.0)).otherwise(F.lit(1.0)).alias("missing_fraction"), nz.availability_flag(F.col("available")).alias("quality_flag"))
