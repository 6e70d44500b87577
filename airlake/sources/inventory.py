"""File inventory, checksums, tier sizes, table profiles and the source registry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

TIME_COLUMNS = ("observed_at_utc", "Datetime", "datetime", "timestamp", "acq_date", "t")
LAT_COLUMNS = ("Latitude", "latitude", "location_lat", "lat")
LON_COLUMNS = ("Longitude", "longitude", "location_lon", "lon")


def _listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def _hash_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each file, read in 1 MiB blocks, so file size does not matter."""
    from pyarrow import fs

    for pdf in batches:
        sums = []
        for path in pdf["path"]:
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
            store, name = fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with store.open_input_stream(name) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pdf.assign(sha256=sums)


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size, modification time and SHA-256 per file."""
    return _listing(spark, root).mapInPandas(_hash_batches, "path string, length bigint, modified timestamp, sha256 string")


def tier_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per tier, markers excluded; file contents are never read."""
    d = _listing(spark, root).withColumn("_name", F.element_at(F.split("path", "/"), -1)).filter("not (_name like '\\_%' or _name like '.%')")
    # the tier is the folder right below the root, wherever the root lies
    below = F.element_at(F.split("path", F.lit("/" + root.rstrip("/").rsplit("/", 1)[-1] + "/")), -1)
    tier = F.regexp_extract(below, r"^(raw|interim|processed|features)/", 1)
    d = d.filter(tier != "").groupBy(tier.alias("tier")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    total = d.agg(F.lit("total").alias("tier"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return d.unionByName(total)


def tier_tables(spark: SparkSession, root: str, tiers: tuple[str, ...] = ("raw", "interim", "processed", "features")) -> DataFrame:
    """Tables and rows per tier, as their side-cars tell, with a zero row for an empty tier, and the total."""
    meta = spark.read.schema("table string, tier string, rows long").json(f"{root}/*/_meta/*")
    per = meta.groupBy("tier").agg(F.count("*").alias("tables"), F.sum("rows").alias("n_rows"))
    every = spark.createDataFrame([(t,) for t in tiers], "tier string").join(per, "tier", "left").fillna(0)
    return every.unionByName(every.agg(F.lit("total").alias("tier"), F.sum("tables").alias("tables"), F.sum("n_rows").alias("n_rows")))


def new_files(files: DataFrame, known: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files whose (name, checksum) is not known yet; a file above the limit fails the job."""
    d = files.join(known.select("name", "sha256"), ["name", "sha256"], "left_anti")
    if max_bytes is not None:
        size = F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("file over the size limit: "), "name")).cast("long")).otherwise(F.col("length"))
        d = d.withColumn("length", size)
    return d


def profile(df: DataFrame, name: str) -> DataFrame:
    """One row in one pass: rows, columns, time and place range, share of missing cells."""
    pick = lambda names: next((c for c in names if c in df.columns), None)
    t, la, lo = pick(TIME_COLUMNS), pick(LAT_COLUMNS), pick(LON_COLUMNS)
    aggs = [F.count("*").alias("n_rows"), sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).alias("_full")]
    if t:
        aggs += [F.min(t).alias("date_min"), F.max(t).alias("date_max")]
    if la and lo:
        aggs += [F.round(f(c), 4).alias(n) for c, f, n in ((la, F.min, "lat_min"), (la, F.max, "lat_max"), (lo, F.min, "lon_min"), (lo, F.max, "lon_max"))]
    width = len(df.columns)
    cells = F.col("n_rows") * F.lit(width)
    pct = F.round(F.lit(100.0) * (cells - F.col("_full")) / F.greatest(cells, F.lit(1)), 3)
    return df.agg(*aggs).withColumns({"table": F.lit(name), "columns": F.lit(",".join(df.columns)), "missing_percentage": pct}).drop("_full")


def upsert(base: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """One record per source; for each field the latest value that is present wins (map-side combined)."""
    d = base.unionByName(updates, allowMissingColumns=True)
    fields = [c for c in d.columns if c not in (key, seq)]
    return d.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields])
