"""Sinks: idempotent partitions, lake tiers with a side-car, and partition reads gated by the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

TIERS = ("raw", "interim", "processed", "features")


def write_partition(df: DataFrame, base: str) -> None:
    """Write (source, dt, run_id) partitions; a repeated run replaces only its own partitions.

    Empty input writes nothing.  The commit marker of the job plays the role of a done marker.
    """
    (df.write.partitionBy("source", "dt", "run_id").option("compression", "zstd").option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").parquet(base))


def read_partition(spark: SparkSession, base: str, schema: str, source: str, dt: str, run_id: str, ledger: DataFrame | None = None) -> DataFrame:
    """One partition, pruned at planning; nothing when the ledger does not list the run as complete."""
    d = spark.read.schema(schema).parquet(base).filter((F.col("source") == source) & (F.col("dt") == F.lit(dt).cast("date")) & (F.col("run_id") == run_id))
    if ledger is not None:
        done = ledger.filter("complete").select("source", "dt", F.col("run_id").cast("string").alias("run_id"))
        d = d.join(done, ["source", "dt", "run_id"], "left_semi")
    return d


def write_tier(df: DataFrame, root: str, tier: str, name: str) -> None:
    """Table under ``root/tier/name`` and a JSON side-car with rows, columns and write time."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier}")
    path = f"{root}/{tier}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = df.sparkSession
    meta = spark.read.schema(df.schema).parquet(path).agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("table"), F.lit(tier).alias("tier"), "rows", F.lit(",".join(df.columns)).alias("columns"), F.current_timestamp().alias("written_at"))
    meta.coalesce(1).write.mode("overwrite").json(f"{root}/{tier}/_meta/{name}")


def write_gated(df: DataFrame, path: str, minimum: int, source: str = "source") -> int:
    """Write a table whose rows are counted on their way; the job stops when there are fewer than ``minimum``.

    One pass over ``df``.  A table that failed stays without its entry in a ledger, and a repeated write replaces it.
    """
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    rows = seen.get["rows"]
    if rows < minimum:
        raise ValueError(f"CRITICAL: '{source}' has {rows} valid rows, fewer than {minimum}")
    return rows
