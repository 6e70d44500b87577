"""Run ledger: which (source, date, run) partitions are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["source", "dt", "run_id"]


def complete_runs(ledger: DataFrame, source: str | None = None) -> DataFrame:
    d = ledger.filter("complete")
    return d.filter(F.col("source") == source) if source else d


def partitions(ledger: DataFrame, source: str, descending: bool = False, n: int | None = None) -> DataFrame:
    """Complete partitions in date and run order."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("dt", "run_id")]
    d = complete_runs(ledger, source).select(*KEY).distinct().orderBy(*order)
    return d.limit(n) if n else d


def latest_partition(ledger: DataFrame, source: str | None = None) -> DataFrame:
    """Newest complete (date, run) per source; a map-side combined maximum."""
    return complete_runs(ledger, source).groupBy("source").agg(F.max(F.struct("dt", "run_id")).alias("m")).select("source", "m.dt", "m.run_id")


def pending_runs(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidate runs that are not complete yet."""
    return candidates.join(complete_runs(ledger).select(*KEY), KEY, "left_anti")


def source_health(ledger: DataFrame) -> DataFrame:
    done = F.col("complete")
    return ledger.groupBy("source").agg(
        F.count_if(done).alias("n_complete"), F.max(F.when(done, F.struct("dt", "run_id"))).alias("_m"), F.countDistinct("run_id").alias("n_runs"),
    ).select("source", "n_complete", F.col("_m.dt").alias("last_date"), F.col("_m.run_id").alias("last_run"), "n_runs")
