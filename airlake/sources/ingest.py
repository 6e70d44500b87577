"""One ingest run: skip if complete, account for what is dropped, write the partition, enter it in the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airlake.operators.qc import first_reason
from airlake.sources import ledger as runs
from airlake.sources.writers import write_partition

LEDGER_SCHEMA = "source string, dt date, run_id string, complete boolean, kept bigint, dropped bigint"


@dataclass
class IngestResult:
    source: str
    run_id: str
    skipped: bool = False
    written: int = 0
    reasons: dict[str, int] = field(default_factory=dict)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows; none where nothing was entered yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def ingest_run(records: DataFrame, rules: list[tuple[str, Column]], base: str, ledger: str, source: str, dt: str, run_id: str,
               may_lose_all: bool = False) -> IngestResult:
    """Persist the records that no rule drops as one partition and enter the run.

    A run that the ledger lists as complete is skipped.  Without records nothing is persisted; records that are all dropped are
    an error unless the source ``may_lose_all``.  Only the counts per reason reach the driver.
    """
    spark = records.sparkSession
    out = IngestResult(source, run_id)
    this = spark.createDataFrame([(source, dt, run_id)], "source string, dt string, run_id string").withColumn("dt", F.col("dt").cast("date"))
    if runs.pending_runs(this, read_ledger(spark, ledger)).isEmpty():
        out.skipped = True
        return out
    judged = records.withColumn("_reason", first_reason(rules))
    counts = {r._reason: r.n for r in judged.groupBy("_reason").agg(F.count("*").alias("n")).collect()}
    kept = counts.pop(None, 0)
    out.reasons = counts
    if not kept:
        if counts and not may_lose_all:
            raise ValueError(f"all {source} records of run {run_id} were dropped: {counts}")
        return out
    rows = judged.filter("_reason is null").drop("_reason")
    write_partition(rows.withColumns({"source": F.lit(source), "dt": F.lit(dt).cast("date"), "run_id": F.lit(run_id)}), base)
    out.written = kept
    # the entry comes last: a run that broke off before it is simply done again
    entry = this.select("*", F.lit(True).alias("complete"), F.lit(kept).cast("bigint").alias("kept"), F.lit(sum(counts.values())).cast("bigint").alias("dropped"))
    entry.coalesce(1).write.mode("append").parquet(ledger)
    return out
