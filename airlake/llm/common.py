"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from airlake.session import new_dir

#: Columns of the ``documents`` table; every filtering stage of the pipeline returns them.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: What the contracts call white space.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own setting: shuffle files of a job go when it ends, not when the driver's JVM collects what refers to them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def publish(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    With ``clean`` the shuffle files of the write go at once, so that those of several steps don't add up; ``df`` itself is not to be run again.
    """
    return published(df, label, clean)[0]


def published(df: DataFrame, label: str, clean: bool = False) -> tuple[DataFrame, str]:
    """As ``publish``, with the path, for a step that is to be discarded before the run ends."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true" if clean else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a published step that no frame reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after the last one the worker gives back the memory that Arrow keeps for later."""
    yield from batches
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose text has about ``most`` bytes, so that temporaries stay small.

    A single longer text is one slice: rows are never cut.
    """
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``start``, one run after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null counts as empty."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0]:at[-1]]
