"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "airlake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A UTC, ANSI session with adaptive execution on; cluster settings win where given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only in local mode, where every task sees the same disk, a temporary folder is
    used if the setting is absent; on a cluster its absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.gettempdir()


#: Folders of this process's applications, by application and shared folder.
_RUNS: dict[tuple[str, str], str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one.  It holds intermediate data only and is removed when the driver's process ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _RUNS:
        _RUNS[key] = f"{key[1].rstrip('/')}/airlake-{key[0]}-{uuid.uuid4().hex}"
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(_remove, jvm, conf, _RUNS[key])
    return _RUNS[key]


def _remove(jvm, conf, path: str) -> None:
    """Remove a folder wherever it lies; what can't be reached any more stays."""
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception as gone:  # noqa: BLE001
        logging.getLogger(__name__).warning("%s not removed: %s", path, gone)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below this run's folder; nothing existing is overwritten."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{run_dir(spark)}/checkpoints")
    return df.checkpoint(eager=True)
