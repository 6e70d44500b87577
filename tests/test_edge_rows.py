"""Rows that the test tables don't hold: unpadded dates, nulls in keys, repeated names, unreadable times, NaN."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from airlake.functions import aqi
from airlake.operators import graph, joins, qc
from airlake.operators.normalize import normalize_fires
from airlake.session import shared_dir
from airlake.sources import inventory, writers

FIRE = "latitude string, longitude string, acq_date string, acq_time string, satellite string, frp string, bright_ti4 string, confidence string, scan string, track string, daynight string"


def fires(spark, *rows):
    base = ("28.5", "77.0", "2024-01-05", "130", "NPP", "10", "330", "90", "0.4", "0.4", "D")
    names = [c.split()[0] for c in FIRE.split(", ")]
    return spark.createDataFrame([tuple({**dict(zip(names, base)), **r}[n] for n in names) for r in rows], FIRE)


def test_unpadded_dates_and_unreadable_times(spark):
    df = fires(spark, {}, {"acq_date": "2024-1-5"}, {"acq_date": " 2024-01-5 "}, {"acq_date": "2024"}, {"acq_date": "05/01/2024"}, {"acq_time": "noon"}, {"acq_time": None}, {"acq_date": None})
    clean = qc.clean_fires(df).collect()
    assert len(clean) == 3 and len({r.observed_at_utc for r in clean}) == 1
    norm = normalize_fires(df).collect()
    assert len(norm) == 4 and len({r.acq for r in norm}) == 2


def test_fire_ids_tell_missing_parts_apart(spark):
    df = fires(spark, {"scan": None, "track": "0.4"}, {"scan": "0.4", "track": None})
    assert normalize_fires(df).select("fire_id").distinct().count() == 2


def test_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", None), (4, "a", "x")], "seq long, k string, l string")
    got = {r.seq: r.is_duplicate for r in qc.mark_duplicates(df, ["k", "l"], "seq").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_repeated_registry_names(spark):
    df = spark.createDataFrame([(" Alpha ", 1.0), ("beta", 2.0), ("none", 3.0)], "station string, value double")
    reg = spark.createDataFrame([(1, "alpha", 10.0), (2, "ALPHA", 20.0), (3, "beta", None)], "station_id long, name string, lat double")
    got = sorted((r.value, r.station_id, r.lat) for r in joins.registry_join(df, reg, "station").collect())
    assert got == [(1.0, 2, 20.0), (2.0, 3, None)]


@pytest.mark.parametrize("variant", ["contiguous", "gapped"])
def test_sub_index_of_nan_and_null(spark, variant):
    df = spark.createDataFrame([(float("nan"),), (None,), (30.0,)], "x double")
    got = [r.s for r in df.select(aqi.sub_index("PM2.5", F.col("x"), variant).alias("s")).collect()]
    assert got[:2] == [None, None] and got[2] is not None


def test_colocated_stations_have_an_edge(spark):
    df = spark.createDataFrame([(1, 28.5, 77.0), (2, 28.5, 77.0), (3, 28.6, 77.0)], "station_id long, lat double, lon double")
    pairs = {(r.src, r.dst) for r in graph.wind_edges(df, 20.0).collect()}
    assert {(1, 2), (2, 1), (1, 3), (3, 2)} <= pairs


def test_tier_is_the_folder_below_the_root(spark, tmp_path):
    root = str(tmp_path / "features" / "lake")
    writers.write_tier(spark.range(3).withColumnRenamed("id", "x"), root, "raw", "t")
    assert {r.tier for r in inventory.tier_sizes(spark, root).collect()} == {"raw", "total"}


def test_oversize_files_raise(spark):
    files = spark.createDataFrame([("a", "s", 5)], "name string, sha256 string, length long")
    known = files.where("1 = 0")
    assert inventory.new_files(files, known, max_bytes=5).count() == 1
    with pytest.raises(Exception, match="size limit"):
        inventory.new_files(files, known, max_bytes=4).collect()


def test_no_silent_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_ingest_rules(spark, tmp_path):
    from airlake.sources.ingest import ingest_run, read_ledger

    base, ledger = str(tmp_path / "p"), str(tmp_path / "l")
    df = spark.createDataFrame([(1, 5.0), (2, -1.0)], "seq long, value double")
    rules = [("negative", F.col("value") < 0)]
    assert ingest_run(df.where("1 = 0"), rules, base, ledger, "cpcb", "2024-01-01", "a").written == 0 and read_ledger(spark, ledger).count() == 0
    with pytest.raises(ValueError, match="negative"):
        ingest_run(df.where("value < 0"), rules, base, ledger, "cpcb", "2024-01-01", "a")
    assert ingest_run(df.where("value < 0"), rules, base, ledger, "gfs", "2024-01-01", "a", may_lose_all=True).written == 0
    got = ingest_run(df, rules, base, ledger, "cpcb", "2024-01-01", "a")
    assert (got.written, got.reasons, got.skipped) == (1, {"negative": 1}, False)
    assert ingest_run(df, rules, base, ledger, "cpcb", "2024-01-01", "a").skipped
    assert [(r.run_id, r.kept, r.dropped) for r in read_ledger(spark, ledger).collect()] == [("a", 1, 1)]
    assert spark.read.parquet(base).count() == 1
