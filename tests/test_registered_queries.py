"""Every registered query against its check SQL (or against its row shape) on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from airlake.plans import registry
from tests.compare import differences
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
ROWS_ONLY: set[str] = set()
#: The smallest tables have 47 test rows, too few to tell a learner from persistence.
LEARNED = {"gbt_direct", "gbt_residual", "feature_ablation"}


def test_only_expected_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLES) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LEARNED))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert differences(df, df.collect(), duck.execute(ORACLES[name])) == []


def test_file_inventory(spark):
    import glob
    import hashlib
    import os

    from airlake.sources import inventory

    got = {os.path.basename(r.path): (r.length, r.sha256) for r in inventory.inventory(spark, SMALL).collect()}
    for path in glob.glob(f"{SMALL}/*.parquet"):
        with open(path, "rb") as f:
            data = f.read()
        assert got[os.path.basename(path)] == (len(data), hashlib.sha256(data).hexdigest())


def test_tier_bytes(spark, tmp_path):
    from airlake.sources import inventory, writers

    for tier, n in (("raw", 50), ("features", 5)):
        writers.write_tier(spark.range(n).withColumnRenamed("id", "x"), str(tmp_path), tier, "t")
    rows = {r.tier: r for r in inventory.tier_sizes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"raw", "features", "total"}
    assert rows["total"].bytes == rows["raw"].bytes + rows["features"].bytes > 0


@pytest.mark.parametrize("name", sorted(LEARNED))
def test_learned_matches_sql(spark, name):
    import duckdb

    from tests.compare import views

    con = duckdb.connect()
    views(con, MEDIUM)
    df = QUERIES[name](spark, MEDIUM)
    assert differences(df, df.collect(), con.execute(ORACLES[name])) == []


def _rmse(rows, forecast):
    return (sum((r.yobs - r[forecast]) ** 2 for r in rows) / len(rows)) ** 0.5


def test_models_score_test_rows_only_and_beat_persistence(spark):
    from airlake.operators import models
    from airlake.plans.models import model_frame

    d = model_frame(spark, MEDIUM)
    direct = models.gbt_direct(d, ["city"], "t", "pm25", context=6).collect()
    residual = models.gbt_residual(d, ["city"], "t", "pm25", "base").collect()
    for rows in (direct, residual):
        assert rows and all(r.yhat is not None and r.t.day >= 25 for r in rows)
        assert _rmse(rows, "yhat") < 0.95 * _rmse(rows, "base")


def test_fits_do_not_depend_on_each_other(spark):
    from airlake.operators import models
    from airlake.plans.models import model_frame

    d = model_frame(spark, MEDIUM)
    columns = {"a": ["base"], "b": ["base", "temp"], "c": ["temp", "wd"]}
    said = {}
    for parallelism in (1, 3):
        out = models.fit_predict(d, "split = 'train'", "split = 'test'", columns, "pm25", 3, 3, 5, parallelism)
        said[parallelism] = {(k, r.city, r.t): r._p for k, v in out.items() for r in v.collect()}
    assert said[1] == pytest.approx(said[3], rel=1e-9) and len(said[1]) > 300
    none = models.fit_predict(d, "split = 'nothing'", "split = 'test'", columns, "pm25", 3, 3, 5)
    assert {r._p for r in none["b"].collect()} == {None}


def test_ablation_has_six_configurations(spark):
    rows = {r.config: r for r in QUERIES["feature_ablation"](spark, MEDIUM).collect()}
    assert sorted(rows) == list("ABCDEF") and len({r.n for r in rows.values()}) == 1


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["station_id", "t", "aqi", "dominant", "category", "stage"] and df.count() > 0
