"""Small literal cases: cleaning, parsing, index, distances, physics, gates."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airlake.functions import aqi, geo, physics, timing
from airlake.operators import features, normalize as nz, qc, regrid, series
from airlake.operators.joins import GridSpec, cell_index
from airlake.sources import readers


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_station_clean_drops_one_negative_row_of_six(spark):
    vals = [80.0, 90.0, 100.0, -5.0, 70.0, 85.0]
    rows = [(k, "Delhi", dt.datetime(2025, 1, 1, k), v) for k, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "seq bigint, location_name string, observed_at_utc timestamp_ntz, pm25 double")
    kept, dropped = qc.clean_stations(df, "location_name", "observed_at_utc", "seq")
    assert kept.count() == 5 and [r.pm25 for r in dropped.collect()] == [-5.0]
    flagged = qc.station_flags(df, "location_name", "observed_at_utc", "seq")
    rep = qc.qc_report(df, flagged, "stations", "location_name", "observed_at_utc", ["pm25"]).first()
    assert (rep.valid_rows, rep.invalid_rows, rep.status) == (5, 1, "OK") and "pm25" in rep.flagged_columns.split(",")


def test_fire_clean_keeps_text_confidence(spark):
    rows = [("2025-01-01", 100, 30.0, 76.0, 40.0, "nominal"), ("2025-01-01", 100, 30.0, 76.0, 40.0, "high"), ("2025-01-01", 321, 31.0, 75.0, 5000.1, "90")]
    df = spark.createDataFrame(rows, "acq_date string, acq_time int, latitude double, longitude double, frp double, confidence string")
    out = qc.clean_fires(df).collect()
    assert len(out) == 2 and all(r.confidence == 20 for r in out) and out[0].observed_at_utc == dt.datetime(2025, 1, 1, 1)


def test_zero_deviation_modes(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 10.0), (3, "a", 10.0), (4, "a", 11.0), (5, "b", 1.0), (6, "b", 900.0)], "seq int, k string, v double")
    strict = {r.seq for r in qc.mad_flag(df, ["k"], "v").filter("is_spike").collect()}
    lenient = {r.seq for r in qc.mad_flag(df, ["k"], "v", mode="lenient").filter("is_spike").collect()}
    assert strict == {4} and lenient == set()


def test_duplicate_marks_all_but_first(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "seq int, k string")
    assert {r.seq for r in qc.mark_duplicates(df, ["k"], "seq").filter("is_duplicate").collect()} == {2, 4}
    assert {r.seq for r in qc.keep_last(df, ["k"], "seq").collect()} == {3, 4}
    assert {r.seq for r in qc.keep_first(df, ["k"], "seq").collect()} == {1, 3}


def test_gate_stops_the_job(spark):
    df = spark.range(3).toDF("x")
    assert qc.assert_min_rows(df, 3).count() == 3
    with pytest.raises(Exception, match="CRITICAL"):
        qc.assert_min_rows(df, 4, "stations").collect()


def test_box_mask(spark):
    df = spark.createDataFrame([(28.0, 77.0), (34.0, 76.0), (30.0, 80.0)], "la double, lo double")
    got = [r[0] for r in df.select(geo.in_box(F.col("la"), F.col("lo"), **geo.REGION_BOX)).collect()]
    assert got == [True, False, False]


def test_distance_and_bearing(spark):
    la, lo = (F.lit(x) for x in geo.CITY_CENTRE)
    r = one(spark, geo.haversine_km(la, lo, la, lo).alias("d"), geo.bearing_deg(F.lit(30.0), F.lit(76.0), la, lo).alias("b"))
    assert abs(r.d) < 1e-6 and 90 <= r.b <= 270


def test_local_time_and_dayfirst(spark):
    t = F.expr("timestamp_ntz'2026-01-01 06:30:00'")
    r = one(spark, timing.local_time(t).alias("a"), timing.parse_dayfirst(F.lit("12-09-2026 18:00:00")).alias("b"), timing.parse_dayfirst(F.lit("-")).alias("c"))
    assert r.a == dt.datetime(2026, 1, 1, 12) and r.b == dt.datetime(2026, 9, 12, 18) and r.c is None


@pytest.mark.parametrize("conc,index", [(60.0, 100), (90.0, 200), (120.0, 300), (30.0, 50), (400.0, 401), (250.0, 400)])
def test_sub_index_values(spark, conc, index):
    assert one(spark, aqi.sub_index("PM2.5", F.lit(conc)).alias("x")).x == index


def test_gapped_index(spark):
    r = one(spark, aqi.sub_index("PM2.5", F.lit(30.5), "gapped").alias("gap"), aqi.sub_index("PM2.5", F.lit(9999.0), "gapped").alias("top"),
            aqi.sub_index("PM2.5", F.lit(-3.0), "gapped").alias("low"), aqi.sub_index("CO", F.lit(1000.0), "gapped").alias("co"))
    assert (r.gap, r.top, r.low, r.co) == (50, 500, 0, 50)


@pytest.mark.parametrize("value,stage", [(250, 1), (320, 2), (420, 3), (460, 4), (120, 0)])
def test_action_stage(spark, value, stage):
    assert one(spark, aqi.action_stage(F.lit(value)).alias("s")).s == stage


def test_composite_takes_first_on_ties_and_skips_missing(spark):
    c = aqi.composite({"PM2.5": F.lit(60.0), "PM10": F.lit(100.0), "O3": F.lit(None).cast("double")})
    r = one(spark, *[v.alias(k) for k, v in c.items()])
    assert (r.aqi, r.dominant, r.sub_indices) == (100, "PM2.5", {"PM2.5": 100, "PM10": 100})


def test_feedback_direction(spark):
    h, s = physics.mixing_height_coupled(F.lit(1000.0), F.lit(250.0), F.lit(70.0))
    r = one(spark, h.alias("h"), s.alias("s"), physics.attenuated(F.lit(500.0), F.lit(0.4)).alias("f"))
    assert r.h <= 1000 and r.s >= 0 and 0 < r.f < 500


def test_name_matching_and_open_data_records(spark):
    stations = spark.createDataFrame([("DL-1", "Anand Vihar"), ("DL-2", "IHBAS Dilshad Garden"), ("DL-3", "Dilshad Garden")], "station_id string, name string")
    recs = [("Anand Vihar, Delhi - DPCC", "PM2.5", "182.5"), ("IHBAS, Dilshad Garden, Delhi - CPCB", "OZONE", "23"), ("Dangi Tola, Rajgir - BSPCB", "CO", "43"),
            ("Anand Vihar, Delhi - DPCC", "DEPOSIT", "12"), ("Anand Vihar, Delhi - DPCC", "PM10", "NA")]
    df = spark.createDataFrame([(s, "12-09-2026 18:00:00", p, v) for s, p, v in recs], "station string, last_update string, pollutant_id string, avg_value string")
    out = {(r.station_id, r.metric): r for r in readers.ogd_to_long(df, stations, F.expr("timestamp_ntz'2026-09-12 12:00:00'")).collect()}
    assert set(out) == {("DL-1", "PM2.5"), ("DL-2", "O3")}
    assert out["DL-1", "PM2.5"].value == 182.5 and out["DL-1", "PM2.5"].unit == "ug/m3" and out["DL-1", "PM2.5"].observed_at_utc == dt.datetime(2026, 9, 12, 18)


def test_digest_drops_unknown_place_and_empty_cells(spark):
    stations = spark.createDataFrame([("DL-1", "Anand Vihar")], "station_id string, name string")
    cols = "location string, sampling_date string, SO2 string, NO2 string, `PM2.5` string, PM10 string, CO string, OZONE string, NH3 string"
    df = spark.createDataFrame([(" anand vihar ", "01-09-2026", "5", "", "182.4", "-", None, "20", "NA"), ("Unknown Town", "01-09-2026", "5", "1", "1", "1", "1", "1", "1")], cols)
    assert {(r.metric, r.value, r.unit) for r in readers.digest_to_long(df, stations).collect()} == {("SO2", 5.0, "ppb"), ("PM2.5", 182.4, "ug/m3"), ("O3", 20.0, "ppb")}


def test_manifest_marks_missing_leads(spark):
    runs = spark.createDataFrame([("r1", dt.datetime(2026, 9, 12))], "run_id string, init timestamp_ntz")
    specs = spark.createDataFrame([("r1", "TMP:2 m above ground"), ("r1", "tmp:850 mb"), ("r1", "PRMSL")], "run_id string, spec string")
    avail = spark.createDataFrame([("r1", 0, True), ("r1", 3, False)], "run_id string, lead_h bigint, available boolean")
    rows = readers.build_manifest(runs, [0, 3, 6], specs, avail).collect()
    assert len(rows) == 9 and sum(r.quality_flag == "MISSING" for r in rows) == 6
    assert {r.level_kind for r in rows if r.level_str == "850 mb"} == {"pressure"} and {r.level_str for r in rows if r.variable == "PRMSL"} == {"surface"}


def test_bilinear_is_exact_on_a_plane_and_clips(spark):
    src = [(0, float(a), float(b), 2.0 * a + 3.0 * b) for a in (30, 20, 10) for b in (70, 75, 80)]
    s = spark.createDataFrame(src, "h int, lat double, lon double, v double")
    t = spark.createDataFrame([(1, 12.5, 71.0), (2, 30.0, 80.0), (3, 99.0, 0.0)], "k int, lat double, lon double")
    got = {r.k: r.v for r in regrid.regrid_bilinear(s, t, ["v"], ["h"], ["k"]).collect()}
    assert got == pytest.approx({1: 2 * 12.5 + 3 * 71, 2: 60 + 240, 3: 60 + 210})


def test_cell_index_strict_and_clamped(spark):
    g = GridSpec(20, 22)
    i, j = cell_index(F.lit(99.0), F.lit(0.0), g)
    si, sj = cell_index(F.lit(99.0), F.lit(0.0), g, "strict")
    r = one(spark, i.alias("i"), j.alias("j"), si.alias("si"), sj.alias("sj"))
    assert (r.i, r.j, r.si, r.sj) == (0, 21, None, None)


def test_lags_never_look_ahead(spark):
    df = spark.createDataFrame([("a", dt.datetime(2025, 1, 1, h), float(h)) for h in range(10)], "city string, t timestamp_ntz, v double")
    rows = series.add_lags(df, ["city"], "t", ["v"]).orderBy("t").collect()
    assert [r.v_lag1 for r in rows] == [None, *map(float, range(9))] and rows[9].v_lag3 == 6.0 and rows[9].v_lag12 is None


def test_field_at_lead_out_of_range_is_empty(spark):
    df = spark.createDataFrame([(t, s) for t in range(72) for s in range(3)], "t int, s int")
    assert series.field_at_lead(df, "t", 12).count() == 3 and series.field_at_lead(df, "t", 999).count() == 0


def test_feature_order():
    assert len(features.RAW_FEATURES) == 17 and len(features.ENGINEERED_FEATURES) == 15


def test_satellite_rows(spark):
    rows = [("28.6", "77.2", "2026-09-12", 705, "N", "NPP", "45.2", "90%"), ("28.6", "77.2", "2026-09-12", 705, "N", "NPP", "45.2", "90%"),
            ("28.6", "77.2", "2026-09-12", 5, "D", " aqua", "-3", "low"), ("28.6", "77.2", "bad", 5, "D", "NPP", "1", "90"), ("28.6", "77.2", "2026-09-12", 5, "D", "GOES", "1", "90")]
    df = spark.createDataFrame(rows, "latitude string, longitude string, acq_date string, acq_time int, daynight string, satellite string, frp string, confidence string")
    out = nz.normalize_fires(df.withColumns({"bright_ti4": F.lit("x"), "scan": F.lit("0.4"), "track": F.lit("0.4")})).collect()
    assert [r.satellite for r in out] == ["VIIRS_SNPP", "VIIRS_SNPP", "MODIS_AQUA"] and out[0].fire_id == out[1].fire_id
    assert out[2].frp_mw == 0.0 and out[2].brightness_kelvin == 350.0 and out[2].quality_flag == "SUSPECT" and out[0].acq == dt.datetime(2026, 9, 12, 7, 5)
