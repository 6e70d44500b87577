"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

# Driver test tables (see TESTDATA.md).
TABLES: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

# Source files of the monitoring feeds.
CITY_HOUR_CSV = (
    "City STRING, State STRING, Latitude STRING, Longitude STRING, Datetime STRING, Temp_2m_C STRING, "
    "Humidity_Percent STRING, Wind_Speed_10m_kmh STRING, Wind_Dir_10m STRING, Solar_Radiation_Wm2 STRING, "
    "Cloud_Cover_Percent STRING, PM2_5_ugm3 STRING, PM10_ugm3 STRING, CO_ugm3 STRING, NO2_ugm3 STRING, "
    "SO2_ugm3 STRING, O3_ugm3 STRING, AOD STRING, Temp_Inversion STRING, Wind_Stagnation STRING, "
    "Crop_Burning_Season STRING"
)
FIRE_CSV = (
    "latitude DOUBLE, longitude DOUBLE, bright_ti4 STRING, scan STRING, track STRING, acq_date STRING, "
    "acq_time INT, satellite STRING, instrument STRING, confidence STRING, version STRING, bright_ti5 STRING, "
    "frp DOUBLE, daynight STRING"
)
REGISTRY_CSV = (
    "station_id STRING, name STRING, lat DOUBLE, lon DOUBLE, district STRING, state STRING, "
    "is_manual STRING, source STRING"
)
OGD_JSON = (
    "country STRING, state STRING, city STRING, station STRING, last_update STRING, latitude STRING, "
    "longitude STRING, pollutant_id STRING, min_value STRING, max_value STRING, avg_value STRING"
)
SERIES_ITEM = (
    "updated_at STRING, SO2 STRING, NO2 STRING, `PM2.5` STRING, PM10 STRING, CO STRING, OZONE STRING, NH3 STRING"
)

# Canonical records.
OBSERVATION = (
    "seq BIGINT, station_id BIGINT, metric STRING, value DOUBLE, observed_at_utc TIMESTAMP_NTZ"
)
FIRE_EVENT = "fire_id STRING, frp DOUBLE, acq TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE"
