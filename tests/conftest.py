from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g pyspark-shell")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from airlake.session import build_session

    s = build_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tests.compare import views

    con = duckdb.connect()
    views(con, SMALL)
    return con
