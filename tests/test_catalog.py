"""Every registered query against its SQL on the smallest data folder."""

import pytest
from tallyward.plans.catalog import QUERIES
from compare import connect, entry, oracle_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# These three read other tables of the same stream as stream_zone_counts; test_stream.py covers them.
SAME_STREAM = {"stream_processing_counts", "stream_late_events", "stream_open_windows"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SAME_STREAM])
def test_query(spark, duck, name):
    got = spark_rows(entry.queries()[name](spark, SF))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got[1]
    else:
        assert got == oracle_rows(duck, sql)


def test_entry(spark):
    assert entry.entry(spark).columns == ["zone", "window_start", "trip_count"]


def test_sql_names_are_query_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
