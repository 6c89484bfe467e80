"""A cross-section of the registered queries against their SQL; tests/oracle.py runs them all."""

from __future__ import annotations

import pytest
from oracle import DATA, connect, differences

import __spark_entry__ as entry_points
from triptally.registry import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"
SAMPLE = (
    "state_accommodation", "state_accommodation_cap", "division_restaurant", "national_retail",
    "retail_cap_test", "county_basket_index", "state_basket_index", "retail_filter_funnel",
    "scan_csv_glob", "sink_replace_month", "win_rolling_3mo", "agg_percentile_vector",
)


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, name):
    expected = db.sql(entry_points.oracle_sql()[name])
    frame = entry_points.queries()[name](spark, FOLDER)
    assert differences(frame.columns, frame.collect(), expected.columns, expected.fetchall()) == []


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_returns_the_index(spark):
    frame = entry_points.entry(spark)
    assert "cost_per_trip" in frame.columns and frame.count() > 0
