"""The county queries cover every county in every month of their period, with data or without."""

from __future__ import annotations

import pytest
from oracle import DATA, connect, differences

from triptally.registry import ORACLES, QUERIES
from triptally.registry.base import FIRST, LAST

FOLDER = f"{DATA}/sf0.001"
MONTHS = 12 * (LAST.year - FIRST.year + 1)
NAMES = (
    "agg_validation_report",
    "fn_fill_counts",
    "fn_output_schema",
    "fn_meets_threshold",
    "county_basket_index",
    "join_county_anchor",
    "sink_append_schema",
)


@pytest.mark.parametrize("name", NAMES)
def test_no_month_is_left_out(spark, name):
    expected = connect(FOLDER).sql(ORACLES[name])
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    assert differences(frame.columns, rows, expected.columns, expected.fetchall()) == []
    codes = {r.county_fips for r in QUERIES["distinct_counties"](spark, FOLDER).collect()}
    if name == "agg_validation_report":
        assert [r.rows_processed for r in rows] == [len(codes) * MONTHS]
        return
    found = {(r.county_fips, r.month_date) for r in rows}
    assert len(rows) == len(found) == len(codes) * MONTHS
    assert {county for county, _ in found} == codes
    assert (min(m for _, m in found), max(m for _, m in found)) == (FIRST, LAST.replace(day=1))
