from __future__ import annotations

from datetime import date

import pytest
from spending import DAY, Till, shop, spend_tables

from triptally.config import (
    ACCOMMODATION,
    CATEGORIES,
    RESTAURANT,
    RETAIL,
    IndexConfig,
)
from triptally.operators.joins import DIVISION, NATIONAL, STATE
from triptally.plans.category import (
    category_cost,
    category_costs,
    level_prices,
    visitor_rows,
)

JULY = IndexConfig(date(2025, 7, 1), date(2025, 7, 31), sample_exclude=2, sample_rolling=3)
BRIDGE = [
    ("California", "CA", "06", "West", "Pacific"),
    ("Oregon", "OR", "41", "West", "Pacific"),
    ("Nevada", "NV", "32", "West", "Mountain"),
]


def amounts(tables, category, config=JULY, level=STATE):
    rows = visitor_rows(tables, [category], level, config)
    return sorted(r.trans_amount for r in rows.collect())


def test_edges_of_every_filter(spark):
    shops = [
        shop("in", "7011"), shop("low", "3501"), shop("high", "3838"),
        shop("below", "3500"), shop("above", "3839"), shop("online", "7011", kind=1),
        shop("abroad", "7011", country=None), shop("nowhere", "7011", state=None),
        shop("longer", "35011"),
    ]
    till = Till()
    till.buy("in", "a", 50.0).buy("in", "a", 49.99).buy("in", "a", 51.0, distance=60.0)
    till.buy("in", "a", 52.0, distance=60.01).buy("in", "a", 53.0, day=date(2025, 7, 31))
    till.buy("in", "a", 54.0, day=date(2025, 8, 1)).buy("in", "a", 55.0, day=date(2025, 6, 30))
    till.buy("low", "a", 56.0).buy("high", "a", 57.0).buy("below", "a", 58.0)
    till.buy("above", "a", 59.0).buy("online", "a", 60.0).buy("abroad", "a", 61.0)
    till.buy("nowhere", "a", 62.0).buy("in", "a", 63.0, ref=date(2025, 7, 11))
    till.buy("missing", "a", 64.0).buy("longer", "a", 65.0)
    tables = spend_tables(spark, till.rows, shops)
    # Codes compare as text: 35011 lies between 3501 and 3838.
    assert amounts(tables, ACCOMMODATION) == [50.0, 52.0, 53.0, 56.0, 57.0, 62.0, 65.0]
    result = category_cost(tables, ACCOMMODATION, STATE, JULY).collect()
    assert [r.merch_state for r in result] == ["CA"]


def test_snapshots_join_once_or_fan_out(spark):
    weeks = [date(2025, 7, 4), date(2025, 7, 11)]
    shops = [shop("m", "5812", ref=week) for week in weeks]
    tables = spend_tables(spark, Till().buy("m", "a", 10.0).buy("m", "b", 20.0).rows, shops)
    assert amounts(tables, RESTAURANT) == [10.0, 20.0]
    every = JULY.with_(snapshot_join=False)
    rows = visitor_rows(tables, [RESTAURANT], STATE, every).collect()
    # One row per purchase, whatever the number of snapshots; that number is a weight.
    assert sorted((r.trans_amount, r.snapshots) for r in rows) == [(10.0, 2), (20.0, 2)]
    result = category_cost(tables, RESTAURANT, STATE, every.with_(trim=None)).collect()
    assert [(r.transaction_count, r.unique_visitors) for r in result] == [(4, 2)]
    assert amounts(tables, RESTAURANT, JULY.with_(ref_dates=(weeks[1], weeks[1]))) == []


def test_prices_flag_and_metadata(spark):
    till = Till()
    for i, card in enumerate(["a", "b", "c", "c"]):
        till.buy("m", card, 10.0 * (i + 1))
    till.buy("n", "a", 8.0)
    shops = [shop("m", "5812"), shop("n", "5812", state="NV")]
    tables = spend_tables(spark, till.rows, shops)
    california, nevada = category_cost(tables, RESTAURANT, STATE, JULY).collect()
    assert (california.merch_state, california.month_date) == ("CA", date(2025, 7, 1))
    assert (california.breakfast_lunch_cost, california.dinner_cost) == (20.0, 30.0)
    assert (california.transaction_count, california.unique_visitors) == (4, 3)
    assert (california.data_quality_flag, nevada.data_quality_flag) == ("SINGLE_MONTH", "EXCLUDE")
    assert (california.period_start, california.period_end) == (JULY.start, JULY.end)
    assert california.calculation_timestamp is not None
    assert (nevada.median_meal_cost, nevada.transaction_count) == (8.0, 1)


def test_flag_can_count_transactions(spark):
    till = Till().buy("m", "a", 10.0, times=3)
    tables = spend_tables(spark, till.rows, [shop("m", "5812")])
    by_visitor = category_cost(tables, RESTAURANT, STATE, JULY).first()
    by_purchase = category_cost(tables, RESTAURANT, STATE, JULY.with_(flag_basis="transactions"))
    assert by_visitor.data_quality_flag == "EXCLUDE"
    assert by_purchase.first().data_quality_flag == "SINGLE_MONTH"


def busy_month():
    till = Till()
    for i in range(12):
        till.buy("ca" if i % 2 else "nv", "hot", 5.0 if i < 9 else 20.0 + i)
    for i in range(20):
        till.buy("ca", f"c{i % 6}", 30.0 + i, day=date(2025, 7, 2 + i % 3))
        till.buy("xx", f"c{i % 4}", 12.0 + i)
    shops = [shop("ca", "5942"), shop("nv", "5942", state="NV"), shop("xx", "5942", state="XX")]
    return till.rows, shops


def test_cap_that_never_binds_changes_nothing(spark):
    tables = spend_tables(spark, *busy_month())
    plain = category_cost(tables, RETAIL, STATE, JULY).collect()
    capped = category_cost(tables, RETAIL, STATE, JULY.with_(daily_cap=1000)).collect()
    for a, b in zip(plain, capped, strict=True):
        assert (a.merch_state, a.retail_cost, a.unique_visitors) == (
            b.merch_state, b.retail_cost, b.unique_visitors,
        )
        assert a.transaction_count == b.transaction_count_final
        assert b.txn_capped == 0 and b.cardholders_affected_by_cap == 0


def test_cap_ranks_across_states_before_trimming(spark):
    tables = spend_tables(spark, *busy_month())
    config = JULY.with_(daily_cap=4, trim=None)
    result = {r.merch_state: r for r in category_cost(tables, RETAIL, STATE, config).collect()}
    # The hot card keeps 29, 30, 31 and one of nine purchases of 5, the one in CA.
    assert (result["NV"].txn_before_cap, result["NV"].txn_after_cap) == (6, 1)
    assert (result["CA"].txn_before_cap, result["CA"].txn_after_cap) == (26, 23)
    assert result["NV"].cardholders_affected_by_cap == 1
    # XX: four cards with five purchases each on one day.
    assert result["XX"].txn_capped == 4
    assert result["XX"].frequent_high_volume_shoppers == 4
    for row in result.values():
        assert row.txn_before_cap == row.txn_after_cap + row.txn_capped
        assert row.transaction_count_final <= row.txn_after_cap


def test_state_without_division_drops_before_ranking(spark):
    tables = spend_tables(spark, *busy_month(), BRIDGE)
    rows = visitor_rows(tables, [RETAIL], DIVISION, JULY)
    assert {r.census_region_division for r in rows.collect()} == {"Pacific", "Mountain"}
    result = category_cost(tables, RETAIL, DIVISION, JULY.with_(daily_cap=4)).collect()
    assert {r.census_region_division for r in result} == {"Pacific", "Mountain"}


def test_one_pass_over_categories_equals_single_runs(spark):
    rows, shops = busy_month()
    more = Till()
    more.rows = list(rows)
    for i in range(15):
        more.buy("hotel", f"c{i % 5}", 40.0 + 3 * i)
        more.buy("diner", f"c{i % 7}", 9.0 + i)
        more.buy("zoo", f"c{i % 3}", 20.0 + i)
    shops = [*shops, shop("hotel", "7011"), shop("diner", "5812"), shop("zoo", "7998")]
    tables = spend_tables(spark, more.rows, shops, BRIDGE)
    together = category_costs(tables, CATEGORIES, STATE, JULY).collect()
    for category in CATEGORIES:
        alone = category_cost(tables, category, STATE, JULY).collect()
        mine = {r.merch_state: r for r in together if r.category == category.name}
        assert set(mine) == {r.merch_state for r in alone}
        for row in alone:
            other = mine[row.merch_state]
            for name, _ in category.prices:
                assert row[name] == other[name]
            assert row.transaction_count == other.transaction_count
            assert row.unique_visitors == other.unique_visitors
    levels = level_prices(tables, CATEGORIES, JULY).collect()
    national = category_cost(tables, RETAIL, NATIONAL, JULY).first()
    mine = [r for r in levels if (r.level, r.category) == ("national", "retail")]
    assert [r.retail_cost for r in mine] == [national.retail_cost]


def test_result_does_not_depend_on_input_partitions_or_staging(spark):
    rows, shops = busy_month()
    config = JULY.with_(daily_cap=4)
    results = []
    for pieces, stage in ((1, False), (7, False), (3, True)):
        tables = spend_tables(spark, rows, shops)
        tables = type(tables)(tables.transactions.repartition(pieces), tables.merchants)
        frame = category_cost(tables, RETAIL, STATE, config.with_(stage=stage))
        results.append([tuple(r) for r in frame.drop("calculation_timestamp").collect()])
    assert results[0] == results[1] == results[2]


def test_staged_bands_beyond_the_broadcast_size(spark):
    tables = spend_tables(spark, *busy_month())
    small = category_cost(tables, RETAIL, STATE, JULY.with_(stage=True))
    large = category_cost(tables, RETAIL, STATE, JULY.with_(stage=True, broadcast_rows=0))
    lazy = category_cost(tables, RETAIL, STATE, JULY.with_(stage=False))
    drop = "calculation_timestamp"
    assert small.drop(drop).collect() == large.drop(drop).collect() == lazy.drop(drop).collect()


def test_configuration_is_checked():
    for bad in ({"method": "median"}, {"flag_basis": "x"}, {"daily_cap": 0}, {"end": DAY.replace(year=2000)}):
        with pytest.raises(ValueError):
            JULY.with_(**bad)
