from __future__ import annotations

from collections import defaultdict
from datetime import date

import pytest
from spending import Till, between, shop, spend_tables

from triptally.config import CountyConfig, IndexConfig
from triptally.plans import reports
from triptally.plans.county import county_index, lodging_rates
from triptally.schemas import COUNTY_INDEX
from triptally.sources.publish import PublishedTable
from triptally.sources.writers import conform

INDEX = IndexConfig(date(2025, 7, 1), date(2025, 8, 31), daily_cap=2, method="cont")
CONFIG = CountyConfig(INDEX, min_lodging=2, min_restaurant=3, min_attraction=3, min_retail=3)
LODGING = (
    "county_fips string, state_abbr string, stay_date date, adr double, property_id string, "
    "country string, occupancy double"
)


@pytest.fixture(scope="module")
def tables(spark):
    geo = spark.createDataFrame(
        [("United States", "A", 1, 6001, "x"), ("United States", "A", 1, 6001, "y"),
         ("United States", "B", 2, 6003, "x"), ("United States", "C", 3, None, "x"),
         ("United States", "DC", 4, 11001, "x"), ("Canada", "D", 5, 7001, "x")],
        "country string, admin2 string, admin1_id long, admin2_id long, admin3 string",
    ).selectExpr("*", "'S' as admin1", "'S' as admin1_abbr")
    shops = [
        shop(f"{kind}-{city}", code, city=city, country=None)
        for city in ("6001", "6003", "7001", "SAN JOSE")
        for kind, code in (("diner", "5812"), ("zoo", "7998"), ("mall", "5311"))
    ]
    till = Till()
    for i in range(40):
        day = date(2025, 7, 1 + i % 5)
        for city in ("6001", "7001", "SAN JOSE"):
            till.buy(f"diner-{city}", f"c{i % 7}", 8.0 + i, day=day)
            till.buy(f"zoo-{city}", f"c{i % 3}", 15.0 + 2 * i, day=day)
            till.buy(f"mall-{city}", f"c{i % 2}", 20.0 + 3 * i, day=day)
    till.buy("diner-6003", "z", 11.0)
    friday = date(2025, 7, 4)
    lodging = spark.createDataFrame(
        [("6001", "CA", friday, 100.0, "p", "United States", 1.0),
         ("6001", "CA", date(2025, 7, 5), 200.0, "q", "United States", 3.0),
         ("6001", "CA", date(2025, 7, 6), 900.0, "r", "United States", 1.0),
         (None, "DC", friday, 300.0, "d", "United States", 1.0),
         (None, "VA", friday, 400.0, "v", "United States", 1.0),
         ("6003", "CA", friday, 70.0, "f", "France", 1.0)],
        LODGING,
    )
    return till.rows, spend_tables(spark, till.rows, shops, geo=geo, lodging=lodging)


def by_hand(rows):
    """Trim per county and category, then cap retail, then interpolate."""
    groups = defaultdict(list)
    for _, mtid, card, day, amount, *_ in rows:
        kind, city = mtid.split("-")
        groups[kind, city].append((card, day, amount))
    kept = {}
    for key, bought in groups.items():
        values = [b[2] for b in bought]
        low, high = between(values, 0.05), between(values, 0.98)
        kept[key] = [b for b in bought if low <= b[2] <= high], len(values)
    days = defaultdict(list)
    # The cap ranks a card's day across all counties, so only known counties take part.
    for (kind, city), (bought, _) in kept.items():
        if kind == "mall" and city in ("6001", "6003"):
            for card, day, amount in bought:
                days[card, day].append(amount)
    capped = [a for amounts in days.values() for a in sorted(amounts, reverse=True)[:2]]
    return kept, capped


def test_county_rows(tables):
    rows, spend = tables
    found = {(r.county_fips, r.month_date.month): r for r in county_index(spend, CONFIG).collect()}
    assert set(found) == {(c, m) for c in ("6001", "6003", "11001") for m in (7, 8)}
    kept, capped = by_hand(rows)
    row = found["6001", 7]
    meals = [b[2] for b in kept["diner", "6001"][0]]
    sights = [b[2] for b in kept["zoo", "6001"][0]]
    assert row.breakfast_lunch_cost == pytest.approx(between(meals, 0.35) * 4)
    assert row.dinner_cost == pytest.approx(between(meals, 0.65) * 2)
    assert row.attraction_cost == pytest.approx(between(sights, 0.5) * 2)
    assert row.retail_cost == pytest.approx(between(capped, 0.5) * 2)
    assert row.lodging_cost == 300.0
    assert row.total_basket_cost == pytest.approx(
        row.breakfast_lunch_cost + row.dinner_cost + row.attraction_cost + row.retail_cost + 300.0
    )
    assert (row.restaurant_txn_count, row.retail_txn_count) == (len(meals), len(capped))
    assert row.restaurant_txn_removed == 40 - len(meals)
    assert (row.lodging_txn_count, row.hotel_property_count, row.meets_threshold) == (2, 2, True)
    dc = found["11001", 7]
    assert (dc.lodging_cost, dc.total_basket_cost, dc.meets_threshold) == (600.0, None, False)
    empty = found["6003", 8]
    assert (empty.retail_txn_count, empty.hotel_property_count, empty.lodging_cost) == (0, 0, None)


def test_rates_weighted_by_occupancy(tables):
    rates = lodging_rates(tables[1], CONFIG, by_occupancy=True).collect()
    found = {r.county_fips: r.avg_adr for r in rates}
    assert found == {"6001": 175.0, "11001": 300.0}


def test_append_replace_and_verify(spark, tables, tmp_path):
    result = county_index(tables[1], CONFIG)
    table = PublishedTable(spark, str(tmp_path / "county"), COUNTY_INDEX)
    for run in ("one", "two", "two"):
        assert table.append(result, run, reports.county_metrics())["meeting"] == 1
    stored = table.read()
    checks = {r.month_date.month: r for r in reports.write_verification(stored).collect()}
    assert (checks[7].total_records, checks[7].unique_counties, checks[7].duplicate_keys) == (6, 3, 3)
    assert checks[7].counties_meeting_threshold == 2

    table.replace_months(result)
    july = CountyConfig(INDEX.with_(end=date(2025, 7, 31)), min_lodging=100)
    table.replace_months(county_index(tables[1], july))
    stored = table.read()
    assert stored.count() == 6
    assert stored.filter("meets_threshold").count() == 0
    report = reports.validation_report(stored).first()
    assert (report.rows_processed, report.missing_lodging_cost) == (6, 4)


def test_required_columns_fail_the_write(spark, tables, tmp_path):
    broken = county_index(tables[1], CONFIG).selectExpr("* except (county_fips)", "cast(null as string) as county_fips")
    with pytest.raises(Exception, match="county_fips must not be null"):
        conform(broken, COUNTY_INDEX).write.parquet(str(tmp_path / "broken"))
