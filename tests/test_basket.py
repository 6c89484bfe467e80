from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from spending import Till, shop, spend_tables

from triptally.config import (
    CATEGORIES,
    COUPLE_WEEKEND,
    ONE_RETAIL_DAY,
    RETAIL,
    SINGLE_LODGING_CHARGE,
    IndexConfig,
)
from triptally.functions.scalars import basket_cost
from triptally.operators.joins import STATE
from triptally.plans import reports, trends
from triptally.plans.basket import (
    basket_from_frames,
    basket_index,
    latest_exports,
    rolling_fallback,
)
from triptally.plans.category import category_cost
from triptally.schemas import BASKET, category_export
from triptally.sources.tables import read_exports

KEY = "merch_state string, month_date date, "
JUNE, JULY, AUGUST = date(2025, 6, 1), date(2025, 7, 1), date(2025, 8, 1)

# Published component prices and the trip price they add up to.
PUBLISHED = [
    ("FL", 214.32000732421875, 44.40999984741211, 26.770000457763672, 56.02000045776367,
     38.16999816894531, 812.9200134277344),
    ("CA", 225.3999938964844, 20.799999237060547, 20.719999313354492, 42.66999816894531,
     29.84000015258789, 720.2999801635742),
    ("TX", 200.3300018310547, 18.829999923706055, 21.3700008392334, 41.86000061035156,
     41.880001068115234, 691.2800102233887),
]


def test_published_baskets_add_up_exactly(spark):
    names = "merch_state accommodation_cost attraction_cost breakfast_lunch_cost dinner_cost retail_cost total"
    frame = spark.createDataFrame(PUBLISHED, names.split())
    for row in frame.withColumn("found", basket_cost(COUPLE_WEEKEND)).collect():
        assert row.found == row.total


def test_other_weights(spark):
    frame = spark.createDataFrame(
        [(100.0, 10.0, 5.0, 20.0, 30.0)],
        "accommodation_cost double, attraction_cost double, breakfast_lunch_cost double, "
        "dinner_cost double, retail_cost double",
    )
    row = frame.select(
        basket_cost(COUPLE_WEEKEND), basket_cost(ONE_RETAIL_DAY), basket_cost(SINGLE_LODGING_CHARGE)
    ).first()
    assert tuple(row) == (340.0, 310.0, 240.0)


def frames(spark):
    acc = spark.createDataFrame(
        [("CA", JUNE, 100.0), ("CA", JULY, 110.0), ("NV", JUNE, 90.0), ("XX", JUNE, 1.0),
         (None, JUNE, 2.0)],
        KEY + "accommodation_cost double",
    )
    att = spark.createDataFrame([("CA", JUNE, 20.0)], KEY + "attraction_cost double")
    rest = spark.createDataFrame(
        [("CA", JUNE, 8.0, 20.0, 12.0), ("OR", JUNE, 7.0, 18.0, 11.0)],
        KEY + "breakfast_lunch_cost double, dinner_cost double, median_meal_cost double",
    )
    ret = spark.createDataFrame(
        [("CA", JUNE, 30.0), ("NV", JUNE, 25.0)], KEY + "retail_cost double"
    )
    return acc, att, rest, ret


def test_joins_are_anchored_on_lodging_and_restaurants(spark):
    rows = basket_from_frames(*frames(spark)).collect()
    # XX goes, a missing state stays, OR has no lodging, NV's retail has no restaurants beside it.
    assert [(r.merch_state, r.month_date) for r in rows] == [
        (None, JUNE), ("CA", JUNE), ("CA", JULY), ("NV", JUNE),
    ]
    assert rows[1].cost_per_trip == 100 * 2 + 20 * 2 + 8 * 4 + 20 * 2 + 30 * 2
    assert rows[2].cost_per_trip is None
    assert rows[3].retail_cost is None
    kept = basket_from_frames(*frames(spark), drop_unknown=False)
    assert "XX" in {r.merch_state for r in kept.collect()}


def trip_tables(spark):
    shops = [
        shop(f"{kind}-{state}", code, state=state)
        for state in ("CA", "NV", "XX")
        for kind, code in (("hotel", "7011"), ("zoo", "7998"), ("diner", "5812"), ("mall", "5311"))
    ]
    till = Till()
    for i in range(60):
        day = date(2025, 6 + i % 3, 1 + i % 28)
        for state in ("CA", "NV", "XX"):
            if (state, day.month) != ("NV", 7):
                till.buy(f"hotel-{state}", f"c{i % 9}", 60.0 + i, day=day)
            if (state, day.month) != ("NV", 8):
                till.buy(f"diner-{state}", f"c{i % 8}", 8.0 + i, day=day)
            till.buy(f"zoo-{state}", f"c{i % 5}", 15.0 + i, day=day)
            till.buy(f"mall-{state}", f"c{i % 4}", 20.0 + i, day=day)
    return spend_tables(spark, till.rows, shops)


SUMMER = IndexConfig(JUNE, date(2025, 8, 31), sample_exclude=2, sample_rolling=5)


def test_one_pass_index_equals_joined_categories(spark):
    tables = trip_tables(spark)
    joined = basket_from_frames(*[category_cost(tables, c, STATE, SUMMER) for c in CATEGORIES])
    single = basket_index(tables, SUMMER)
    assert single.collect() == joined.collect()
    assert single.schema.names == BASKET.names
    months = {(r.merch_state, r.month_date) for r in single.collect()}
    assert ("NV", JULY) not in months and ("NV", AUGUST) in months


def test_overlapping_exports_keep_the_last_calculation(spark):
    exports = spark.createDataFrame(
        [("CA", JUNE, 1.0, datetime(2025, 7, 1), "a.csv"), ("CA", JUNE, 2.0, datetime(2025, 8, 1), "b.csv"),
         ("NV", JUNE, 3.0, datetime(2025, 7, 1), "a.csv")],
        KEY + "retail_cost double, calculation_timestamp timestamp, export_file string",
    )
    assert {(r.merch_state, r.retail_cost) for r in latest_exports(exports).collect()} == {
        ("CA", 2.0), ("NV", 3.0),
    }


def test_warehouse_exports_can_be_read(spark, tmp_path):
    header = ",".join(category_export(RETAIL).names)
    for month in ("06", "07"):
        (tmp_path / f"retail_{month}.csv").write_text(
            f"{header}\nCA,2025-{month}-01,29.840000152587891,102483313,249584,SINGLE_MONTH,"
            f"2025-{month}-01,2025-08-31,2025-11-17 19:53:53.651372 UTC\n"
        )
    exports = read_exports(spark, str(tmp_path), category_export(RETAIL))
    rows = sorted(latest_exports(exports).collect(), key=lambda r: r.month_date)
    assert [r.month_date for r in rows] == [JUNE, JULY]
    assert rows[0].retail_cost == 29.840000152587891 and rows[0].transaction_count == 102483313
    assert rows[0].calculation_timestamp == datetime(2025, 11, 17, 19, 53, 53, 651372)


def test_rolling_fallback_leaves_out_excluded_and_missing_months(spark):
    rows = [
        ("CA", date(2025, 1, 1), "SINGLE_MONTH", 10.0), ("CA", date(2025, 2, 1), "EXCLUDE", 1000.0),
        ("CA", date(2025, 3, 1), "ROLLING_3MO", 20.0), ("CA", date(2025, 6, 1), "ROLLING_3MO", 50.0),
    ]
    frame = spark.createDataFrame(rows, KEY + "data_quality_flag string, cost double")
    found = {r.month_date.month: r.usable_cost for r in rolling_fallback(frame, "cost").collect()}
    assert found == {1: 10.0, 2: None, 3: 15.0, 6: 50.0}


def index(spark):
    rows = [
        (state, date(2024 + m // 12, m % 12 + 1, 1), base + m)
        for state, base in (("CA", 700.0), ("NV", 500.0), ("OR", 500.0))
        for m in range(14)
        if (state, m) != ("NV", 11)
    ]
    return spark.createDataFrame(rows, KEY + "cost_per_trip double")


def test_changes_only_against_the_exact_month(spark):
    found = {
        (r.merch_state, r.month_date): r
        for r in trends.month_and_year_change(index(spark)).collect()
    }
    assert found["CA", date(2025, 1, 1)].mom_change == 1.0
    assert found["CA", date(2025, 1, 1)].yoy_change == 12.0
    assert found["NV", date(2025, 1, 1)].mom_change is None
    assert found["CA", date(2024, 1, 1)].previous_month is None


def test_rankings_extremes_and_baseline(spark):
    frame = index(spark)
    last = date(2025, 2, 1)
    ranks = {
        r.merch_state: r["rank"]
        for r in trends.state_ranking(frame).filter(F.col("month_date") == last).collect()
    }
    assert ranks == {"CA": 1, "NV": 2, "OR": 2}
    sides = [(r.side, r.merch_state) for r in trends.cost_extremes(frame, 1).collect()]
    assert sorted(sides) == [("least expensive", "NV"), ("most expensive", "CA")]
    based = trends.baseline_index(frame, date(2024, 1, 1))
    row = based.filter((F.col("merch_state") == "CA") & (F.col("month_date") == last)).first()
    assert row.index_value == pytest.approx(713.0 / 700.0 * 100)


def test_reports_on_results(spark):
    frame = index(spark)
    described = reports.describe(frame, "cost_per_trip").first()
    values = sorted(r.cost_per_trip for r in frame.collect())
    assert (described["count"], described["min"], described["max"]) == (41, values[0], values[-1])
    assert described.p50 == values[20]
    missing = reports.missing_values(frame.withColumn("gone", F.lit(None).cast("double")))
    assert {r.column_name: r.missing for r in missing.collect()}["gone"] == 41
    covered = reports.coverage(frame).first()
    assert (covered.records, covered.months, covered.geographies) == (41, 14, 3)
    once = reports.review_sample(frame, ["merch_state", "month_date"], 5).collect()
    again = reports.review_sample(frame.repartition(3), ["merch_state", "month_date"], 5).collect()
    assert once == again and len(once) == 5
