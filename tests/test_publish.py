"""Published versions, repeated runs, failures between write and publication, and late deliveries."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from spending import Till, shop, spend_tables

from triptally.config import CATEGORIES, IndexConfig
from triptally.operators.joins import STATE
from triptally.plans.backfill import MonthlyPrices
from triptally.plans.category import category_costs
from triptally.plans.reports import write_verification
from triptally.sources.publish import ConflictError, PublishedTable, append_to_catalog, duplicate_keys

SCHEMA = T.StructType(
    [
        T.StructField("place", T.StringType()),
        T.StructField("month_date", T.DateType()),
        T.StructField("cost", T.DoubleType()),
    ]
)
JAN, FEB, MAR = (date(2025, m, 1) for m in (1, 2, 3))


@pytest.fixture
def table(spark, tmp_path):
    return PublishedTable(spark, str(tmp_path / "monthly"), SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def stored(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_months_are_replaced_and_emptied(spark, table):
    assert stored(table) == [] and table.versions() == []
    table.replace_months(frame(spark, *[("a", m, 1.0) for m in (JAN, FEB, MAR)]), period=(JAN, MAR))
    table.replace_months(frame(spark, ("a", JAN, 2.0)), period=(JAN, date(2025, 2, 28)))
    assert stored(table) == [("a", JAN, 2.0), ("a", MAR, 1.0)]
    table.replace_months(frame(spark), period=(JAN, JAN))
    assert stored(table) == [("a", MAR, 1.0)]
    table.replace_months(frame(spark), months=["2025-03-01"])
    assert stored(table) == []
    # Every version stays as it was.
    assert stored(table, 2) == [("a", JAN, 2.0), ("a", MAR, 1.0)]
    assert len(stored(table, 1)) == 3 and table.months(1) == ["2025-01-01", "2025-02-01", "2025-03-01"]


def test_a_failure_leaves_the_old_month(spark, table, monkeypatch):
    table.replace_months(frame(spark, ("a", JAN, 1.0), ("a", FEB, 1.0)))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_publish", fails)
        with pytest.raises(OSError, match="lost"):
            table.replace_months(frame(spark, ("a", JAN, 2.0)), period=(JAN, FEB))
    assert stored(table) == [("a", JAN, 1.0), ("a", FEB, 1.0)]
    table.replace_months(frame(spark, ("a", JAN, 2.0)), period=(JAN, FEB))
    assert stored(table) == [("a", JAN, 2.0)]
    assert len(table.vacuum()) == 2  # the first write and the one that was never named
    assert stored(table) == [("a", JAN, 2.0)] and table.versions() == [2]


def test_a_row_that_fails_the_schema_publishes_nothing(spark, tmp_path):
    required = T.StructType([T.StructField("place", T.StringType(), False), *SCHEMA.fields[1:]])
    table = PublishedTable(spark, str(tmp_path / "strict"), required)
    with pytest.raises(Exception, match="place must not be null"):
        table.append(frame(spark, (None, JAN, 1.0)), "run")
    assert table.versions() == []


def test_two_writers_do_not_lose_each_other(spark, table):
    before = table.manifest()
    table.append(frame(spark, ("a", JAN, 1.0)), "one")
    late = table._store(frame(spark, ("b", JAN, 1.0)), "two", None)
    with pytest.raises(ConflictError):
        table._publish([late], before, {})
    assert stored(table) == [("a", JAN, 1.0)]
    assert [n for n in table._names("manifests") if n.endswith(".tmp")] == []


def test_a_repeated_append_gives_its_rows_once(spark, table):
    for _ in range(2):
        counts = table.append(
            frame(spark, ("a", JAN, 1.0), ("a", JAN, 3.0)), "january",
            {"dear": F.count_if(F.col("cost") > 2), "last": F.max("month_date")},
        )
        assert counts == {"rows": 2, "dear": 1, "last": "2025-01-01"}
    table.append(frame(spark, ("b", JAN, 5.0)), "more")
    assert stored(table) == [("a", JAN, 1.0), ("a", JAN, 3.0), ("b", JAN, 5.0)]
    assert table.append(frame(spark), "empty")["rows"] == 0
    assert set(table.runs()) == {"january", "more"}
    assert [tuple(r) for r in duplicate_keys(table.read(), ["place", "month_date"]).collect()] == [("a", JAN, 2)]


def test_the_frame_runs_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = frame(spark, *[("a", m, float(i)) for i in range(50) for m in (JAN, FEB)])
    table.replace_months(rows.mapInArrow(count, rows.schema), period=(JAN, MAR), metrics={"top": F.max("cost")})
    assert seen.value == 100


def test_filters_on_months_leave_out_files(spark, table):
    table.append(frame(spark, *[("a", m, 1.0) for m in (JAN, FEB, MAR)]), "all")
    scan = table.read().filter(F.col("month_date") == F.lit(FEB))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_date" in plan


def test_catalog_appends(spark, tmp_path):
    name = "published_costs"
    for run, cost in (("2025-01", 1.0), ("2025-02", 2.0), ("2025-01", 3.0)):
        append_to_catalog(frame(spark, ("a", JAN, cost)), name, SCHEMA, run, str(tmp_path / "catalog"))
    rows = sorted((r.run_id, r.cost) for r in spark.table(name).collect())
    assert rows == [("2025-01", 3.0), ("2025-02", 2.0)]
    with pytest.raises(ValueError, match="named"):
        append_to_catalog(frame(spark), name, SCHEMA, "it's")
    spark.sql(f"DROP TABLE {name}")


def test_planted_duplicates_are_counted(spark):
    rows = [("1", JAN, True), ("1", JAN, False), ("2", JAN, True), ("1", FEB, True)]
    table = spark.createDataFrame(rows, "county_fips string, month_date date, meets_threshold boolean")
    found = {r.month_date: tuple(r)[1:] for r in write_verification(table).collect()}
    assert found == {JAN: (3, 2, 2, 1), FEB: (1, 1, 1, 0)}


SHOPS = [shop("h", "7011"), shop("d", "5812"), shop("z", "7998", state="NV"), shop("m", "5311"), shop("m2", "5311", state="NV")]


def bought(seed: int, months=(1, 2, 3)) -> list[tuple]:
    till = Till()
    for i in range(60):
        day = date(2025, months[i % len(months)], 1 + (i * seed) % 9)
        for kind in ("h", "d", "z", "m", "m2"):
            till.buy(kind, f"c{(i * seed) % 7}", 50.0 + (i * seed * 7) % 40, day=day)
    return till.rows


YEAR = IndexConfig(date(2025, 1, 1), date(2025, 12, 31), sample_exclude=2, sample_rolling=4)


def tables_of(spark, rows):
    return spend_tables(spark, rows, SHOPS)


def costs(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("config", [YEAR, YEAR.with_(daily_cap=2)])
def test_late_deliveries_equal_everything_at_once(spark, tmp_path, config):
    prices = MonthlyPrices(spark, str(tmp_path), config)
    first, late, more = bought(1, (1, 3)), bought(2, (2,)), bought(3, (3,))
    assert prices.deliver(tables_of(spark, first), "first") == ["2025-01-01", "2025-03-01"]
    untouched = stored_of(prices, "2025-01-01")
    # The late month comes from a table that holds nothing else, so nothing else can have been read.
    assert prices.deliver(tables_of(spark, late), "late") == ["2025-02-01"]
    # More purchases of a known month, with a cap that ranks them among the earlier ones.
    assert prices.deliver(tables_of(spark, more), "more") == ["2025-03-01"]
    assert stored_of(prices, "2025-01-01") == untouched
    expected = category_costs(tables_of(spark, first + late + more), CATEGORIES, STATE, config)
    assert costs(prices.read().select(*expected.columns)) == costs(expected)
    assert prices.refresh() == []


def stored_of(prices, month):
    """The write that holds a month's results."""
    return [w["id"] for w in prices.results.manifest()["writes"] if month in w["live"]]


def test_a_delivery_again_replaces_its_former_rows(spark, tmp_path):
    prices = MonthlyPrices(spark, str(tmp_path), YEAR)
    prices.deliver(tables_of(spark, bought(1)), "a")
    prices.deliver(tables_of(spark, bought(2, (2,))), "b")
    assert prices.deliver(tables_of(spark, bought(1)), "a") == ["2025-01-01", "2025-02-01", "2025-03-01"]
    expected = category_costs(tables_of(spark, bought(1) + bought(2, (2,))), CATEGORIES, STATE, YEAR)
    assert costs(prices.read().select(*expected.columns)) == costs(expected)
    # It now lacks two months: one of them has nothing left.
    assert prices.deliver(tables_of(spark, bought(1, (3,))), "a") == ["2025-01-01", "2025-02-01", "2025-03-01"]
    assert prices.results.months() == ["2025-02-01", "2025-03-01"]


def test_a_stopped_run_is_made_good(spark, tmp_path):
    prices = MonthlyPrices(spark, str(tmp_path), YEAR)
    prices.deliver(tables_of(spark, bought(1, (1,))), "a")
    prices.add(tables_of(spark, bought(2, (2,))), "b")  # the run ends before the results
    assert prices.results.months() == ["2025-01-01"] and prices.stale_months() == ["2025-02-01"]
    assert prices.deliver(tables_of(spark, bought(3, (3,))), "c") == ["2025-02-01", "2025-03-01"]
    prices.counts.vacuum()
    prices.add(tables_of(spark, bought(2, (2,))), "b")
    prices.counts.vacuum()  # the version that the results follow is gone: all months
    assert prices.refresh() == ["2025-01-01", "2025-02-01", "2025-03-01"]


def test_period_of_a_delivery(spark, tmp_path):
    prices = MonthlyPrices(spark, str(tmp_path), YEAR)
    everything = tables_of(spark, bought(1))
    assert prices.deliver(everything, "february", (FEB, date(2025, 2, 28))) == ["2025-02-01"]
    assert prices.deliver(everything, "march", (MAR, date(2025, 3, 31))) == ["2025-03-01"]
    expected = category_costs(everything, CATEGORIES, STATE, YEAR.with_(start=FEB))
    assert costs(prices.read().select(*expected.columns)) == costs(expected)
