"""The complete indices and their variants."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from triptally.config import (
    ACCOMMODATION,
    ATTRACTION,
    CATEGORIES,
    RESTAURANT,
    RESTAURANT_MEDIAN,
    RETAIL,
    RETAIL_NO_MINIMUM,
)
from triptally.operators.joins import DIVISION, NATIONAL, STATE
from triptally.plans import cap_test
from triptally.plans.backfill import MonthlyPrices
from triptally.plans.basket import basket_index, quality_basket
from triptally.plans.category import category_cost, category_costs, level_prices
from triptally.plans.county import CATEGORIES as COUNTY_CATEGORIES
from triptally.plans.county import county_index
from triptally.plans.rollup import Summaries
from triptally.plans.trends import geo_comparison
from triptally.registry import sql
from triptally.registry.aggregates import ONE_PASS, _one_pass_column
from triptally.registry.base import (
    BY_TRANSACTIONS,
    CAP_TEST,
    CAPPED,
    EVERY_MONTH,
    SENSITIVITY_CAPS,
    WHOLE,
    query,
)
from triptally.registry.scalars import comparison_sql
from triptally.session import fresh_folder
from triptally.sources.tables import SpendTables


# Groups are far below the sketch's accuracy here, so it finds the exact percentiles.
SKETCHED = WHOLE.with_(method="approx")


def _category(key, category, level, config=WHOLE):
    @query(key, sql.category_cost(category, level.name, config))
    def build(t):
        return category_cost(t, category, level, config).drop("calculation_timestamp")


_category("state_accommodation", ACCOMMODATION, STATE)
_category("state_accommodation_sketched", ACCOMMODATION, STATE, SKETCHED)
_category("state_retail_sketched_cap", RETAIL, STATE, SKETCHED.with_(daily_cap=2))
_category("national_restaurant_sketched_every_snapshot", RESTAURANT, NATIONAL,
          SKETCHED.with_(snapshot_join=False))
_category("state_accommodation_cap", ACCOMMODATION, STATE, CAPPED)
_category("state_attraction", ATTRACTION, STATE)
_category("state_attraction_cap", ATTRACTION, STATE, CAPPED)
_category("state_restaurant", RESTAURANT, STATE)
_category("state_restaurant_median", RESTAURANT_MEDIAN, STATE)
_category("state_retail", RETAIL, STATE)
_category("state_retail_cap", RETAIL, STATE, CAPPED)
_category("state_retail_by_transactions", RETAIL, STATE, BY_TRANSACTIONS)
_category("division_accommodation", ACCOMMODATION, DIVISION)
_category("division_attraction", ATTRACTION, DIVISION)
_category("division_restaurant", RESTAURANT, DIVISION)
_category("division_retail_cap", RETAIL, DIVISION, CAPPED)
_category("division_retail", RETAIL_NO_MINIMUM, DIVISION)
_category("national_accommodation", ACCOMMODATION, NATIONAL)
_category("national_attraction", ATTRACTION, NATIONAL)
_category("national_restaurant", RESTAURANT, NATIONAL)
_category("national_retail", RETAIL, NATIONAL)


@query("retail_cap_test", sql.cap_test("SELECT * FROM report", CAP_TEST, RETAIL_NO_MINIMUM))
def retail_cap_test(t):
    return cap_test.retail_cap_test(t, CAP_TEST).drop("query_run_timestamp")


@query("retail_cap_compare", comparison_sql(CAPPED, "*"))
def retail_cap_compare(t):
    return cap_test.cap_comparison(t, CAPPED)


@query("state_basket_index", sql.basket("SELECT * FROM idx", WHOLE))
def state_basket_index(t):
    return basket_index(t, WHOLE)


def _quality_sql() -> str:
    usable = ", ".join(
        f"""CASE data_quality_flag WHEN 'SINGLE_MONTH' THEN {c} WHEN 'ROLLING_3MO' THEN
    avg(CASE WHEN data_quality_flag <> 'EXCLUDE' THEN {c} END) OVER recent END AS {c}"""
        for c in ONE_PASS
    )
    names = [category.name for category in CATEGORIES]
    flags = ", ".join(f"coalesce(max(data_quality_flag) FILTER (category = '{n}'), 'EXCLUDE') AS {n}_flag" for n in names)
    people = ", ".join(f"coalesce(max(unique_visitors) FILTER (category = '{n}'), 0) AS {n}_visitors" for n in names)
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ONE_PASS)
    return sql.on_spend(
        f"""WITH costs AS ({_all_sql(WHOLE)}),
usable AS (SELECT category, merch_state, month_date, data_quality_flag, unique_visitors, {usable}
  FROM costs WINDOW recent AS (PARTITION BY category, merch_state ORDER BY month_date
    RANGE BETWEEN INTERVAL 2 MONTHS PRECEDING AND CURRENT ROW)),
wide AS (SELECT merch_state, month_date, {", ".join(f"max({c}) AS {c}" for c in ONE_PASS)},
    {flags}, {people}, count(*) FILTER (data_quality_flag = 'ROLLING_3MO') AS n_rolling,
    4 - count(*) FILTER (data_quality_flag <> 'EXCLUDE') AS n_excluded
  FROM usable WHERE merch_state <> 'XX' GROUP BY ALL)
SELECT * EXCLUDE ({", ".join(ONE_PASS)}), {rounded},
  CASE WHEN n_excluded > 0 THEN 'EXCLUDE' WHEN n_rolling > 0 THEN 'ROLLING_3MO'
    ELSE 'SINGLE_MONTH' END AS basket_flag, round({sql.TOTAL}, 6) AS cost_per_trip FROM wide"""
    )


def _all_sql(config, key_columns: str = "merch_state") -> str:
    keys = f"category, {key_columns}, month_date"
    return f"""WITH base AS ({sql.rows(CATEGORIES, "state", config)}),
{sql.trimmed("base", keys, config)}
SELECT {keys}, {", ".join(_one_pass_column(name) for name in ONE_PASS)},
  count(*) AS transaction_count, count(DISTINCT membccid) AS unique_visitors,
  any_value(n_before) AS n_before, {sql.flag("count(DISTINCT membccid)", config)} AS data_quality_flag
FROM kept GROUP BY {keys}"""


@query("state_basket_quality", _quality_sql())
def state_basket_quality(t):
    """Usable prices, flags and visitors behind every basket."""
    priced = quality_basket(t, WHOLE)
    return priced.withColumns({c: F.round(c, 6) for c in (*ONE_PASS, "cost_per_trip")})


@query("division_basket_index", sql.level_basket("division", WHOLE))
def division_basket_index(t):
    return basket_index(t, WHOLE, level=DIVISION)


@query("national_basket_index", sql.level_basket("national", WHOLE))
def national_basket_index(t):
    return basket_index(t, WHOLE, level=NATIONAL)


@query("county_basket_index", sql.county("SELECT * FROM county", EVERY_MONTH, COUNTY_CATEGORIES))
def county_basket_index(t):
    return county_index(t, EVERY_MONTH).drop("created_at")


LATE = (date(1997, 3, 1), date(1997, 3, 31))


@query("backfill_months", sql.on_spend(_all_sql(WHOLE)))
def backfill_months(t):
    """All months but one, then that one from a delivery of its own."""
    prices = MonthlyPrices(t.spark, fresh_folder(t.spark, "backfill"), WHOLE)
    prices.add(t, "before", (WHOLE.start, LATE[0] - timedelta(days=1)))
    prices.deliver(t, "after", (LATE[1] + timedelta(days=1), WHOLE.end))
    prices.deliver(t, "late", LATE)
    return prices.read()


@query("backfill_late_rows", sql.on_spend(_all_sql(WHOLE)))
def backfill_late_rows(t):
    """Each month is known in part before the rest of its purchases arrives."""
    prices = MonthlyPrices(t.spark, fresh_folder(t.spark, "backfill"), WHOLE)
    late = F.xxhash64("mtid", "membccid") % 4 == 0
    for run, keep in (("first", ~late), ("rest", late)):
        delivered = SpendTables(t.transactions.filter(keep), t.merchants)
        prices.deliver(delivered, run)
    return prices.read()


def _sensitivity_sql() -> str:
    base = sql.rows([RETAIL], "state", WHOLE)
    keys = "merch_state, daily_cap"
    caps = ", ".join(f"({cap})" for cap in SENSITIVITY_CAPS)
    return sql.on_spend(
        f"""WITH base AS ({base}), raw AS ({sql.ranked("base", "merch_state")}),
capped AS (SELECT raw.*, daily_cap FROM raw, (VALUES {caps}) c(daily_cap)
  WHERE daily_rank <= daily_cap), {sql.trimmed("capped", keys, WHOLE)},
before AS (SELECT merch_state, count(*) AS txn_before_cap FROM base GROUP BY ALL),
priced AS (SELECT {keys}, quantile_disc(trans_amount, 0.5) AS retail_cost,
  any_value(n_before) AS txn_after_cap FROM kept GROUP BY ALL)
SELECT {keys}, retail_cost, txn_before_cap, txn_after_cap,
  {sql.pct("txn_after_cap", "txn_before_cap")} AS pct_txn_kept
FROM priced JOIN before USING (merch_state)"""
    )


@query("cap_sensitivity", _sensitivity_sql())
def cap_sensitivity(t):
    return cap_test.cap_sensitivity(t, WHOLE, SENSITIVITY_CAPS)


def _daily_counts(key: str, config):
    @query(
        key,
        sql.on_spend(
            f"""WITH days AS (SELECT membccid, trans_date, count(*) AS txn_per_day
  FROM ({sql.rows([RETAIL], "state", config)}) GROUP BY ALL)
SELECT txn_per_day, count(*) AS card_days, count(DISTINCT membccid) AS cards,
  txn_per_day > 2 AS over_cap FROM days GROUP BY txn_per_day"""
        ),
    )
    def build(t):
        return cap_test.daily_count_distribution(t, config)


_daily_counts("daily_count_distribution", CAPPED)
_daily_counts("daily_count_every_snapshot", CAPPED.with_(snapshot_join=False))


def _level_ctes() -> str:
    """CTE `priced`: the prices of all levels, each from its own rows."""
    keys = "level, geography, category, month_date"
    base = sql.rows(CATEGORIES, "state", WHOLE)
    return f"""WITH base AS ({base}),
leveled AS (
  SELECT 'state' AS level, merch_state AS geography, category, month_date, membccid, trans_amount
  FROM base UNION ALL
  SELECT 'division', census_region_division, category, month_date, membccid, trans_amount
  FROM base JOIN bridge ON merch_state = abbreviation UNION ALL
  SELECT 'national', 'US', category, month_date, membccid, trans_amount FROM base),
{sql.trimmed("leveled", keys, WHOLE)},
priced AS (SELECT {keys}, {", ".join(_one_pass_column(name) for name in ONE_PASS)},
    any_value(n_before) AS n_before, count(*) AS n_band
  FROM kept GROUP BY {keys})"""


@query("all_levels", sql.on_spend(f"{_level_ctes()} SELECT * FROM priced"))
def all_levels(t):
    """Every category at every level from one pass."""
    return level_prices(t, CATEGORIES, WHOLE)


def _summaries(t):
    """Sketches per state and month, added in two deliveries."""
    found = Summaries(t.spark, fresh_folder(t.spark, "summaries"), SKETCHED)
    found.add(t, "before", (WHOLE.start, LATE[1]))
    found.add(t, "after", (LATE[1] + timedelta(days=1), WHOLE.end))
    return found


def _visitor_sql(period: str) -> str:
    return f"""SELECT level, geography, category, CAST({period} AS DATE) AS period,
  count(DISTINCT membccid) AS unique_visitors, count(*) AS n_before
FROM leveled GROUP BY ALL"""


@query(
    "all_levels_summarised",
    sql.on_spend(
        f"""{_level_ctes()}, visitors AS ({_visitor_sql("month_date")})
SELECT level, geography, category, month_date AS period, {", ".join(ONE_PASS)}, n_before, n_band,
  unique_visitors
FROM (SELECT * EXCLUDE (n_before) FROM priced) p JOIN visitors v USING (level, geography, category)
WHERE p.month_date = v.period"""
    ),
)
def all_levels_summarised(t):
    """Prices and visitors at every level from merged sketches; small groups are exact."""
    return _summaries(t).prices(t.bridge)


@query(
    "visitors_by_quarter",
    sql.on_spend(f"{_level_ctes()} {_visitor_sql("date_trunc('quarter', month_date)")}"),
)
def visitors_by_quarter(t):
    """Distinct visitors and purchases of each quarter, united from months."""
    prices = _summaries(t).prices(t.bridge, "quarter")
    return prices.select("level", "geography", "category", "period", "unique_visitors", "n_before")


@query(
    "geo_comparison",
    sql.on_spend(
        f"""{_level_ctes()},
wide AS (SELECT level, geography, month_date, {", ".join(f"max({c}) AS {c}" for c in ONE_PASS)}
  FROM priced GROUP BY ALL),
baskets AS (SELECT level, geography, month_date, {sql.TOTAL} AS cost FROM wide)
SELECT s.month_date, s.geography AS state, census_region_division AS division,
  s.cost AS state_cost, d.cost AS division_cost, n.cost AS national_cost,
  s.cost / d.cost AS ratio_to_division, s.cost / n.cost AS ratio_to_national
FROM (SELECT * FROM baskets WHERE level = 'state') s JOIN bridge ON s.geography = abbreviation
LEFT JOIN (SELECT * FROM baskets WHERE level = 'division') d
  ON d.geography = census_region_division AND d.month_date = s.month_date
LEFT JOIN (SELECT * FROM baskets WHERE level = 'national') n ON n.month_date = s.month_date"""
    ),
)
def geo_comparison_(t):
    return geo_comparison(t, WHOLE)
