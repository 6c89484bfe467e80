"""Window functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from triptally.config import ACCOMMODATION, ATTRACTION, RETAIL
from triptally.operators import capping
from triptally.operators.distribution import count_purchases, inside_band, price_points
from triptally.operators.joins import NATIONAL, STATE
from triptally.plans.basket import basket_index, rolling_fallback
from triptally.plans.category import category_cost, visitor_rows
from triptally.plans.trends import (
    baseline_index,
    month_and_year_change,
    state_ranking,
    volume_trend,
)
from triptally.registry import sql
from triptally.registry.base import CAPPED, WHOLE, query

KEYS = ["merch_state", "month_date"]


@query(
    "win_daily_rank",
    sql.on_spend(
        f"""SELECT merch_state, trans_date, membccid, trans_amount, daily_rank
FROM ({sql.ranked(f"({sql.rows([ATTRACTION], 'state', WHOLE)})", "merch_state")})"""
    ),
)
def win_daily_rank(t):
    rows = visitor_rows(t, [ATTRACTION], STATE, WHOLE)
    daily = capping.count_daily_purchases(rows, ["merch_state"])
    ranks = capping.daily_ranks(capping.rank_purchases(daily, ["merch_state"]))
    return ranks.select("merch_state", "trans_date", "membccid", "trans_amount", "daily_rank")


@query(
    "win_topn_per_group",
    sql.on_spend(
        f"""SELECT trans_date, count(*) AS txn_before_cap,
  count(*) FILTER (daily_rank <= 2) AS txn_after_cap,
  count(*) FILTER (daily_rank > 2) AS txn_capped
FROM ({sql.ranked(f"({sql.rows([RETAIL], 'state', WHOLE)})", "merch_state")}) GROUP BY ALL"""
    ),
)
def win_topn_per_group(t):
    daily = capping.count_daily_purchases(visitor_rows(t, [RETAIL], STATE, CAPPED), ["merch_state"])
    ranked = capping.rank_purchases(daily, ["merch_state"])
    days = capping.card_days(ranked, ["merch_state"], CAPPED.daily_cap)
    return days.groupBy("trans_date").agg(
        F.sum("n_raw").alias("txn_before_cap"),
        F.sum("n_kept").alias("txn_after_cap"),
        F.sum(F.col("n_raw") - F.col("n_kept")).alias("txn_capped"),
    )


INTERPOLATED = WHOLE.with_(method="cont")


@query(
    "win_group_percentile",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([ATTRACTION], "state", WHOLE)}),
{sql.trimmed("base", "merch_state, month_date", INTERPOLATED)}
SELECT merch_state, month_date, membccid, trans_amount, count(*) AS n
FROM kept GROUP BY merch_state, month_date, membccid, trans_amount"""
    ),
)
def win_group_percentile(t):
    purchases = count_purchases(visitor_rows(t, [ATTRACTION], STATE, INTERPOLATED), KEYS)
    bands = price_points(purchases, KEYS, {}, INTERPOLATED)
    return inside_band(purchases, bands, KEYS, INTERPOLATED).select(
        *KEYS, "membccid", "trans_amount", "n"
    )


@query(
    "win_rolling_3mo",
    f"""SELECT merch_state, month_date, data_quality_flag, accommodation_cost,
  round(rolling_cost, 6) AS rolling_cost,
  round(CASE data_quality_flag WHEN 'EXCLUDE' THEN NULL WHEN 'ROLLING_3MO' THEN rolling_cost
    ELSE accommodation_cost END, 6) AS usable_cost
FROM (SELECT *, avg(CASE WHEN data_quality_flag <> 'EXCLUDE' THEN accommodation_cost END)
    OVER (PARTITION BY merch_state ORDER BY month_date
      RANGE BETWEEN INTERVAL 2 MONTHS PRECEDING AND CURRENT ROW) AS rolling_cost
  FROM ({sql.category_cost(ACCOMMODATION, "state", WHOLE)}))""",
)
def win_rolling_3mo(t):
    result = category_cost(t, ACCOMMODATION, STATE, WHOLE).select(
        *KEYS, "data_quality_flag", "accommodation_cost"
    )
    return rolling_fallback(result, "accommodation_cost").withColumns(
        {name: F.round(name, 6) for name in ("rolling_cost", "usable_cost")}
    )


@query(
    "win_state_ranking",
    sql.basket(
        """SELECT month_date, merch_state, cost_per_trip,
  rank() OVER (PARTITION BY month_date ORDER BY cost_per_trip DESC) AS rank
FROM idx WHERE cost_per_trip IS NOT NULL""",
        WHOLE,
    ),
)
def win_state_ranking(t):
    return state_ranking(basket_index(t, WHOLE))


@query(
    "win_mom_yoy",
    sql.basket(
        """, shifted AS (SELECT i.month_date, i.merch_state, i.cost_per_trip,
    m.cost_per_trip AS previous_month, y.cost_per_trip AS previous_year
  FROM idx i LEFT JOIN idx m ON m.merch_state = i.merch_state
    AND m.month_date = i.month_date - INTERVAL 1 MONTH
  LEFT JOIN idx y ON y.merch_state = i.merch_state
    AND y.month_date = i.month_date - INTERVAL 1 YEAR)
SELECT *, cost_per_trip - previous_month AS mom_change, cost_per_trip - previous_year AS yoy_change,
  (cost_per_trip - previous_month) / previous_month * 100 AS mom_pct,
  (cost_per_trip - previous_year) / previous_year * 100 AS yoy_pct FROM shifted""",
        WHOLE,
    ),
)
def win_mom_yoy(t):
    return month_and_year_change(basket_index(t, WHOLE))


@query(
    "win_baseline_index",
    f"""WITH idx AS ({sql.category_cost(RETAIL, "national", WHOLE)})
SELECT month_date, geography_level, retail_cost, base_cost, retail_cost / base_cost * 100 AS index_value
FROM idx, (SELECT retail_cost AS base_cost FROM idx WHERE month_date = DATE '1996-01-01')""",
)
def win_baseline_index(t):
    result = category_cost(t, RETAIL, NATIONAL, WHOLE)
    return baseline_index(result, date(1996, 1, 1), "retail_cost", NATIONAL.column)


@query(
    "win_volume_trend",
    f"""SELECT merch_state, month_date, transaction_count, previous_count,
  transaction_count - previous_count AS count_change
FROM (SELECT *, lag(transaction_count) OVER (PARTITION BY merch_state ORDER BY month_date)
    AS previous_count
  FROM ({sql.category_cost(ATTRACTION, "state", WHOLE)}))""",
)
def win_volume_trend(t):
    return volume_trend(category_cost(t, ATTRACTION, STATE, WHOLE))
