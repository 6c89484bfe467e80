"""Sorts, top-k reports, samples and unions."""

from __future__ import annotations

from triptally.config import ACCOMMODATION, ATTRACTION, RETAIL, RETAIL_NO_MINIMUM
from triptally.operators.filters import in_period
from triptally.operators.joins import DIVISION, NATIONAL, STATE
from triptally.plans import cap_test
from triptally.plans.basket import basket_index
from triptally.plans.category import category_cost, costs_by_category
from triptally.plans.reports import filter_funnel, review_sample
from triptally.plans.trends import cost_extremes
from triptally.registry import sql
from triptally.registry.base import CAP_TEST, CAPPED, PERIODS, WHOLE, query
from triptally.registry.scalars import comparison_sql
from triptally.sources.writers import keep

COUNTS = ("month_date", "transaction_count", "unique_visitors")


def _sorted(key, category, level, config=WHOLE):
    columns = (level.column, *COUNTS)

    @query(
        key,
        f"SELECT {', '.join(columns)} FROM ({sql.category_cost(category, level.name, config)})",
    )
    def build(t):
        return category_cost(t, category, level, config).select(*columns)


_sorted("sort_month_count", ATTRACTION, STATE)
_sorted("sort_month_geo", ATTRACTION, DIVISION)
_sorted("sort_month", ATTRACTION, NATIONAL)


def _report(t):
    return cap_test.retail_cap_test(t, CAP_TEST)


def _report_sql(columns, order: str = "") -> str:
    return sql.cap_test(
        f"SELECT {', '.join(columns)} FROM report {order}", CAP_TEST, RETAIL_NO_MINIMUM
    )


BY_STATE = ("state_abbr", "median_retail_txn", "txn_count_after_filtering")


@query("sort_state", _report_sql(BY_STATE))
def sort_state(t):
    return _report(t).select(*BY_STATE)


@query(
    "sort_state_month",
    sql.basket("SELECT merch_state, month_date, cost_per_trip FROM idx", WHOLE),
)
def sort_state_month(t):
    return basket_index(t, WHOLE).select("merch_state", "month_date", "cost_per_trip")


def _top(key: str, by: str, descending: bool, columns):
    order = f"ORDER BY {by} {'DESC' if descending else 'ASC'}, state_abbr LIMIT 10"

    @query(key, _report_sql(columns, order))
    def build(t):
        return cap_test.ranked_states(_report(t), by, columns, 10, descending)


PRICE = (
    "state_abbr", "state_name", "median_retail_txn", "retail_basket_cost_2day",
    "txn_count_after_filtering", "pct_txn_capped", "pct_cardholders_affected",
)
CAP = (
    "state_abbr", "state_name", "txn_before_cap", "txn_after_cap", "txn_capped", "pct_txn_capped",
    "cardholders_affected_by_cap", "pct_cardholders_affected", "median_retail_txn",
)
OUTLIERS = (
    "state_abbr", "state_name", "total_txn_before_outlier_removal", "txn_removed_as_outliers",
    "pct_txn_removed_as_outliers", "p5_threshold", "p98_threshold", "median_retail_txn",
)
_top("topk_desc", "median_retail_txn", True, PRICE)
_top("topk_asc", "median_retail_txn", False, PRICE)
_top("topk_cap_most", "pct_txn_capped", True, (*CAP, "retail_basket_cost_2day"))
_top("topk_cap_least", "pct_txn_capped", False, CAP)
_top("topk_outliers", "pct_txn_removed_as_outliers", True, OUTLIERS)


@query(
    "sort_custom_order",
    _report_sql(
        (
            f"{sql.price_bucket('median_retail_txn')} AS median_retail_bucket",
            "count(*) AS num_states",
        ),
        "GROUP BY 1",
    ),
)
def sort_custom_order(t):
    buckets = cap_test.price_distribution(_report(t))
    return buckets.select("median_retail_bucket", "num_states")


@query(
    "sort_abs_alias",
    comparison_sql(CAPPED, "merch_state, month_date, pct_change"),
)
def sort_abs_alias(t):
    return cap_test.cap_comparison(t, CAPPED).select("merch_state", "month_date", "pct_change")


LOW = ("merch_state", "month_date", "unique_visitors", "data_quality_flag")


@query(
    "topk_low_visitors",
    f"""SELECT {', '.join(LOW)} FROM ({sql.category_cost(ACCOMMODATION, "state", WHOLE)})
ORDER BY unique_visitors, merch_state, month_date LIMIT 10""",
)
def topk_low_visitors(t):
    result = category_cost(t, ACCOMMODATION, STATE, WHOLE)
    return result.orderBy("unique_visitors", "merch_state", "month_date").limit(10).select(*LOW)


def _side(label: str, order: str) -> str:
    return f"""SELECT '{label}' AS side, month_date, merch_state, cost_per_trip FROM (
  SELECT * FROM idx WHERE cost_per_trip IS NOT NULL
    AND month_date = (SELECT max(month_date) FROM idx WHERE cost_per_trip IS NOT NULL)
  ORDER BY cost_per_trip {order}, merch_state LIMIT 10)"""


@query(
    "topk_cost_extremes",
    sql.basket(
        f"{_side('most expensive', 'DESC')} UNION ALL {_side('least expensive', 'ASC')}", WHOLE
    ),
)
def topk_cost_extremes(t):
    return cost_extremes(keep(basket_index(t, WHOLE), "index"))


@query(
    "preview",
    sql.basket("SELECT * FROM idx ORDER BY merch_state, month_date LIMIT 20", WHOLE),
)
def preview(t):
    return basket_index(t, WHOLE).orderBy("merch_state", "month_date").limit(20)


@query(
    "sample_rows",
    sql.basket(
        """SELECT * FROM idx ORDER BY
  md5(merch_state || '|' || CAST(month_date AS VARCHAR) || '|review') LIMIT 20""",
        WHOLE,
    ),
)
def sample_rows(t):
    return review_sample(basket_index(t, WHOLE), ["merch_state", "month_date"])


def funnel_sql() -> str:
    where = f"{sql.period(WHOLE)}"
    far = f"{where} AND trans_distance > 60"
    joined = "txn JOIN merch USING (mtid)"
    placed = f"{joined} JOIN geo ON merch_city = CAST(admin2_id AS VARCHAR)"
    coded = f"merch_type = 0 AND {sql.in_category(RETAIL)}"
    steps = (
        ("1 transactions in the period", "txn", where),
        ("2 from visitors", "txn", far),
        ("3 matched to merchants", joined, far),
        ("4 at physical merchants", joined, f"{far} AND merch_type = 0"),
        ("5 with the category's codes", joined, f"{far} AND {coded}"),
        ("6 matched to a county", placed, f"{far} AND {coded}"),
        ("7 in the country", placed, f"{far} AND {coded} AND country = 'United States'"),
    )
    return sql.on_spend(
        " UNION ALL ".join(
            "SELECT '{}' AS check_name, count(*) AS count FROM {} WHERE {}".format(
                label.replace("'", "''"), source, condition
            )
            for label, source, condition in steps
        )
    )


@query("union_filter_funnel", funnel_sql())
def union_filter_funnel(t):
    return filter_funnel(t, WHOLE)


@query("retail_filter_funnel", funnel_sql())
def retail_filter_funnel(t):
    return filter_funnel(t, WHOLE, RETAIL)


def _union_sql() -> str:
    parts = []
    for start, end in PERIODS:
        config = WHOLE.with_(start=start, end=end)
        parts.append(
            f"""SELECT merch_state, month_date, attraction_cost, NULL AS retail_cost,
  transaction_count FROM ({sql.category_cost(ATTRACTION, "state", config)})"""
        )
    parts.append(
        f"""SELECT merch_state, month_date, NULL, retail_cost, transaction_count
FROM ({sql.category_cost(RETAIL, "state", WHOLE)})"""
    )
    return " UNION ALL ".join(parts)


@query("union_by_name", _union_sql())
def union_by_name(t):
    """Parts with different columns under one another, all from one pass."""
    costs = costs_by_category(t, (ATTRACTION, RETAIL), STATE, WHOLE)

    def result(category, cost, period=None):
        frame = costs[category.name].select("merch_state", "month_date", cost, "transaction_count")
        return frame if period is None else frame.filter(in_period(*period, "month_date"))

    first, second = (result(ATTRACTION, "attraction_cost", period) for period in PERIODS)
    return first.unionByName(second).unionByName(
        result(RETAIL, "retail_cost"), allowMissingColumns=True
    )
