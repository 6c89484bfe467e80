"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from triptally.config import ACCOMMODATION, ATTRACTION, RESTAURANT, RETAIL, RETAIL_NO_MINIMUM
from triptally.operators import capping, joins
from triptally.operators.distribution import count_purchases, inside_band, price_points
from triptally.operators.joins import STATE
from triptally.plans.basket import join_components
from triptally.plans.cap_test import cap_comparison, medians_in_global_band, retail_cap_test
from triptally.plans.category import category_cost, costs_by_category, visitor_rows
from triptally.plans.county import CATEGORIES as COUNTY_CATEGORIES
from triptally.plans.county import anchored_sides
from triptally.registry import sql
from triptally.registry.base import CAP_TEST, CAPPED, EVERY_MONTH, EVERY_SNAPSHOT, WHOLE, query
from triptally.registry.scalars import comparison_sql
from triptally.session import fresh_folder
from triptally.sources.tables import SpendTables
from triptally.sources.writers import write_bucketed

KEYS = ["merch_state", "month_date"]
JOINED = ("mtid", "merch_state", "mcc", "trans_date", "membccid", "trans_amount")


@query(
    "join_txn_merchant",
    sql.on_spend(f"SELECT {', '.join(JOINED)} FROM txn JOIN merch USING (mtid, ref_date)"),
)
def join_txn_merchant(t):
    return joins.with_merchants(t.transactions, t.merchants).select(*JOINED)


@query(
    "join_txn_merchant_mtid",
    sql.on_spend(
        """SELECT merch_state, mcc, trans_date, count(*) AS n, min(trans_amount) AS lowest,
  max(trans_amount) AS highest FROM txn JOIN merch USING (mtid) GROUP BY ALL"""
    ),
)
def join_txn_merchant_mtid(t):
    merchants = t.merchants.select("mtid", "ref_date", "merch_state", "mcc")
    rows = joins.with_merchants(t.transactions.drop("ref_date"), merchants, snapshot=False)
    return rows.groupBy("merch_state", "mcc", "trans_date").agg(
        joins.purchases_in(rows).alias("n"),
        F.min("trans_amount").alias("lowest"),
        F.max("trans_amount").alias("highest"),
    )


@query(
    "join_state_division",
    sql.on_spend(
        """SELECT census_region_division, merch_state, mcc, count(*) AS merchants
FROM merch JOIN bridge ON merch_state = abbreviation GROUP BY ALL"""
    ),
)
def join_state_division(t):
    placed = joins.with_division(t.merchants, t.bridge)
    return placed.groupBy("census_region_division", "merch_state", "mcc").agg(
        F.count("*").alias("merchants")
    )


@query(
    "join_thresholds",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([ACCOMMODATION], "state", WHOLE)}),
{sql.trimmed("base", "merch_state, month_date", WHOLE)}
SELECT merch_state, month_date, membccid, trans_amount, count(*) AS n FROM kept GROUP BY ALL"""
    ),
)
def join_thresholds(t):
    purchases = count_purchases(visitor_rows(t, [ACCOMMODATION], STATE, WHOLE), KEYS)
    bands = price_points(purchases, KEYS, {}, WHOLE)
    return inside_band(purchases, bands, KEYS, WHOLE).select(
        *KEYS, "membccid", "trans_amount", "n"
    )


def _impact_sql(columns: str) -> str:
    base = sql.rows([RETAIL], "state", CAPPED)
    keys = "merch_state, month_date"
    return sql.on_spend(
        f"""WITH base AS ({base}), raw AS ({sql.ranked("base", "merch_state")}),
{sql.impact_ctes(keys, CAPPED.daily_cap, "shoppers")} SELECT {keys}, {columns} FROM impact"""
    )


def _impact(t):
    daily = capping.count_daily_purchases(visitor_rows(t, [RETAIL], STATE, CAPPED), KEYS)
    ranked = capping.rank_purchases(daily, ["merch_state"])
    return capping.capping_impact(ranked, KEYS, CAPPED.daily_cap)


@query(
    "join_cardholder_patterns",
    _impact_sql("avg_txn_per_cardholder_per_day, frequent_high_volume_shoppers"),
)
def join_cardholder_patterns(t):
    return _impact(t).select(
        *KEYS, "avg_txn_per_cardholder_per_day", "frequent_high_volume_shoppers"
    )


@query(
    "join_capping_impact",
    f"""SELECT merch_state, month_date, retail_cost, txn_before_cap, txn_after_cap, txn_capped
FROM ({sql.category_cost(RETAIL, "state", CAPPED)})""",
)
def join_capping_impact(t):
    return category_cost(t, RETAIL, STATE, CAPPED).select(
        *KEYS, "retail_cost", "txn_before_cap", "txn_after_cap", "txn_capped"
    )


REPORT = (
    "state_abbr", "median_retail_txn", "txn_before_cap", "txn_capped",
    "total_txn_before_outlier_removal", "p5_threshold", "p98_threshold",
)


@query(
    "join_cap_test_report",
    sql.cap_test(f"SELECT {', '.join(REPORT)} FROM report", CAP_TEST, RETAIL_NO_MINIMUM),
)
def join_cap_test_report(t):
    return retail_cap_test(t, CAP_TEST).select(*REPORT)


@query(
    "join_geo_reference",
    sql.on_spend(
        """SELECT merch_city, admin1, admin2, count(DISTINCT mtid) AS merchants, count(*) AS pairs
FROM merch JOIN geo ON merch_city = CAST(admin2_id AS VARCHAR) GROUP BY ALL"""
    ),
)
def join_geo_reference(t):
    places = t.geo_reference.groupBy(
        F.col("admin2_id").cast("string").alias("merch_city"), "admin1", "admin2"
    ).agg(F.count("*").alias("records"))
    shops = t.merchants.groupBy("merch_city", "mtid").agg(F.count("*").alias("snapshots"))
    return (
        shops.join(places, "merch_city")
        .groupBy("merch_city", "admin1", "admin2")
        .agg(
            F.count("*").alias("merchants"),
            F.sum(F.col("snapshots") * F.col("records")).alias("pairs"),
        )
    )


@query(
    "join_cap_compare",
    comparison_sql(CAPPED, "merch_state, month_date, median_uncapped, median_capped"),
)
def join_cap_compare(t):
    return cap_comparison(t, CAPPED).select(*KEYS, "median_uncapped", "median_capped")


@query("join_stored_buckets", sql.category_cost(RETAIL, "state", WHOLE))
def join_stored_buckets(t):
    """The retail index on tables stored by merchant and snapshot: their join moves no transaction."""
    folder = fresh_folder(t.spark, "buckets")
    names = {}
    for kind, frame in (("transactions", t.transactions), ("merchants", t.merchants)):
        names[kind] = f"{kind}_{folder.rsplit('-', 1)[-1]}"
        write_bucketed(frame, names[kind], 16, f"{folder}/{kind}")
    stored = SpendTables.from_catalog(t.spark, names["transactions"], names["merchants"])
    return category_cost(stored, RETAIL, STATE, WHOLE).drop("calculation_timestamp")


@query(
    "join_basket",
    sql.basket(
        """SELECT merch_state, month_date, accommodation_cost, attraction_cost,
  breakfast_lunch_cost, dinner_cost, median_meal_cost, retail_cost
FROM left_half LEFT JOIN right_half USING (merch_state, month_date)""",
        WHOLE,
    ),
)
def join_basket(t):
    """Four results side by side, all from one pass."""
    costs = costs_by_category(t, (ACCOMMODATION, ATTRACTION, RESTAURANT, RETAIL), STATE, WHOLE)
    return join_components(*costs.values())


@query(
    "join_county_anchor",
    sql.county(
        """SELECT county_fips, month_date, breakfast_lunch_cost, dinner_cost, attraction_cost,
  retail_cost, lodging_cost FROM county""",
        EVERY_MONTH,
        COUNTY_CATEGORIES,
    ),
)
def join_county_anchor(t):
    keys = ["county_fips", "month_date"]
    cards, rates, months = anchored_sides(t, EVERY_MONTH)
    return months.join(cards, keys, "left").join(rates, keys, "left").select(
        *keys, "breakfast_lunch_cost", "dinner_cost", "attraction_cost", "retail_cost",
        "lodging_cost",
    )


def _global_band(key: str, config):
    @query(
        key,
        sql.on_spend(
            f"""WITH base AS ({sql.rows([RETAIL], "state", config)})
SELECT merch_state, month_date, quantile_disc(trans_amount, 0.5) AS median_uncapped,
  count(*) AS txn_count_uncapped
FROM base WHERE trans_amount BETWEEN (SELECT quantile_disc(trans_amount, 0.05) FROM base)
  AND (SELECT quantile_disc(trans_amount, 0.98) FROM base)
GROUP BY merch_state, month_date"""
        ),
    )
    def build(t):
        return medians_in_global_band(t, config)


_global_band("scalar_subquery_band", WHOLE)
_global_band("scalar_subquery_band_every_snapshot", EVERY_SNAPSHOT)
