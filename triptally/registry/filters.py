"""Row filters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from triptally.config import ACCOMMODATION, ATTRACTION, RESTAURANT, RESTAURANT_MEDIAN, RETAIL
from triptally.functions.scalars import above_minimum, code_in, month_start
from triptally.operators import capping, filters, joins
from triptally.operators.distribution import count_purchases, price_list, trim
from triptally.operators.joins import STATE
from triptally.plans.basket import basket_index
from triptally.plans.category import category_cost, visitor_rows
from triptally.plans.reports import city_profile
from triptally.registry import sql
from triptally.registry.base import BY_TRANSACTIONS, WHOLE, query
from triptally.sources.writers import keep

PURCHASE = ("mtid", "membccid", "trans_date", "trans_amount")
BY_CODE = "SELECT mcc, merch_state, count(*) AS merchants FROM merch WHERE {} GROUP BY ALL"


def _by_code(merchants):
    return merchants.groupBy("mcc", "merch_state").agg(F.count("*").alias("merchants"))


@query(
    "flt_date_range",
    sql.on_spend(
        f"SELECT {', '.join(PURCHASE)} FROM txn "
        "WHERE trans_date BETWEEN DATE '1996-02-10' AND DATE '1999-08-20'"
    ),
)
def flt_date_range(t):
    kept = t.transactions.filter(filters.in_period(date(1996, 2, 10), date(1999, 8, 20)))
    return kept.select(*PURCHASE)


@query(
    "flt_visitor",
    sql.on_spend(f"SELECT {', '.join(PURCHASE)}, trans_distance FROM txn WHERE trans_distance > 60"),
)
def flt_visitor(t):
    return t.transactions.filter(filters.from_visitors(60)).select(*PURCHASE, "trans_distance")


@query("flt_physical", sql.on_spend(BY_CODE.format("merch_type = 0")))
def flt_physical(t):
    return _by_code(t.merchants.filter(filters.physical()))


@query("flt_country", sql.on_spend(BY_CODE.format("merch_country = 'US'")))
def flt_country(t):
    return _by_code(t.merchants.filter(filters.in_us()))


@query("flt_mcc_range", sql.on_spend(BY_CODE.format(sql.in_category(ACCOMMODATION))))
def flt_mcc_range(t):
    return _by_code(t.merchants.filter(code_in("mcc", ACCOMMODATION)))


@query("flt_mcc_eq", sql.on_spend(BY_CODE.format("mcc = '5812'")))
def flt_mcc_eq(t):
    return _by_code(t.merchants.filter(code_in("mcc", RESTAURANT)))


LISTS = (RESTAURANT_MEDIAN, ATTRACTION, RETAIL)


@query(
    "flt_mcc_in",
    sql.on_spend(BY_CODE.format(" OR ".join(sql.in_category(c) for c in LISTS))),
)
def flt_mcc_in(t):
    return _by_code(t.merchants.filter(filters.in_categories(LISTS)))


@query(
    "flt_min_amount",
    sql.on_spend(
        f"""SELECT mcc, trans_date, membccid, trans_amount FROM txn JOIN merch USING (mtid, ref_date)
WHERE NOT {sql.in_category(ACCOMMODATION)} OR trans_amount >= 50"""
    ),
)
def flt_min_amount(t):
    rows = joins.with_merchants(t.transactions, t.merchants.select("mtid", "ref_date", "mcc"))
    label = F.when(code_in("mcc", ACCOMMODATION), "accommodation").otherwise("other")
    kept = rows.filter(above_minimum(F.col("trans_amount"), label, [ACCOMMODATION, RETAIL]))
    return kept.select("mcc", "trans_date", "membccid", "trans_amount")


KEYS = ["merch_state", "month_date"]


@query(
    "flt_trim_band",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([RETAIL], "state", WHOLE)}),
{sql.trimmed("base", "merch_state, month_date", WHOLE)}
SELECT merch_state, month_date, trans_amount, count(*) AS n, any_value(p5) AS low,
  any_value(p98) AS high
FROM kept GROUP BY merch_state, month_date, trans_amount"""
    ),
)
def flt_trim_band(t):
    prices = price_list(count_purchases(visitor_rows(t, [RETAIL], STATE, WHOLE), KEYS), KEYS)
    kept = trim(prices, KEYS, *WHOLE.trim, WHOLE.method)
    return kept.select(*KEYS, "trans_amount", "n", "low", "high")


@query(
    "flt_rank_cap",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([RETAIL], "state", WHOLE)})
SELECT merch_state, trans_date, membccid, trans_amount
FROM ({sql.ranked("base", "merch_state")}) WHERE daily_rank <= 1"""
    ),
)
def flt_rank_cap(t):
    top = capping.top_of_day(visitor_rows(t, [RETAIL], STATE, WHOLE), 1, ["merch_state"])
    return top.select("merch_state", "trans_date", "membccid", "trans_amount")


@query(
    "flt_invalid_state",
    sql.on_spend("SELECT merch_state, count(*) AS n FROM merch WHERE merch_state <> 'XX' GROUP BY ALL"),
)
def flt_invalid_state(t):
    known = t.merchants.filter(filters.known_state())
    return known.groupBy("merch_state").agg(F.count("*").alias("n"))


@query(
    "flt_latest_month",
    sql.basket("SELECT * FROM idx WHERE month_date = (SELECT max(month_date) FROM idx)", WHOLE),
)
def flt_latest_month(t):
    return filters.latest_month(keep(basket_index(t, WHOLE), "index"))


@query(
    "flt_one_state",
    sql.basket("SELECT month_date, cost_per_trip FROM idx WHERE merch_state = 'NATION_5'", WHOLE),
)
def flt_one_state(t):
    index = basket_index(t, WHOLE).filter(F.col("merch_state") == "NATION_5")
    return index.select("month_date", "cost_per_trip").orderBy("month_date")


@query(
    "flt_country_notnull",
    sql.on_spend(
        """SELECT country, admin1, admin2, admin2_id, admin3 FROM geo
WHERE country = 'United States' AND admin2_id IS NOT NULL"""
    ),
)
def flt_country_notnull(t):
    kept = t.geo_reference.filter(
        (F.col("country") == "United States") & F.col("admin2_id").isNotNull()
    )
    return kept.select("country", "admin1", "admin2", "admin2_id", "admin3")


@query(
    "flt_weekend_nights",
    sql.on_spend(
        """SELECT county_fips, stay_date, property_id, adr,
  CAST(date_trunc('month', stay_date) AS DATE) AS month_date
FROM lodging WHERE dayofweek(stay_date) IN (5, 6)"""
    ),
)
def flt_weekend_nights(t):
    return t.lodging.filter(filters.weekend_night()).select(
        "county_fips", "stay_date", "property_id", "adr",
        month_start(F.col("stay_date")).alias("month_date"),
    )


@query(
    "flt_below_threshold",
    f"""SELECT merch_state, month_date, transaction_count, data_quality_flag
FROM ({sql.category_cost(RETAIL, 'state', BY_TRANSACTIONS)}) WHERE transaction_count BETWEEN 3 AND 4""",
)
def flt_below_threshold(t):
    result = category_cost(t, RETAIL, STATE, BY_TRANSACTIONS)
    limit = BY_TRANSACTIONS.sample_rolling
    return result.filter(filters.just_below("transaction_count", limit, 2)).select(
        "merch_state", "month_date", "transaction_count", "data_quality_flag"
    )


@query(
    "flt_merch_city_profile",
    sql.on_spend(
        """SELECT merch_city, count(*) AS count FROM merch WHERE merch_city IS NOT NULL
GROUP BY merch_city ORDER BY count DESC, merch_city LIMIT 10"""
    ),
)
def flt_merch_city_profile(t):
    return city_profile(t.merchants)
