"""Column expressions, each over a whole table or result."""

from __future__ import annotations

from pyspark.sql import functions as F

from triptally.config import (
    ACCOMMODATION,
    ATTRACTION,
    CATEGORIES,
    RESTAURANT,
    RETAIL,
    RETAIL_NO_MINIMUM,
)
from triptally.functions.scalars import (
    card_day_key,
    category_of,
    month_bounds,
    month_start,
    normalize_dc_county,
    percent_of,
    price_bucket,
)
from triptally.operators.distribution import count_purchases, percentile_vector
from triptally.operators.joins import NATIONAL, STATE
from triptally.plans.basket import basket_index, component_costs
from triptally.plans.cap_test import cap_comparison, retail_cap_test
from triptally.plans.category import category_cost, visitor_rows
from triptally.plans.county import CATEGORIES as COUNTY_CATEGORIES
from triptally.plans.county import COUNTS, county_index
from triptally.registry import sql
from triptally.registry.base import BY_TRANSACTIONS, CAP_TEST, CAPPED, EVERY_MONTH, WHOLE, query
from triptally.schemas import COUNTY_INDEX
from triptally.sources.writers import conform


@query(
    "fn_month_trunc",
    sql.on_spend(
        """SELECT CAST(date_trunc('month', trans_date) AS DATE) AS month_date, count(*) AS n
FROM txn GROUP BY ALL"""
    ),
)
def fn_month_trunc(t):
    months = t.transactions.groupBy(month_start(F.col("trans_date")).alias("month_date"))
    return months.agg(F.count("*").alias("n"))


@query(
    "fn_month_bounds",
    sql.on_spend(
        """SELECT DISTINCT trans_date, CAST(date_trunc('month', trans_date) AS DATE) AS month_start,
  last_day(trans_date) AS month_end FROM txn"""
    ),
)
def fn_month_bounds(t):
    first, last = month_bounds(F.col("trans_date"))
    bounds = t.transactions.select("trans_date").distinct()
    return bounds.select("trans_date", first.alias("month_start"), last.alias("month_end"))


@query(
    "fn_category_case",
    sql.on_spend(
        f"""SELECT mcc, CASE WHEN {sql.in_category(ACCOMMODATION)} THEN 'accommodation'
  WHEN {sql.in_category(ATTRACTION)} THEN 'attraction'
  WHEN {sql.in_category(RESTAURANT)} THEN 'restaurant'
  WHEN {sql.in_category(RETAIL)} THEN 'retail' ELSE 'other' END AS category,
  count(*) AS merchants FROM merch GROUP BY ALL"""
    ),
)
def fn_category_case(t):
    labelled = t.merchants.groupBy("mcc", category_of("mcc", CATEGORIES).alias("category"))
    return labelled.agg(F.count("*").alias("merchants"))


@query(
    "fn_quality_flag",
    f"""SELECT merch_state, month_date, transaction_count, data_quality_flag
FROM ({sql.category_cost(RETAIL, "state", BY_TRANSACTIONS)})""",
)
def fn_quality_flag(t):
    return category_cost(t, RETAIL, STATE, BY_TRANSACTIONS).select(
        "merch_state", "month_date", "transaction_count", "data_quality_flag"
    )


@query(
    "fn_safe_pct",
    sql.on_spend(
        f"""SELECT merch_state, month_date, {sql.pct("far", "n")} AS pct_visitors,
  {sql.pct("far", "dear")} AS pct_of_dear
FROM (SELECT merch_state, CAST(date_trunc('month', trans_date) AS DATE) AS month_date,
  count(*) AS n, count(*) FILTER (trans_distance > 60) AS far,
  count(*) FILTER (trans_amount > 900) AS dear
  FROM txn JOIN merch USING (mtid, ref_date) GROUP BY ALL)"""
    ),
)
def fn_safe_pct(t):
    rows = t.transactions.join(t.merchants.select("mtid", "ref_date", "merch_state"),
                               ["mtid", "ref_date"])
    counts = rows.groupBy("merch_state", month_start(F.col("trans_date")).alias("month_date")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("trans_distance") > 60).alias("far"),
        F.count_if(F.col("trans_amount") > 900).alias("dear"),
    )
    return counts.select(
        "merch_state", "month_date",
        percent_of(F.col("far"), F.col("n")).alias("pct_visitors"),
        percent_of(F.col("far"), F.col("dear")).alias("pct_of_dear"),
    )


@query(
    "fn_round",
    sql.on_spend(
        f"SELECT mtid, trans_date, {sql.half_up('trans_amount')} AS amount FROM txn"
    ),
)
def fn_round(t):
    return t.transactions.select(
        "mtid", "trans_date", F.round("trans_amount", 2).alias("amount")
    )


@query(
    "fn_composite_key",
    sql.on_spend(
        f"""SELECT merch_state, count(DISTINCT membccid || '_' || CAST(trans_date AS VARCHAR))
  AS card_days FROM ({sql.rows([RETAIL], "state", WHOLE)}) GROUP BY ALL"""
    ),
)
def fn_composite_key(t):
    rows = visitor_rows(t, [RETAIL], STATE, WHOLE)
    key = card_day_key(F.col("membccid"), F.col("trans_date"))
    return rows.groupBy("merch_state").agg(F.count_distinct(key).alias("card_days"))


@query(
    "fn_cast_id",
    sql.on_spend("SELECT admin3_id, CAST(admin2_id AS VARCHAR) AS county_fips FROM geo"),
)
def fn_cast_id(t):
    return t.geo_reference.select(
        "admin3_id", F.col("admin2_id").cast("string").alias("county_fips")
    )


@query(
    "fn_geo_literal",
    f"""SELECT geography_level, month_date, transaction_count
FROM ({sql.category_cost(RETAIL, "national", WHOLE)})""",
)
def fn_geo_literal(t):
    return category_cost(t, RETAIL, NATIONAL, WHOLE).select(
        "geography_level", "month_date", "transaction_count"
    )


@query(
    "fn_run_metadata",
    f"""SELECT merch_state, month_date, period_start, period_end, max_daily_cap, TRUE AS has_run_time
FROM ({sql.category_cost(RETAIL, "state", CAPPED)})""",
)
def fn_run_metadata(t):
    return category_cost(t, RETAIL, STATE, CAPPED).select(
        "merch_state", "month_date", "period_start", "period_end", "max_daily_cap",
        F.col("calculation_timestamp").isNotNull().alias("has_run_time"),
    )


@query(
    "fn_basket_cost",
    sql.basket("SELECT month_date, merch_state, cost_per_trip FROM idx", WHOLE),
)
def fn_basket_cost(t):
    return basket_index(t, WHOLE).select("month_date", "merch_state", "cost_per_trip")


@query(
    "fn_component_cost",
    sql.basket(
        """SELECT month_date, merch_state, accommodation_cost * 2 AS accommodation_total,
  attraction_cost * 2 AS attraction_total, breakfast_lunch_cost * 4 AS breakfast_lunch_total,
  dinner_cost * 2 AS dinner_total, retail_cost * 2 AS retail_total FROM idx""",
        WHOLE,
    ),
)
def fn_component_cost(t):
    return component_costs(basket_index(t, WHOLE))


@query("fn_project_basket", sql.basket(f"SELECT {sql.BASKET_COLUMNS} FROM idx", WHOLE))
def fn_project_basket(t):
    return basket_index(t, WHOLE).drop("cost_per_trip")


@query(
    "fn_duplicate_alias",
    sql.cap_test("SELECT state_abbr, state_name FROM report", CAP_TEST, RETAIL_NO_MINIMUM),
)
def fn_duplicate_alias(t):
    return retail_cap_test(t, CAP_TEST).select("state_abbr", "state_name")


@query(
    "fn_price_bucket",
    sql.on_spend(
        f"SELECT {sql.price_bucket('trans_amount')} AS bucket, count(*) AS n FROM txn GROUP BY ALL"
    ),
)
def fn_price_bucket(t):
    buckets = t.transactions.groupBy(price_bucket(F.col("trans_amount")).alias("bucket"))
    return buckets.agg(F.count("*").alias("n"))


def comparison_sql(config, columns: str, order: str = "") -> str:
    base = sql.rows([RETAIL], "state", config)
    keys = "merch_state, month_date"
    sides = []
    for name, source in (("u", "raw"), ("c", "capped")):
        ctes = sql.trimmed(source, keys, config)
        for cte in ("thr", "kept"):
            ctes = ctes.replace(cte, f"{name}_{cte}")
        sides.append(
            f"""{ctes}, {name} AS (SELECT {keys}, quantile_disc(trans_amount, 0.5) AS {name}_median,
  count(*) AS {name}_n FROM {name}_kept GROUP BY {keys})"""
        )
    return sql.on_spend(
        f"""WITH base AS ({base}), raw AS ({sql.ranked("base", "merch_state")}),
capped AS (SELECT * FROM raw WHERE daily_rank <= {config.daily_cap}), {", ".join(sides)},
compared AS (SELECT {keys}, u_median AS median_uncapped, c_median AS median_capped,
    {sql.half_up("c_median - u_median")} AS median_difference,
    {sql.pct("c_median - u_median", "u_median")} AS pct_change,
    u_n AS txn_count_uncapped, c_n AS txn_count_capped, u_n - c_n AS txn_removed_by_cap
  FROM u JOIN c USING ({keys}))
SELECT {columns} FROM compared {order}"""
    )


@query(
    "fn_abs_change",
    comparison_sql(
        CAPPED,
        "merch_state, month_date, abs(median_difference) AS abs_difference, "
        "abs(pct_change) AS abs_pct_change",
    ),
)
def fn_abs_change(t):
    return cap_comparison(t, CAPPED).select(
        "merch_state", "month_date",
        F.abs("median_difference").alias("abs_difference"),
        F.abs("pct_change").alias("abs_pct_change"),
    )


@query(
    "fn_normalize_dc",
    sql.on_spend(
        """SELECT CASE WHEN county_fips IS NULL AND state_abbr = 'DC' THEN '11001' ELSE county_fips
  END AS county_fips, state_abbr, count(*) AS nights FROM lodging GROUP BY ALL"""
    ),
)
def fn_normalize_dc(t):
    county = normalize_dc_county(F.col("county_fips"), F.col("state_abbr"))
    return t.lodging.groupBy(county.alias("county_fips"), "state_abbr").agg(
        F.count("*").alias("nights")
    )


@query(
    "fn_fill_counts",
    sql.county(f"SELECT county_fips, month_date, {', '.join(COUNTS)} FROM county", EVERY_MONTH,
               COUNTY_CATEGORIES),
)
def fn_fill_counts(t):
    return county_index(t, EVERY_MONTH).select("county_fips", "month_date", *COUNTS)


@query("fn_output_schema", sql.county("SELECT * FROM county", EVERY_MONTH, COUNTY_CATEGORIES))
def fn_output_schema(t):
    return conform(county_index(t, EVERY_MONTH), COUNTY_INDEX).drop("created_at")


@query(
    "fn_meets_threshold",
    sql.county("SELECT county_fips, month_date, meets_threshold FROM county", EVERY_MONTH,
               COUNTY_CATEGORIES),
)
def fn_meets_threshold(t):
    return county_index(t, EVERY_MONTH).select("county_fips", "month_date", "meets_threshold")


@query(
    "fn_array_offset",
    sql.on_spend(
        f"""SELECT merch_state, quantile_disc(trans_amount, 0.05) AS p5,
  quantile_disc(trans_amount, 0.5) AS p50, quantile_disc(trans_amount, 0.95) AS p95
FROM ({sql.rows([RESTAURANT], "state", WHOLE)}) GROUP BY ALL"""
    ),
)
def fn_array_offset(t):
    rows = visitor_rows(t, [RESTAURANT], STATE, WHOLE)
    vector = percentile_vector(count_purchases(rows, ["merch_state"]), ["merch_state"])
    points = F.col("percentiles")
    return vector.select(
        "merch_state", points[1].alias("p5"), points[10].alias("p50"), points[19].alias("p95")
    )
