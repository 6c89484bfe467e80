"""Aggregations."""

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
from triptally.operators import capping
from triptally.operators.distribution import (
    count_purchases,
    percentile_vector,
    price_points,
    remove_outliers,
    visitors,
)
from triptally.operators.joins import DIVISION, NATIONAL, STATE
from triptally.plans import cap_test, reports
from triptally.plans.basket import COMPONENTS, basket_index
from triptally.plans.category import (
    category_cost,
    category_costs,
    category_prices,
    visitor_rows,
)
from triptally.plans.county import CATEGORIES as COUNTY_CATEGORIES
from triptally.plans.county import county_index, lodging_rates
from triptally.registry import sql
from triptally.registry.base import CAP_TEST, CAPPED, COUNTY, EVERY_MONTH, EVERY_SNAPSHOT, WHOLE, query
from triptally.schemas import COUNTY_INDEX
from triptally.session import fresh_folder
from triptally.sources.publish import PublishedTable

KEYS = ["merch_state", "month_date"]
STATE_KEYS = "merch_state, month_date"


def _purchases(t, category, keys=KEYS, level=STATE, config=WHOLE):
    return count_purchases(visitor_rows(t, [category], level, config), keys)


def _grouped(category, columns: str, keys: str = STATE_KEYS, level: str = "state") -> str:
    base = sql.rows([category], level, WHOLE)
    return sql.on_spend(f"SELECT {keys}, {columns} FROM ({base}) GROUP BY {keys}")


def _register_thresholds(level):
    keys = [level.column, "month_date"]
    columns = """quantile_disc(trans_amount, 0.05) AS low, quantile_disc(trans_amount, 0.98) AS high,
  count(*) AS n_before"""

    @query(
        f"agg_thresholds_{level.name}",
        _grouped(ATTRACTION, columns, ", ".join(keys), level.name),
    )
    def thresholds(t):
        bands = price_points(_purchases(t, ATTRACTION, keys, level), keys, {}, WHOLE)
        return bands.select(*keys, "low", "high", "n_before")


for each in (STATE, DIVISION, NATIONAL):
    _register_thresholds(each)


@query(
    "agg_thresholds_period",
    _grouped(
        RETAIL,
        """quantile_disc(trans_amount, 0.05) AS low, quantile_disc(trans_amount, 0.98) AS high,
  count(*) AS n_before""",
        "merch_state",
    ),
)
def agg_thresholds_period(t):
    keys = ["merch_state"]
    bands = price_points(_purchases(t, RETAIL, keys), keys, {}, WHOLE)
    return bands.select(*keys, "low", "high", "n_before")


UNTRIMMED = WHOLE.with_(trim=None)


def _points(t, category, **shares):
    return price_points(_purchases(t, category), KEYS, shares, UNTRIMMED)


@query("agg_median", _grouped(ATTRACTION, "quantile_disc(trans_amount, 0.5) AS median"))
def agg_median(t):
    return _points(t, ATTRACTION, median=0.5).select(*KEYS, "median")


@query(
    "agg_meal_percentiles",
    _grouped(
        RESTAURANT,
        """quantile_disc(trans_amount, 0.35) AS breakfast_lunch_cost,
  quantile_disc(trans_amount, 0.65) AS dinner_cost,
  quantile_disc(trans_amount, 0.5) AS median_meal_cost""",
    ),
)
def agg_meal_percentiles(t):
    shares = dict(RESTAURANT.prices)
    return _points(t, RESTAURANT, **shares).select(*KEYS, *shares)


@query(
    "agg_quartiles",
    _grouped(
        ACCOMMODATION,
        "quantile_disc(trans_amount, 0.25) AS q25, quantile_disc(trans_amount, 0.75) AS q75",
    ),
)
def agg_quartiles(t):
    return _points(t, ACCOMMODATION, q25=0.25, q75=0.75).select(*KEYS, "q25", "q75")


@query(
    "agg_exact_percentile",
    _grouped(
        RESTAURANT,
        f"""{sql.interpolated(0.35)} AS p35, {sql.interpolated(0.65)} AS p65,
  {sql.interpolated(0.5)} AS median""",
    ),
)
def agg_exact_percentile(t):
    config = UNTRIMMED.with_(method="cont")
    shares = {"p35": 0.35, "p65": 0.65, "median": 0.5}
    return price_points(_purchases(t, RESTAURANT), KEYS, shares, config).select(*KEYS, *shares)


# The n-th of N values in order, n = ceil(N * share): written out, as whole numbers.
_VECTOR = ", ".join(
    f"list_sort(list(trans_amount))[greatest(1, (count(*) * {i} + 19) // 20)]" for i in range(21)
)


@query(
    "agg_percentile_vector",
    _grouped(
        ACCOMMODATION,
        f"""list_value({_VECTOR}) AS percentiles, count(*) AS total_stays,
  min(trans_amount) AS min_cost, max(trans_amount) AS max_cost""",
        "merch_state",
    ),
)
def agg_percentile_vector(t):
    keys = ["merch_state"]
    return percentile_vector(_purchases(t, ACCOMMODATION, keys), keys)


@query("agg_count", _grouped(RETAIL, "count(*) AS transaction_count"))
def agg_count(t):
    rows = visitor_rows(t, [RETAIL], STATE, WHOLE)
    return rows.groupBy(*KEYS).agg(F.count("*").alias("transaction_count"))


@query(
    "agg_unique_visitors",
    _grouped(
        RETAIL,
        "count(*) AS transaction_count, count(DISTINCT membccid) AS unique_visitors",
        "geography_level, month_date",
        "national",
    ),
)
def agg_unique_visitors(t):
    keys = [NATIONAL.column, "month_date"]
    return visitors(_purchases(t, RETAIL, keys, NATIONAL), keys)


@query(
    "agg_min_max_avg",
    _grouped(
        ACCOMMODATION,
        f"""min(trans_amount) AS min_cost, max(trans_amount) AS max_cost,
  {sql.half_up("avg(trans_amount)")} AS avg_cost""",
    ),
)
def agg_min_max_avg(t):
    rows = visitor_rows(t, [ACCOMMODATION], STATE, WHOLE)
    return rows.groupBy(*KEYS).agg(
        F.min("trans_amount").alias("min_cost"),
        F.max("trans_amount").alias("max_cost"),
        F.round(F.avg("trans_amount"), 2).alias("avg_cost"),
    )


def _impact_sql(columns: str) -> str:
    base = sql.rows([RETAIL], "state", CAPPED)
    ctes = sql.impact_ctes(STATE_KEYS, CAPPED.daily_cap, "shoppers")
    return sql.on_spend(
        f"""WITH base AS ({base}), raw AS ({sql.ranked("base", "merch_state")}), {ctes}
SELECT {STATE_KEYS}, {columns} FROM impact"""
    )


def _ranked(t, keys=KEYS):
    daily = capping.count_daily_purchases(visitor_rows(t, [RETAIL], STATE, CAPPED), keys)
    return capping.rank_purchases(daily, ["merch_state"])


@query("agg_cond_sum", _impact_sql("txn_before_cap, txn_after_cap, txn_capped"))
def agg_cond_sum(t):
    days = capping.card_days(_ranked(t), KEYS, CAPPED.daily_cap)
    return days.groupBy(*KEYS).agg(
        F.sum("n_raw").alias("txn_before_cap"),
        F.sum("n_kept").alias("txn_after_cap"),
        F.sum(F.col("n_raw") - F.col("n_kept")).alias("txn_capped"),
    )


@query(
    "agg_cond_distinct",
    _impact_sql("cardholders_affected_by_cap, frequent_high_volume_shoppers"),
)
def agg_cond_distinct(t):
    return capping.capping_impact(_ranked(t), KEYS, CAPPED.daily_cap).select(
        *KEYS, "cardholders_affected_by_cap", "frequent_high_volume_shoppers"
    )


@query(
    "agg_distinct_card_days",
    sql.on_spend(
        f"""SELECT merch_state, count(DISTINCT (membccid, trans_date)) AS card_days,
  count(DISTINCT CASE WHEN daily_rank > 2 THEN membccid || '_' || CAST(trans_date AS VARCHAR) END)
    AS card_days_over
FROM ({sql.ranked(f"({sql.rows([RETAIL], 'state', WHOLE)})", "merch_state")}) GROUP BY ALL"""
    ),
)
def agg_distinct_card_days(t):
    days = capping.card_days(_ranked(t, ["merch_state"]), ["merch_state"], CAPPED.daily_cap)
    return days.groupBy("merch_state").agg(
        F.count("*").alias("card_days"),
        F.count_if(F.col("n_raw") > F.col("n_kept")).alias("card_days_over"),
    )


@query(
    "agg_cardholder_patterns",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([RETAIL], "state", CAPPED)}),
raw AS ({sql.ranked("base", "merch_state")}), {sql.impact_ctes(STATE_KEYS, 2, "shoppers")}
SELECT {STATE_KEYS}, membccid, days AS active_days, days_over AS days_over_cap,
  a_day AS avg_daily_txn_count, most AS max_daily_txn_count FROM by_card"""
    ),
)
def agg_cardholder_patterns(t):
    days = capping.card_days(_ranked(t), KEYS, CAPPED.daily_cap)
    return capping.card_patterns(days, KEYS, CAPPED.daily_cap).select(
        *KEYS, "membccid", "active_days", "days_over_cap", "avg_daily_txn_count",
        "max_daily_txn_count",
    )


@query("agg_capping_impact", _impact_sql(sql.impact_columns("shoppers")))
def agg_capping_impact(t):
    return capping.capping_impact(_ranked(t), KEYS, CAPPED.daily_cap)


IMPACT = (
    "state_abbr", "txn_before_cap", "txn_after_cap", "txn_capped", "pct_txn_capped",
    "cardholders_affected_by_cap", "pct_cardholders_affected", "cardholder_days_affected",
)


@query(
    "agg_capping_impact_state",
    sql.cap_test(f"SELECT {', '.join(IMPACT)} FROM report", CAP_TEST, RETAIL_NO_MINIMUM),
)
def agg_capping_impact_state(t):
    rows = visitor_rows(t, [RETAIL_NO_MINIMUM], STATE, CAP_TEST).withColumnRenamed(
        "merch_state", "state_abbr"
    )
    daily = capping.count_daily_purchases(rows, ["state_abbr"])
    ranked = capping.rank_purchases(daily, ["state_abbr"])
    return capping.capping_impact_over_period(
        ranked, ["state_abbr"], CAP_TEST.daily_cap
    ).select(*IMPACT)


def _all_categories_ctes(config=WHOLE) -> str:
    keys = f"category, {STATE_KEYS}"
    base = sql.rows(CATEGORIES, "state", config)
    return f"""WITH base AS ({base}), {sql.trimmed("base", keys, config)},
after_trim AS (SELECT {keys}, any_value(n_before) AS txn_before, count(*) AS txn_after
  FROM kept GROUP BY {keys})"""


REMOVAL_SQL = sql.on_spend(
    f"""{_all_categories_ctes()}
SELECT category, {STATE_KEYS}, txn_before, txn_after, txn_before - txn_after AS txn_removed,
  {sql.pct("txn_before - txn_after", "txn_before")} AS pct_removed FROM after_trim"""
)


@query("agg_outlier_report", REMOVAL_SQL)
def agg_outlier_report(t):
    return cap_test.outlier_report(t, CATEGORIES, WHOLE)


@query(
    "agg_removal_stats",
    sql.on_spend(
        f"""{_all_categories_ctes()}
SELECT category, {STATE_KEYS}, trans_amount, txn_before, txn_before - txn_after AS txn_removed
FROM kept JOIN after_trim USING (category, {STATE_KEYS})"""
    ),
)
def agg_removal_stats(t):
    """Kept purchases beside what their group lost."""
    keys = ["category", *KEYS]
    kept, removed = remove_outliers(visitor_rows(t, CATEGORIES, STATE, WHOLE), keys, WHOLE)
    both = kept.join(removed, keys)
    return both.select(*keys, "trans_amount", "txn_before", "txn_removed")


@query(
    "agg_removal_stats_every_snapshot",
    sql.on_spend(
        f"""{_all_categories_ctes(EVERY_SNAPSHOT)}
SELECT category, {STATE_KEYS}, trans_amount, count(*) AS purchases, any_value(txn_before) AS txn_before,
  any_value(txn_after) AS txn_after
FROM kept JOIN after_trim USING (category, {STATE_KEYS}) GROUP BY category, {STATE_KEYS}, trans_amount"""
    ),
)
def agg_removal_stats_every_snapshot(t):
    """Kept rows stand for one purchase per snapshot of their merchant."""
    keys = ["category", *KEYS]
    rows = visitor_rows(t, CATEGORIES, STATE, EVERY_SNAPSHOT)
    kept, removed = remove_outliers(rows, keys, EVERY_SNAPSHOT)
    per_price = kept.groupBy(*keys, "trans_amount").agg(F.sum("n").alias("purchases"))
    return per_price.join(removed.drop("txn_removed"), keys)


CARRIED = ("merch_state", "month_date", "transaction_count_final", "txn_before_cap",
           "unique_cardholders_total")


@query(
    "agg_group_with_carried_cols",
    f"SELECT {', '.join(CARRIED)} FROM ({sql.category_cost(ATTRACTION, 'state', CAPPED)})",
)
def agg_group_with_carried_cols(t):
    return category_cost(t, ATTRACTION, STATE, CAPPED).select(*CARRIED)


def _avg(column: str, name: str) -> str:
    return f"{sql.half_up(f'avg({column})')} AS {name}"


def _ends(column: str, name: str) -> str:
    return ", ".join(
        f"{sql.half_up(f'{f}({column})')} AS {f}_{name}" for f in ("min", "max")
    )


SUMMARY_SQL = f"""SELECT count(DISTINCT state_abbr) AS total_states,
  {_avg("median_retail_txn", "avg_state_median_retail")},
  {_ends("median_retail_txn", "state_median_retail")},
  {sql.half_up("quantile_disc(median_retail_txn, 0.5)")} AS median_of_state_medians,
  {sql.half_up("quantile_disc(median_retail_txn, 0.25)")} AS q1_of_state_medians,
  {sql.half_up("quantile_disc(median_retail_txn, 0.75)")} AS q3_of_state_medians,
  {_avg("retail_basket_cost_2day", "avg_basket_cost")},
  {_ends("retail_basket_cost_2day", "basket_cost")},
  {_avg("pct_txn_capped", "avg_pct_txn_capped")},
  {_avg("pct_cardholders_affected", "avg_pct_cardholders_affected")},
  CAST(sum(txn_capped) AS BIGINT) AS total_txn_capped_nationwide,
  CAST(sum(txn_after_cap) AS BIGINT) AS total_txn_retained_nationwide,
  {_avg("pct_txn_removed_as_outliers", "avg_pct_txn_removed_as_outliers")},
  CAST(sum(txn_removed_as_outliers) AS BIGINT) AS total_txn_removed_as_outliers FROM report"""


@query("agg_summary_states", sql.cap_test(SUMMARY_SQL, CAP_TEST, RETAIL_NO_MINIMUM))
def agg_summary_states(t):
    return cap_test.summary_of_states(cap_test.retail_cap_test(t, CAP_TEST))


BUCKETS_SQL = f"""SELECT {sql.price_bucket("median_retail_txn")} AS median_retail_bucket,
  count(*) AS num_states,
  {_avg("median_retail_txn", "avg_median_in_bucket")},
  {_avg("pct_txn_capped", "avg_pct_capped_in_bucket")} FROM report GROUP BY 1"""


@query("agg_price_distribution", sql.cap_test(BUCKETS_SQL, CAP_TEST, RETAIL_NO_MINIMUM))
def agg_price_distribution(t):
    return cap_test.price_distribution(cap_test.retail_cap_test(t, CAP_TEST))


def _rounded(value: str, name: str) -> str:
    return f"round({value}, 8) AS {name}"


@query(
    "agg_describe",
    sql.basket(
        f"""SELECT count(cost_per_trip) AS count, {_rounded("avg(cost_per_trip)", "mean")},
  {_rounded("stddev_samp(cost_per_trip)", "std")}, min(cost_per_trip) AS min,
  {_rounded("quantile_cont(cost_per_trip, 0.25)", "p25")},
  {_rounded("quantile_cont(cost_per_trip, 0.5)", "p50")},
  {_rounded("quantile_cont(cost_per_trip, 0.75)", "p75")}, max(cost_per_trip) AS max FROM idx""",
        WHOLE,
    ),
)
def agg_describe(t):
    described = reports.describe(basket_index(t, WHOLE), "cost_per_trip")
    return described.withColumns(
        {name: F.round(name, 8) for name in ("mean", "std", "p25", "p50", "p75")}
    )


@query(
    "agg_component_ranges",
    sql.basket(
        " UNION ALL ".join(
            f"SELECT '{c}' AS component, min({c}) AS lowest, max({c}) AS highest FROM idx"
            for c in COMPONENTS
        ),
        WHOLE,
    ),
)
def agg_component_ranges(t):
    return reports.component_ranges(basket_index(t, WHOLE), COMPONENTS)


INDEX_COLUMNS = ("month_date", "merch_state", *COMPONENTS, "cost_per_trip")


@query(
    "agg_missing_values",
    sql.basket(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing FROM idx"
            for c in INDEX_COLUMNS
        ),
        WHOLE,
    ),
)
def agg_missing_values(t):
    return reports.missing_values(basket_index(t, WHOLE), INDEX_COLUMNS)


@query(
    "agg_coverage",
    sql.basket(
        """SELECT count(*) AS records, min(month_date) AS first_month, max(month_date) AS last_month,
  count(DISTINCT month_date) AS months, count(DISTINCT merch_state) AS geographies FROM idx""",
        WHOLE,
    ),
)
def agg_coverage(t):
    return reports.coverage(basket_index(t, WHOLE))


@query(
    "agg_month_sets",
    sql.on_spend(
        f"""{_all_categories_ctes()}
SELECT category, count(DISTINCT month_date) AS months, min(month_date) AS first_month,
  max(month_date) AS last_month,
  string_agg(DISTINCT CAST(month_date AS VARCHAR), ',' ORDER BY CAST(month_date AS VARCHAR))
    AS all_months
FROM after_trim GROUP BY category"""
    ),
)
def agg_month_sets(t):
    sets = reports.month_sets(category_prices(t, CATEGORIES, STATE, WHOLE))
    months = F.col("months")
    return sets.select(
        "category",
        F.size(months).cast("long").alias("months"),
        months[0].alias("first_month"),
        F.element_at(months, -1).alias("last_month"),
        F.concat_ws(",", months.cast("array<string>")).alias("all_months"),
    )


@query(
    "agg_base_count",
    sql.on_spend(
        f"""SELECT category, count(*) AS base_rows FROM ({sql.rows(CATEGORIES, "state", WHOLE)})
GROUP BY category"""
    ),
)
def agg_base_count(t):
    rows = visitor_rows(t, CATEGORIES, STATE, WHOLE)
    return rows.groupBy("category").agg(F.count("*").alias("base_rows"))


RATE = "avg_adr", "lodging_txn_count", "hotel_property_count", "lodging_cost"


def _rates_sql(columns: str) -> str:
    ctes = sql.weekend_ctes(COUNTY.index.start, COUNTY.index.end)
    return sql.on_spend(f"WITH {ctes} {columns}")


@query(
    "agg_lodging_adr",
    _rates_sql(
        """SELECT county_fips, month_date, round(avg_adr, 6) AS avg_adr, lodging_txn_count,
  hotel_property_count, round(lodging_cost, 6) AS lodging_cost FROM rates"""
    ),
)
def agg_lodging_adr(t):
    return lodging_rates(t, COUNTY).withColumns(
        {name: F.round(name, 6) for name in ("avg_adr", "lodging_cost")}
    )


@query(
    "agg_lodging_weighted",
    _rates_sql(
        """SELECT county_fips, month_date, round(sum(adr * occupancy) / sum(occupancy), 6) AS avg_adr
FROM nights WHERE county_fips IS NOT NULL GROUP BY ALL"""
    ),
)
def agg_lodging_weighted(t):
    rates = lodging_rates(t, COUNTY, by_occupancy=True)
    return rates.select("county_fips", "month_date", F.round("avg_adr", 6).alias("avg_adr"))


@query(
    "agg_property_count",
    _rates_sql("SELECT county_fips, month_date, hotel_property_count FROM rates"),
)
def agg_property_count(t):
    return lodging_rates(t, COUNTY).select("county_fips", "month_date", "hotel_property_count")


def _county_sql(body: str) -> str:
    return sql.county(body, COUNTY, COUNTY_CATEGORIES)


# One county's month is written twice, by a run of its own.
_TWICE = """county_fips = (SELECT min(county_fips) FROM county WHERE meets_threshold)
  AND month_date = (SELECT max(month_date) FROM county WHERE meets_threshold
    AND county_fips = (SELECT min(county_fips) FROM county WHERE meets_threshold))"""


@query(
    "agg_write_verification",
    _county_sql(
        f"""SELECT month_date, count(*) AS total_records, count(DISTINCT county_fips) AS unique_counties,
  count(*) FILTER (meets_threshold) AS counties_meeting_threshold,
  count(*) - count(DISTINCT county_fips) AS duplicate_keys
FROM (SELECT * FROM county UNION ALL SELECT * FROM county WHERE {_TWICE}) GROUP BY month_date"""
    ),
)
def agg_write_verification(t):
    return reports.write_verification(_published_counties(t)[0].read())


@query(
    "agg_counts_while_writing",
    _county_sql(
        f"""SELECT 'all' AS run, count(*) AS rows, count(*) FILTER (meets_threshold) AS meeting,
  count(*) FILTER (total_basket_cost IS NULL) AS incomplete, min(month_date) AS first_month,
  max(month_date) AS last_month FROM county UNION ALL
SELECT 'again', count(*), count(*) FILTER (meets_threshold),
  count(*) FILTER (total_basket_cost IS NULL), min(month_date), max(month_date)
FROM county WHERE {_TWICE}"""
    ),
)
def agg_counts_while_writing(t):
    """The counts of each run, taken by the job that wrote it; nothing is read for them."""
    table, counts = _published_counties(t)
    rows = [
        (run, c["rows"], c["meeting"], c["incomplete"], c["first_month"], c["last_month"])
        for run, c in counts.items()
    ]
    told = t.spark.createDataFrame(
        rows, "run string, rows long, meeting long, incomplete long, first string, last string"
    )
    return told.select(
        "run", "rows", "meeting", "incomplete", F.to_date("first").alias("first_month"),
        F.to_date("last").alias("last_month"),
    )


def _published_counties(t):
    """The county index as a published table in which one row stands twice."""
    table = PublishedTable(t.spark, fresh_folder(t.spark, "county"), COUNTY_INDEX)
    metrics = reports.county_metrics()
    table.append(county_index(t, COUNTY), "all", metrics)
    stored = table.read()
    best = stored.filter("meets_threshold").select(
        F.struct(F.col("county_fips"), -F.unix_date("month_date")).alias("k")
    )
    first = best.agg(F.min("k").alias("k")).select("k.*").toDF("county_fips", "at")
    again = stored.join(F.broadcast(first), "county_fips").filter(
        F.unix_date("month_date") == -F.col("at")
    )
    table.append(again.drop("at"), "again", metrics)
    return table, table.runs()


PRICES = ("lodging_cost", "breakfast_lunch_cost", "dinner_cost", "attraction_cost", "retail_cost",
          "total_basket_cost")


@query(
    "agg_validation_report",
    sql.county(
        f"""SELECT count(*) AS rows_processed,
  count(*) FILTER (meets_threshold) AS rows_meeting_threshold,
  {", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in PRICES)},
  CAST(sum(restaurant_txn_removed + attraction_txn_removed + retail_txn_removed) AS BIGINT)
    AS txn_removed,
  round(min(total_basket_cost), 6) AS min_basket, round(max(total_basket_cost), 6) AS max_basket,
  round(quantile_cont(total_basket_cost, 0.25), 6) AS p25_basket,
  round(quantile_cont(total_basket_cost, 0.5), 6) AS p50_basket,
  round(quantile_cont(total_basket_cost, 0.75), 6) AS p75_basket FROM county""",
        EVERY_MONTH,
        COUNTY_CATEGORIES,
    ),
)
def agg_validation_report(t):
    report = reports.validation_report(county_index(t, EVERY_MONTH))
    return report.withColumns(
        {c: F.round(c, 6) for c in report.columns if c.endswith("_basket")}
    )


@query(
    "agg_admin_counts",
    sql.on_spend(
        """SELECT admin1_id, admin1, admin1_abbr, admin2_id, admin2, country,
  count(*) AS record_count FROM geo GROUP BY ALL"""
    ),
)
def agg_admin_counts(t):
    return reports.admin_counts(t.geo_reference)


@query(
    "agg_sample_sizes",
    sql.on_spend(
        f"""WITH base AS ({sql.rows(CATEGORIES, "state", WHOLE)}),
per AS (SELECT merch_state, category, count(*) AS n, count(DISTINCT membccid) AS visitors,
    count(DISTINCT membccid || '_' || CAST(trans_date AS VARCHAR)) AS days
  FROM base GROUP BY ALL)
SELECT merch_state AS state,
  coalesce(max(n) FILTER (category = 'restaurant'), 0) AS restaurant_transactions,
  coalesce(max(n) FILTER (category = 'accommodation'), 0) AS accommodation_stays,
  coalesce(max(n) FILTER (category = 'attraction'), 0) AS attraction_transactions,
  coalesce(max(days) FILTER (category = 'retail'), 0) AS retail_shopping_days,
  max(visitors) AS max_unique_visitors
FROM per GROUP BY merch_state"""
    ),
)
def agg_sample_sizes(t):
    return reports.sample_sizes(t, WHOLE)


def _card_days(key: str, config):
    @query(
        key,
        sql.on_spend(
            f"""WITH days AS (SELECT merch_state, membccid, trans_date,
    sum(CAST(trans_amount AS DECIMAL(24, 6))) AS spent
  FROM ({sql.rows([RETAIL], "state", config)}) GROUP BY ALL)
SELECT merch_state, CAST(quantile_disc(spent, 0.5) AS DOUBLE) AS retail_cost,
  count(*) AS aggregated_day_count, count(DISTINCT membccid) AS unique_visitors
FROM days GROUP BY merch_state"""
        ),
    )
    def build(t):
        return cap_test.card_day_median(t, config)


_card_days("agg_cardday_median", WHOLE)
_card_days("agg_cardday_median_every_snapshot", EVERY_SNAPSHOT)


ONE_PASS = ("accommodation_cost", "attraction_cost", "breakfast_lunch_cost", "dinner_cost",
            "median_meal_cost", "retail_cost")


def _one_pass_column(name: str) -> str:
    for category in CATEGORIES:
        for price, share in category.prices:
            if price == name:
                return (
                    f"CASE WHEN category = '{category.name}' THEN "
                    f"quantile_disc(trans_amount, {share}) END AS {name}"
                )
    raise KeyError(name)


@query(
    "agg_all_categories",
    sql.on_spend(
        f"""{_all_categories_ctes()}
SELECT category, {STATE_KEYS}, {", ".join(_one_pass_column(name) for name in ONE_PASS)},
  count(*) AS transaction_count, count(DISTINCT membccid) AS unique_visitors,
  any_value(n_before) AS n_before,
  {sql.flag("count(DISTINCT membccid)", WHOLE)} AS data_quality_flag
FROM kept GROUP BY category, {STATE_KEYS}"""
    ),
)
def agg_all_categories(t):
    return category_costs(t, CATEGORIES, STATE, WHOLE)
