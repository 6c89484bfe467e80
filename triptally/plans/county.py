"""The county index: trimmed and capped card prices plus weekend lodging rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.config import ATTRACTION, RESTAURANT, RETAIL_NO_MINIMUM, CountyConfig
from triptally.functions.scalars import month_start, months_between, normalize_dc_county
from triptally.operators import capping, filters, joins
from triptally.operators.distribution import AMOUNT, price_points, prices_and_kept, staged
from triptally.operators.joins import COUNTY
from triptally.plans.category import MONTH, visitor_rows
from triptally.sources.tables import SpendTables

KEYS = [COUNTY.column, MONTH]
CATEGORIES = (RESTAURANT, ATTRACTION, RETAIL_NO_MINIMUM)
COUNTS = (
    "lodging_txn_count", "restaurant_txn_count", "attraction_txn_count", "retail_txn_count",
    "lodging_txn_removed", "restaurant_txn_removed", "attraction_txn_removed",
    "retail_txn_removed", "hotel_property_count",
)


def weekend_lodging(tables: SpendTables, config: CountyConfig) -> DataFrame:
    """Friday and Saturday nights of the period, with DC under its county code."""
    nights = tables.lodging.filter(
        filters.in_period(config.index.start, config.index.end, "stay_date")
        & filters.weekend_night()
        & (F.col("country") == config.country)
    )
    return nights.withColumn(
        COUNTY.column, normalize_dc_county(F.col(COUNTY.column), F.col("state_abbr"))
    ).withColumn(MONTH, month_start(F.col("stay_date")))


def lodging_rates(tables: SpendTables, config: CountyConfig, by_occupancy: bool = False) -> DataFrame:
    """Mean weekend rate per county and month, times the nights; optionally weighted by occupancy."""
    nights = weekend_lodging(tables, config).filter(F.col(COUNTY.column).isNotNull())
    # One row per property first: rates, counts and properties then come from one pass, and sums of
    # decimals do not depend on the order in which tasks add them up.
    rate, nightly = F.col("adr"), F.col("adr").isNotNull()
    weight = F.col("occupancy") if by_occupancy else F.lit(1.0)
    per_property = nights.groupBy(*KEYS, "property_id").agg(
        F.sum((rate * weight).cast("decimal(28,6)")).alias("charged"),
        F.sum((weight if by_occupancy else F.when(nightly, weight)).cast("decimal(28,6)")).alias("weight"),
        F.count("adr").alias("lodging_txn_count"),
    )
    rates = per_property.groupBy(*KEYS).agg(
        F.try_divide(
            F.sum("charged").cast("double"), F.sum("weight").cast("double")
        ).alias("avg_adr"),
        F.sum("lodging_txn_count").alias("lodging_txn_count"),
        F.count("property_id").alias("hotel_property_count"),
    )
    return rates.withColumn("lodging_cost", F.col("avg_adr") * config.weights.accommodation)


def card_prices(tables: SpendTables, config: CountyConfig) -> DataFrame:
    """Restaurant, attraction and retail prices per county and month from one pass.

    Trimmed per county and category first; the daily cap then applies to what is left of retail.
    """
    index = config.index
    groups = ["category", *KEYS]
    rows = visitor_rows(tables, CATEGORIES, COUNTY, index, us_only=False)
    daily = capping.count_daily_purchases(rows.filter(filters.present([*groups, AMOUNT])), groups)
    bands, bought = prices_and_kept(staged(daily, "purchases", index), groups, {}, index)
    if index.daily_cap is not None:
        retail = F.col("category") == RETAIL_NO_MINIMUM.name
        ranked = capping.rank_purchases(bought.filter(retail), [COUNTY.column], ["category"])
        capped = capping.keep_dearest(ranked, index.daily_cap)
        bought = bought.filter(~retail).unionByName(capped)
    shares = {"p35": 0.35, "p50": 0.5, "p65": 0.65}
    prices = price_points(bought, groups, shares, index.with_(trim=None))
    removed = F.col("n_before") - F.col("n_band")
    counted = prices.select(*groups, *shares, F.col("n_band").alias("n")).join(
        bands.select(*groups, removed.alias("n_removed")), groups
    )
    weights = config.weights

    def of(category: str, value: Column) -> Column:
        return F.max(F.when(F.col("category") == category, value))

    columns = [
        of("restaurant", F.col("p35") * weights.breakfast_lunch).alias("breakfast_lunch_cost"),
        of("restaurant", F.col("p65") * weights.dinner).alias("dinner_cost"),
        of("attraction", F.col("p50") * weights.attraction).alias("attraction_cost"),
        of("retail", F.col("p50") * weights.retail).alias("retail_cost"),
    ]
    for name in ("restaurant", "attraction", "retail"):
        columns.append(of(name, F.col("n")).alias(f"{name}_txn_count"))
        columns.append(of(name, F.col("n_removed")).alias(f"{name}_txn_removed"))
    return counted.groupBy(*KEYS).agg(*columns)


def county_months(
    tables: SpendTables, config: CountyConfig, found: DataFrame | None = None
) -> DataFrame:
    """Every county in every month of the period, whether or not it has data. With `found`, the
    months are those from the first to the last month of its rows."""
    known = joins.counties(tables.geo_reference, config.country).select(COUNTY.column).distinct()
    if found is None:
        return known.withColumn(MONTH, F.explode(months_between(config.index.start, config.index.end)))
    span = found.agg(F.min(MONTH).alias("a"), F.max(MONTH).alias("b")).select(
        F.when(F.col("a").isNotNull(), F.sequence("a", "b", F.expr("interval 1 month")))
    )
    return known.withColumn(MONTH, F.explode(span.scalar()))


def meets_threshold(config: CountyConfig) -> Column:
    return (
        (F.col("hotel_property_count") >= config.min_properties)
        & (F.col("restaurant_txn_count") >= config.min_restaurant)
        & (F.col("attraction_txn_count") >= config.min_attraction)
        & (F.col("retail_txn_count") >= config.min_retail)
        & (F.col("lodging_txn_count") >= config.min_lodging)
        & F.col("total_basket_cost").isNotNull()
    )


def anchored_sides(
    tables: SpendTables, config: CountyConfig
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Card prices, lodging rates, and the counties and months that both are joined to."""
    cards, rates = card_prices(tables, config), lodging_rates(tables, config)
    if config.every_month:
        return cards, rates, county_months(tables, config)
    cards, rates = staged(cards, "cards", config.index), staged(rates, "rates", config.index)
    return cards, rates, county_months(tables, config, cards.select(MONTH).unionByName(rates.select(MONTH)))


def county_index(tables: SpendTables, config: CountyConfig) -> DataFrame:
    """One output row per county and month; missing prices stay missing, missing counts are 0."""
    cards, rates, months = anchored_sides(tables, config)
    joined = (
        months.join(cards, KEYS, "left")
        .join(rates, KEYS, "left")
        .withColumn("lodging_txn_removed", F.lit(0).cast("long"))
    )
    total = (
        F.col("breakfast_lunch_cost")
        + F.col("dinner_cost")
        + F.col("attraction_cost")
        + F.col("retail_cost")
        + F.col("lodging_cost")
    )
    filled = joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(0)).cast("long") for name in COUNTS}
    ).withColumn("total_basket_cost", total)
    return filled.select(
        *KEYS,
        "lodging_cost",
        "breakfast_lunch_cost",
        "dinner_cost",
        "attraction_cost",
        "retail_cost",
        "total_basket_cost",
        *COUNTS,
        meets_threshold(config).alias("meets_threshold"),
        F.current_timestamp().alias("created_at"),
    )
