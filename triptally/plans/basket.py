"""The weighted basket per state and month, and its quality-aware variants."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triptally.config import (
    CATEGORIES,
    COUPLE_WEEKEND,
    EXCLUDE,
    ROLLING,
    SINGLE,
    BasketWeights,
    IndexConfig,
)
from triptally.functions.scalars import basket_cost
from triptally.operators import filters
from triptally.operators.distribution import staged
from triptally.operators.joins import STATE, Level
from triptally.plans.category import category_costs, category_prices
from triptally.sources.tables import SpendTables

KEYS = ["merch_state", "month_date"]
COMPONENTS = (
    "accommodation_cost", "attraction_cost", "breakfast_lunch_cost", "dinner_cost",
    "median_meal_cost", "retail_cost",
)


def _index(
    components: DataFrame, weights: BasketWeights, drop_unknown: bool, level: Level = STATE
) -> DataFrame:
    priced = components.select(
        "month_date", level.column, *COMPONENTS, basket_cost(weights).alias("cost_per_trip")
    )
    kept = priced.filter(filters.known_state()) if drop_unknown and level == STATE else priced
    return kept.orderBy(level.column, "month_date")


def basket_index(
    tables: SpendTables,
    config: IndexConfig,
    weights: BasketWeights = COUPLE_WEEKEND,
    drop_unknown: bool = True,
    level: Level = STATE,
) -> DataFrame:
    """All components from one pass over the transactions, then one row per geography of the level
    and month.

    A month without accommodation has no row, and retail counts only beside restaurants: the outcome
    of left joins from accommodation and from restaurants.
    """
    costs = category_prices(tables, CATEGORIES, level, config)
    wide = costs.groupBy(level.column, "month_date").agg(*[F.max(name).alias(name) for name in COMPONENTS])
    anchored = wide.filter(F.col("accommodation_cost").isNotNull()).withColumn(
        "retail_cost", F.when(F.col("median_meal_cost").isNotNull(), F.col("retail_cost"))
    )
    return _index(anchored, weights, drop_unknown, level)


def latest_exports(exports: DataFrame) -> DataFrame:
    """One row per state and month where exports overlap: the one calculated last."""
    newest = Window.partitionBy(*KEYS).orderBy(
        F.col("calculation_timestamp").desc_nulls_last(), F.col("export_file").desc()
    )
    return (
        exports.withColumn("version", F.row_number().over(newest))
        .filter(F.col("version") == 1)
        .drop("version", "export_file")
    )


def join_components(
    accommodation: DataFrame, attraction: DataFrame, restaurant: DataFrame, retail: DataFrame
) -> DataFrame:
    """The four category results side by side, anchored on accommodation."""
    lodging = accommodation.select(*KEYS, "accommodation_cost")
    sights = attraction.select(*KEYS, "attraction_cost")
    meals = restaurant.select(*KEYS, "breakfast_lunch_cost", "dinner_cost", "median_meal_cost")
    shops = retail.select(*KEYS, "retail_cost")
    return lodging.join(sights, KEYS, "left").join(meals.join(shops, KEYS, "left"), KEYS, "left")


def basket_from_frames(
    accommodation: DataFrame,
    attraction: DataFrame,
    restaurant: DataFrame,
    retail: DataFrame,
    weights: BasketWeights = COUPLE_WEEKEND,
    drop_unknown: bool = True,
) -> DataFrame:
    """The index from category results, for example from exported files."""
    joined = join_components(accommodation, attraction, restaurant, retail)
    return _index(joined, weights, drop_unknown)


def basket_from_exports(
    exports: Mapping[str, DataFrame], weights: BasketWeights = COUPLE_WEEKEND, drop_unknown: bool = True
) -> DataFrame:
    """The index from exported files, by category name; where exports overlap, the row calculated last
    counts."""
    latest = {name: latest_exports(rows) for name, rows in exports.items()}
    return basket_from_frames(
        latest["accommodation"], latest["attraction"], latest["restaurant"], latest["retail"],
        weights, drop_unknown,
    )


def quality_basket(
    tables: SpendTables,
    config: IndexConfig,
    weights: BasketWeights = COUPLE_WEEKEND,
    drop_unknown: bool = True,
    level: Level = STATE,
) -> DataFrame:
    """The basket with what its prices rest on, from one pass.

    Every price follows its category's flag: the month's own price, the three-month average, or none.
    Beside them stand each category's flag (EXCLUDE where it has no purchases) and visitors, how many
    categories fell back (`n_rolling`) or are left out (`n_excluded`), and the lowest flag of all.
    A basket with a category left out has no total.
    """
    costs = staged(category_costs(tables, CATEGORIES, level, config), "costs", config)
    for name in COMPONENTS:
        costs = rolling_fallback(costs, name, level.column, ("category",)).withColumn(
            name, F.col("usable_cost")
        )
    flag = F.col("data_quality_flag")

    def of(category: str, value: str):
        return F.max(F.when(F.col("category") == category, F.col(value)))

    names = [category.name for category in CATEGORIES]
    wide = costs.groupBy(level.column, "month_date").agg(
        *[F.max(name).alias(name) for name in COMPONENTS],
        *[F.coalesce(of(c, "data_quality_flag"), F.lit(EXCLUDE)).alias(f"{c}_flag") for c in names],
        *[F.coalesce(of(c, "unique_visitors"), F.lit(0)).alias(f"{c}_visitors") for c in names],
        F.count_if(flag == ROLLING).alias("n_rolling"),
        (F.lit(len(names)) - F.count_if(flag != EXCLUDE)).alias("n_excluded"),
    )
    quality = (
        F.when(F.col("n_excluded") > 0, EXCLUDE).when(F.col("n_rolling") > 0, ROLLING).otherwise(SINGLE)
    )
    priced = wide.withColumns({"basket_flag": quality, "cost_per_trip": basket_cost(weights)})
    kept = priced.filter(filters.known_state()) if drop_unknown and level == STATE else priced
    return kept.orderBy(level.column, "month_date")


def component_costs(index: DataFrame, weights: BasketWeights = COUPLE_WEEKEND) -> DataFrame:
    """What each component contributes to the trip: price times quantity."""
    return index.select(
        "month_date",
        "merch_state",
        (F.col("accommodation_cost") * weights.accommodation).alias("accommodation_total"),
        (F.col("attraction_cost") * weights.attraction).alias("attraction_total"),
        (F.col("breakfast_lunch_cost") * weights.breakfast_lunch).alias("breakfast_lunch_total"),
        (F.col("dinner_cost") * weights.dinner).alias("dinner_total"),
        (F.col("retail_cost") * weights.retail).alias("retail_total"),
    )


def rolling_fallback(
    result: DataFrame, cost: str, geography: str = "merch_state", group: tuple[str, ...] = ()
) -> DataFrame:
    """The price to use by quality flag: own month, three-month average, or none.

    The average runs over the month and the two calendar months before it and leaves out months
    flagged EXCLUDE; missing months are not replaced by older ones.
    """
    calendar = F.year("month_date") * 12 + F.month("month_date")
    recent = Window.partitionBy(*group, geography).orderBy(calendar).rangeBetween(-2, 0)
    usable = F.when(F.col("data_quality_flag") != EXCLUDE, F.col(cost))
    return result.withColumn("rolling_cost", F.avg(usable).over(recent)).withColumn(
        "usable_cost",
        F.when(F.col("data_quality_flag") == EXCLUDE, None)
        .when(F.col("data_quality_flag") == ROLLING, F.col("rolling_cost"))
        .otherwise(F.col(cost)),
    )
