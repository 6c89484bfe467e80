"""Rankings, changes over time and comparisons of index results.

Windows run per month or per geography, so they hold at most all geographies of a month or all
months of a geography.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptally.config import CATEGORIES, COUPLE_WEEKEND, BasketWeights, IndexConfig
from triptally.functions.scalars import basket_cost
from triptally.operators.filters import latest_month
from triptally.plans.basket import COMPONENTS
from triptally.plans.category import level_prices
from triptally.sources.tables import SpendTables
from triptally.sources.writers import keep


def _calendar(month: str = "month_date") -> Column:
    return F.year(month) * 12 + F.month(month)


def state_ranking(index: DataFrame, cost: str = "cost_per_trip") -> DataFrame:
    """Rank of each state within its month, dearest first."""
    dearest = Window.partitionBy("month_date").orderBy(F.col(cost).desc())
    priced = index.filter(F.col(cost).isNotNull())
    return priced.select("month_date", "merch_state", cost, F.rank().over(dearest).alias("rank"))


def month_and_year_change(
    index: DataFrame, cost: str = "cost_per_trip", geography: str = "merch_state"
) -> DataFrame:
    """Change against the previous month and the same month a year ago; null where that is
    missing, whatever months surround it."""
    history = Window.partitionBy(geography).orderBy(_calendar())

    def before(months: int) -> Column:
        return F.max(cost).over(history.rangeBetween(-months, -months))

    return index.select(
        "month_date",
        geography,
        cost,
        before(1).alias("previous_month"),
        before(12).alias("previous_year"),
    ).withColumns(
        {
            "mom_change": F.col(cost) - F.col("previous_month"),
            "yoy_change": F.col(cost) - F.col("previous_year"),
            "mom_pct": F.try_divide(F.col(cost) - F.col("previous_month"), F.col("previous_month"))
            * 100,
            "yoy_pct": F.try_divide(F.col(cost) - F.col("previous_year"), F.col("previous_year"))
            * 100,
        }
    )


def baseline_index(
    index: DataFrame,
    base_month: date,
    cost: str = "cost_per_trip",
    geography: str = "merch_state",
) -> DataFrame:
    """Index value with the base month at 100."""
    base = F.max(F.when(F.col("month_date") == F.lit(base_month), F.col(cost)))
    return index.withColumn("base_cost", base.over(Window.partitionBy(geography))).select(
        "month_date",
        geography,
        cost,
        "base_cost",
        (F.try_divide(F.col(cost), F.col("base_cost")) * 100).alias("index_value"),
    )


def volume_trend(
    result: DataFrame, count: str = "transaction_count", geography: str = "merch_state"
) -> DataFrame:
    """Change of a sample size against the previous month present."""
    history = Window.partitionBy(geography).orderBy("month_date")
    return result.select(
        geography, "month_date", count, F.lag(count).over(history).alias("previous_count")
    ).withColumn("count_change", F.col(count) - F.col("previous_count"))


def cost_extremes(index: DataFrame, n: int = 10, cost: str = "cost_per_trip") -> DataFrame:
    """The n dearest and n cheapest states of the latest month with whole baskets. Reads `index` more than once:
    pass a written table."""
    latest = latest_month(index.filter(F.col(cost).isNotNull()))
    top = latest.orderBy(F.col(cost).desc(), "merch_state").limit(n)
    bottom = latest.orderBy(F.col(cost), "merch_state").limit(n)
    columns = ["month_date", "merch_state", cost]
    return top.select(F.lit("most expensive").alias("side"), *columns).unionByName(
        bottom.select(F.lit("least expensive").alias("side"), *columns)
    )


def geo_comparison(
    tables: SpendTables, config: IndexConfig, weights: BasketWeights = COUPLE_WEEKEND
) -> DataFrame:
    """Each state's basket beside those of its division and of the nation."""
    costs = level_prices(tables, CATEGORIES, config)
    wide = costs.groupBy("level", "geography", "month_date").agg(
        *[F.max(name).alias(name) for name in COMPONENTS]
    )
    baskets = keep(
        wide.select("level", "geography", "month_date", basket_cost(weights).alias("cost")),
        "level-baskets",
    )

    def at(level: str, cost: str) -> DataFrame:
        return baskets.filter(F.col("level") == level).select(
            F.col("geography").alias(level), "month_date", F.col("cost").alias(cost)
        )

    home = tables.bridge.select(
        F.col("abbreviation").alias("state"), F.col("census_region_division").alias("division")
    )
    return (
        at("state", "state_cost")
        .join(home, "state")
        .join(at("division", "division_cost"), ["division", "month_date"], "left")
        .join(at("national", "national_cost").drop("national"), "month_date", "left")
        .select(
            "month_date",
            "state",
            "division",
            "state_cost",
            "division_cost",
            "national_cost",
            F.try_divide("state_cost", "division_cost").alias("ratio_to_division"),
            F.try_divide("state_cost", "national_cost").alias("ratio_to_national"),
        )
    )
