"""Monthly price of one or several spending categories at a geography level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.config import Category, IndexConfig
from triptally.functions.scalars import (
    above_minimum,
    category_of,
    month_start,
    percent_of,
    quality_flag,
)
from triptally.operators import capping, filters, joins
from triptally.operators.distribution import (
    AMOUNT,
    CARD,
    count_purchases,
    price_points,
    prices_and_kept,
    single_purchases,
    staged,
    visitors,
)
from triptally.operators.joins import Level
from triptally.sources.tables import SpendTables
from triptally.sources.writers import keep

MONTH = "month_date"
SPREAD = {"q25": 0.25, "q75": 0.75}


def _snapshots(config: IndexConfig) -> Column:
    if config.ref_dates is None:
        return F.lit(True)
    return filters.in_period(*config.ref_dates, "ref_date")


def visitor_transactions(
    tables: SpendTables, config: IndexConfig, categories: Sequence[Category] = ()
) -> DataFrame:
    """Transactions of visitors in the period, only the columns the index needs. A minimum that
    holds for all categories applies here already, where the scan can use it."""
    keep = filters.in_period(config.start, config.end) & filters.from_visitors(config.distance)
    minimums = [category.min_amount for category in categories]
    if minimums and None not in minimums:
        keep = keep & (F.col(AMOUNT) >= min(minimums))
    return tables.transactions.filter(keep & _snapshots(config)).select(
        "mtid", "ref_date", CARD, "trans_date", AMOUNT
    )


def category_merchants(
    tables: SpendTables,
    categories: Sequence[Category],
    config: IndexConfig,
    us_only: bool = True,
) -> DataFrame:
    """Physical merchants of the categories, labelled with their category."""
    keep = filters.physical() & filters.in_categories(categories) & _snapshots(config)
    if us_only:
        keep = keep & filters.in_us()
    return tables.merchants.filter(keep).withColumn("category", category_of("mcc", categories))


def visitor_rows(
    tables: SpendTables,
    categories: Sequence[Category],
    level: Level,
    config: IndexConfig,
    us_only: bool = True,
) -> DataFrame:
    """The base set: one row per visitor purchase with category, geography, month, day, card
    and amount. Merchants get their geography before they meet the transactions."""
    merchants = category_merchants(tables, categories, config, us_only)
    placed = joins.at_level(merchants, level, tables.bridge, tables.geo_reference)
    return _purchase_rows(tables, placed, categories, config, level.column)


def _purchase_rows(
    tables: SpendTables, merchants: DataFrame, categories: Sequence[Category],
    config: IndexConfig, place: str,
) -> DataFrame:
    joined = joins.with_merchants(
        visitor_transactions(tables, config, categories),
        merchants.select("mtid", "ref_date", "category", place),
        config.snapshot_join,
    )
    weight = [] if config.snapshot_join else [joins.SNAPSHOTS]
    return joined.filter(above_minimum(F.col(AMOUNT), F.col("category"), categories)).select(
        "category", place, month_start(F.col("trans_date")).alias(MONTH), "trans_date", CARD, AMOUNT,
        *weight,
    )


def prices_at_all_levels(
    tables: SpendTables, categories: Sequence[Category], config: IndexConfig
) -> DataFrame:
    """Purchases `n` per level, geography, category, month and amount, from one pass. Purchases are
    counted per state and price first; only these counts are told apart by level."""
    merchants = joins.with_all_places(
        category_merchants(tables, categories, config), tables.bridge
    )
    rows = _purchase_rows(tables, merchants, categories, config, "places")
    counted = rows.groupBy("category", "places", MONTH, AMOUNT).agg(
        joins.purchases_in(rows).alias("n")
    )
    return counted.select("*", F.inline("places")).drop("places")


def shares_of(categories: Sequence[Category]) -> dict[str, float]:
    """Percentiles to take, one column per distinct share."""
    shares = {}
    for category in categories:
        wanted = [share for _, share in category.prices]
        wanted += SPREAD.values() if category.spread else []
        for share in wanted:
            shares[_share_column(share)] = share
    return shares


def _share_column(share: float) -> str:
    return f"share_{round(share * 10_000)}"


def _price_columns(category: Category) -> list[Column]:
    return [F.col(_share_column(share)).alias(name) for name, share in category.prices]


def _spread_columns(category: Category) -> list[Column]:
    if not category.spread:
        return []
    quartiles = [F.col(_share_column(share)).alias(name) for name, share in SPREAD.items()]
    return [F.col("min_cost"), F.col("max_cost"), *quartiles]


def run_metadata(config: IndexConfig) -> list[Column]:
    cap = [F.lit(config.daily_cap).alias("max_daily_cap")] if config.daily_cap else []
    return [
        F.lit(config.start).alias("period_start"),
        F.lit(config.end).alias("period_end"),
        *cap,
        F.current_timestamp().alias("calculation_timestamp"),
    ]


def _sample(config: IndexConfig, transactions: str) -> Column:
    return F.col("unique_visitors" if config.flag_basis == "visitors" else transactions)


def purchases_of(
    rows: DataFrame, keys: Sequence[str], place: str, config: IndexConfig,
    within: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """Weighted purchases after the cap, and those ranked for it when there is a cap."""
    known = filters.present([*keys, AMOUNT])
    if config.daily_cap is None:
        weight = [joins.SNAPSHOTS] if joins.SNAPSHOTS in rows.columns else []
        return single_purchases(rows.filter(known).select(*keys, CARD, AMOUNT, *weight)), None
    daily = capping.count_daily_purchases(rows, keys)
    ranked = staged(capping.rank_purchases(daily, [place], within), "ranked", config)
    return capping.keep_dearest(ranked, config.daily_cap).filter(known), ranked


def _sketched(config: IndexConfig) -> bool:
    return config.method == "approx"


def _points(
    purchases: DataFrame, keys: Sequence[str], categories: Sequence[Category], config: IndexConfig
) -> DataFrame:
    return price_points(purchases, keys, shares_of(categories), config)


def _priced(
    rows: DataFrame, keys: list[str], place: str, categories: Sequence[Category],
    config: IndexConfig, within: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame | None]:
    """Price points joined with visitor counts, plus the purchases ranked for the cap."""
    purchases, ranked = purchases_of(rows, keys, place, config, within)
    if ranked is None and config.stage:
        purchases = staged(purchases, "purchases", config)
    elif ranked is None and not _sketched(config):
        # One lazy plan: prices and visitor counts share the shuffle of these counts.
        purchases = purchases.groupBy(*keys, CARD, AMOUNT).agg(F.sum("n").alias("n"))
    return _points_and_visitors(purchases, keys, place, categories, config), ranked


def _points_and_visitors(
    purchases: DataFrame, keys: list[str], place: str, categories: Sequence[Category],
    config: IndexConfig,
) -> DataFrame:
    # The nation has one band per category and month of the period; other levels are measured.
    months = 12 * (config.end.year - config.start.year + 1)
    few = place == joins.NATIONAL.column and months * len(categories) <= config.broadcast_rows
    prices, kept = prices_and_kept(purchases, keys, shares_of(categories), config, few)
    return prices.join(visitors(kept, keys), keys)


def category_cost(
    tables: SpendTables, category: Category, level: Level, config: IndexConfig
) -> DataFrame:
    """One row per geography and month: prices, sample sizes, quality flag and, with a daily cap,
    what the cap and the trimming removed."""
    keys = [level.column, MONTH]
    rows = visitor_rows(tables, [category], level, config).drop("category")
    priced, ranked = _priced(rows, keys, level.column, [category], config)
    if ranked is None:
        result = priced.select(
            *keys,
            *_price_columns(category),
            "transaction_count",
            "unique_visitors",
            *_spread_columns(category),
            quality_flag(_sample(config, "transaction_count"), config).alias("data_quality_flag"),
            *run_metadata(config),
        )
        return result.orderBy(*_order(level, "transaction_count"))
    impact = capping.capping_impact(ranked, keys, config.daily_cap, category.regulars)
    impact_columns = [column for column in impact.columns if column not in keys]
    removed = F.col("txn_after_cap") - F.col("transaction_count")
    result = priced.join(impact, keys, "left").select(
        *keys,
        *_price_columns(category),
        F.col("transaction_count").alias("transaction_count_final"),
        "unique_visitors",
        *impact_columns,
        F.col("txn_after_cap").alias("txn_before_outlier_removal"),
        removed.alias("txn_removed_as_outliers"),
        percent_of(removed, F.col("txn_after_cap")).alias("pct_txn_removed_as_outliers"),
        *_spread_columns(category),
        quality_flag(_sample(config, "transaction_count"), config).alias("data_quality_flag"),
        *run_metadata(config),
    )
    return result.orderBy(*_order(level, "transaction_count_final"))


def _order(level: Level, count: str) -> list[Column]:
    if level in (joins.DIVISION, joins.NATIONAL) and count == "transaction_count":
        return [F.col(MONTH), F.col(level.column)]
    return [F.col(MONTH), F.col(count).desc(), F.col(level.column)]


def prices_by_category(categories: Sequence[Category]) -> list[Column]:
    """Each category's price columns, null in rows of the others."""
    return [
        F.when(F.col("category") == category.name, F.col(_share_column(share))).alias(name)
        for category in categories
        for name, share in category.prices
    ]


def category_prices(
    tables: SpendTables, categories: Sequence[Category], level: Level, config: IndexConfig
) -> DataFrame:
    """All categories from one pass over the transactions, one row per category, geography and
    month, prices only. A daily cap applies per category."""
    keys = ["category", level.column, MONTH]
    rows = visitor_rows(tables, categories, level, config)
    purchases, _ = purchases_of(rows, keys, level.column, config, ["category"])
    prices = _points(_counted_once(purchases, keys, config), keys, categories, config)
    return prices.select(*keys, *prices_by_category(categories))


def _counted_once(purchases: DataFrame, keys: Sequence[str], config: IndexConfig) -> DataFrame:
    """Purchases per price, staged: bands and percentiles both go back to them. Sketches do not."""
    if _sketched(config):
        return purchases
    per_price = purchases.groupBy(*keys, AMOUNT).agg(F.sum("n").alias("n"))
    return staged(per_price, "prices", config)


def costs_by_category(
    tables: SpendTables, categories: Sequence[Category], level: Level, config: IndexConfig
) -> dict[str, DataFrame]:
    """The result of each category with its own price columns, all from one pass and one table."""
    costs = keep(category_costs(tables, categories, level, config), "costs")
    counts = [level.column, MONTH, "transaction_count", "unique_visitors", "data_quality_flag"]
    return {
        category.name: costs.filter(F.col("category") == category.name).select(
            *counts[:2], *[name for name, _ in category.prices], *counts[2:]
        )
        for category in categories
    }


def category_costs(
    tables: SpendTables, categories: Sequence[Category], level: Level, config: IndexConfig
) -> DataFrame:
    """The same with sample sizes and quality flag."""
    keys = ["category", level.column, MONTH]
    rows = visitor_rows(tables, categories, level, config)
    priced, _ = _priced(rows, keys, level.column, categories, config, ["category"])
    return _costs(priced, keys, categories, config)


def countable_purchases(
    tables: SpendTables, categories: Sequence[Category], level: Level, config: IndexConfig
) -> DataFrame:
    """What `costs_of_purchases` needs of a delivery: counts per group, card and amount, and per day
    where a cap will rank them. Counts of several deliveries add up."""
    keys = ["category", level.column, MONTH]
    rows = visitor_rows(tables, categories, level, config)
    if config.daily_cap is None:
        return count_purchases(rows, keys)
    return capping.count_daily_purchases(rows, keys)


def costs_of_purchases(
    purchases: DataFrame, categories: Sequence[Category], level: Level, config: IndexConfig
) -> DataFrame:
    """`category_costs` from the counts of one or several deliveries."""
    keys = ["category", level.column, MONTH]
    one = [c for c in purchases.columns if c != "n"]
    merged = purchases.groupBy(*one).agg(F.sum("n").alias("n"))
    if config.daily_cap is not None:
        ranked = capping.rank_purchases(merged, [level.column], ["category"])
        merged = capping.keep_dearest(ranked, config.daily_cap).filter(filters.present([*keys, AMOUNT]))
    merged = staged(merged, "purchases", config)
    priced = _points_and_visitors(merged, keys, level.column, categories, config)
    return _costs(priced, keys, categories, config)


def _costs(
    priced: DataFrame, keys: Sequence[str], categories: Sequence[Category], config: IndexConfig
) -> DataFrame:
    return priced.select(
        *keys,
        *prices_by_category(categories),
        "transaction_count",
        "unique_visitors",
        "n_before",
        quality_flag(_sample(config, "transaction_count"), config).alias("data_quality_flag"),
    )


def level_prices(
    tables: SpendTables, categories: Sequence[Category], config: IndexConfig
) -> DataFrame:
    """Prices of all categories at state, division and national level from one pass. Price lists
    roll up, so those of divisions and the nation are sums of the states'; there is no daily cap here.
    """
    keys = ["level", "geography", "category", MONTH]
    uncapped = config.with_(daily_cap=None)
    purchases = prices_at_all_levels(tables, categories, uncapped)
    purchases = purchases.filter(filters.present([*keys, AMOUNT]))
    prices = price_points(purchases, keys, shares_of(categories), uncapped)
    return prices.select(*keys, *prices_by_category(categories), "n_before", "n_band")
