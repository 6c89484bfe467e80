"""The daily-cap experiment: capped retail prices per state over a whole period, its summaries,
and how sensitive prices are to the cap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.config import RETAIL, RETAIL_NO_MINIMUM, Category, IndexConfig
from triptally.functions.scalars import (
    percent_change,
    percent_of,
    price_bucket,
    price_bucket_order,
)
from triptally.operators import capping
from triptally.operators.distribution import (
    AMOUNT,
    CARD,
    bands,
    count_purchases,
    price_list,
    price_points,
    prices_and_kept,
    staged,
    visitors,
)
from triptally.operators.filters import present
from triptally.operators.joins import SNAPSHOTS, STATE, purchases_in
from triptally.plans.category import MONTH, visitor_rows
from triptally.sources.tables import SpendTables

MEDIAN = {"median": 0.5}


def _present(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.filter(present([*keys, AMOUNT]))


def retail_cap_test(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL_NO_MINIMUM
) -> DataFrame:
    """Capped median per state over the whole period, with the effects of cap and trimming.

    The published test matches every snapshot of a merchant; pass snapshot_join=False for that.
    """
    keys = ["state_abbr"]
    rows = visitor_rows(tables, [category], STATE, config).withColumnRenamed(
        "merch_state", "state_abbr"
    )
    daily = capping.count_daily_purchases(rows, keys)
    ranked = staged(capping.rank_purchases(daily, keys), "ranked", config)
    purchases = _present(capping.keep_dearest(ranked, config.daily_cap), keys)
    prices, trimmed = prices_and_kept(purchases, keys, MEDIAN, config)
    # Cards and card-days in one go: first per card-day, then per card.
    days = trimmed.groupBy(*keys, CARD, capping.DAY).agg(F.sum("n").alias("n"))
    cards = days.groupBy(*keys, CARD).agg(F.sum("n").alias("n"), F.count("*").alias("days"))
    counts = cards.groupBy(*keys).agg(
        F.sum("n").alias("txn_count_after_filtering"),
        F.count(CARD).alias("unique_cardholders"),
        F.coalesce(F.sum(F.when(F.col(CARD).isNotNull(), F.col("days"))), F.lit(0)).alias(
            "unique_cardholder_days"
        ),
    )
    impact = capping.capping_impact_over_period(ranked, keys, config.daily_cap)
    removed = F.col("n_before") - F.col("txn_count_after_filtering")
    impact_columns = [
        "txn_before_cap", "txn_after_cap", "txn_capped", "pct_txn_capped",
        "cardholders_affected_by_cap", "pct_cardholders_affected", "cardholder_days_affected",
    ]
    return (
        prices.join(counts, keys)
        .join(impact, keys, "left")
        .select(
            "state_abbr",
            F.col("state_abbr").alias("state_name"),
            F.col("median").alias("median_retail_txn"),
            (F.col("median") * 2).alias("retail_basket_cost_2day"),
            "txn_count_after_filtering",
            "unique_cardholders",
            "unique_cardholder_days",
            F.col("min_cost").alias("min_txn_amount"),
            F.col("max_cost").alias("max_txn_amount"),
            F.round(F.col("total_amount") / F.col("txn_count_after_filtering"), 2).alias(
                "avg_txn_amount"
            ),
            *impact_columns,
            F.col("n_before").alias("total_txn_before_outlier_removal"),
            removed.alias("txn_removed_as_outliers"),
            percent_of(removed, F.col("n_before")).alias("pct_txn_removed_as_outliers"),
            F.round("low", 2).alias("p5_threshold"),
            F.round("high", 2).alias("p98_threshold"),
            F.lit(config.start).alias("month_start_date"),
            F.lit(config.end).alias("month_end_date"),
            F.lit(config.daily_cap).alias("max_daily_cap"),
            F.current_timestamp().alias("query_run_timestamp"),
        )
        .orderBy("state_abbr")
    )


def summary_of_states(report: DataFrame) -> DataFrame:
    """One row over all states of a cap test."""

    def rounded(aggregate: Column, name: str) -> Column:
        return F.round(aggregate, 2).alias(name)

    def quartile(share: float) -> Column:
        return F.expr(f"percentile_disc({share}) within group (order by median_retail_txn)")

    return report.agg(
        F.count_distinct("state_abbr").alias("total_states"),
        rounded(F.avg("median_retail_txn"), "avg_state_median_retail"),
        rounded(F.min("median_retail_txn"), "min_state_median_retail"),
        rounded(F.max("median_retail_txn"), "max_state_median_retail"),
        rounded(quartile(0.5), "median_of_state_medians"),
        rounded(quartile(0.25), "q1_of_state_medians"),
        rounded(quartile(0.75), "q3_of_state_medians"),
        rounded(F.avg("retail_basket_cost_2day"), "avg_basket_cost"),
        rounded(F.min("retail_basket_cost_2day"), "min_basket_cost"),
        rounded(F.max("retail_basket_cost_2day"), "max_basket_cost"),
        rounded(F.avg("pct_txn_capped"), "avg_pct_txn_capped"),
        rounded(F.avg("pct_cardholders_affected"), "avg_pct_cardholders_affected"),
        F.sum("txn_capped").alias("total_txn_capped_nationwide"),
        F.sum("txn_after_cap").alias("total_txn_retained_nationwide"),
        rounded(F.avg("pct_txn_removed_as_outliers"), "avg_pct_txn_removed_as_outliers"),
        F.sum("txn_removed_as_outliers").alias("total_txn_removed_as_outliers"),
    )


def ranked_states(report: DataFrame, by: str, columns: Sequence[str], n: int = 10,
                  descending: bool = True) -> DataFrame:
    """The n states at one end of a measure; ties in order of state."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return report.orderBy(order, "state_abbr").limit(n).select(*columns)


def price_distribution(report: DataFrame) -> DataFrame:
    """How the states spread over price buckets, cheapest bucket first."""
    return (
        report.groupBy(price_bucket(F.col("median_retail_txn")).alias("median_retail_bucket"))
        .agg(
            F.count("*").alias("num_states"),
            F.round(F.avg("median_retail_txn"), 2).alias("avg_median_in_bucket"),
            F.round(F.avg("pct_txn_capped"), 2).alias("avg_pct_capped_in_bucket"),
        )
        .orderBy(price_bucket_order(F.col("median_retail_bucket")))
    )


def cap_comparison(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL
) -> DataFrame:
    """Medians with and without the cap per state and month, both trimmed to their own band."""
    keys = [STATE.column, MONTH]
    daily = capping.count_daily_purchases(visitor_rows(tables, [category], STATE, config), keys)
    ranked = capping.rank_purchases(daily, [STATE.column])
    # One row per price with both counts; only then both sides in one distribution, told by a key.
    counted = _present(ranked, keys).groupBy(*keys, AMOUNT).agg(
        F.sum("n").alias("uncapped"), F.sum(capping.kept(config.daily_cap)).alias("capped")
    )
    sides = [*keys, "side"]
    either = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(s).alias("n")) for s in ("uncapped", "capped")]
    )
    both_sides = counted.select(*keys, AMOUNT, F.inline(either)).filter(F.col("n") > 0)
    priced = price_points(both_sides, sides, MEDIAN, config)

    def of(side: str, value: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(value)))

    both = priced.groupBy(*keys).agg(
        of("uncapped", "median").alias("median_uncapped"),
        of("capped", "median").alias("median_capped"),
        of("uncapped", "n_band").alias("txn_count_uncapped"),
        of("capped", "n_band").alias("txn_count_capped"),
    )
    compared = both.filter(
        F.col("median_uncapped").isNotNull() & F.col("median_capped").isNotNull()
    ).withColumns(
        {
            "median_difference": F.round(F.col("median_capped") - F.col("median_uncapped"), 2),
            "pct_change": percent_change(F.col("median_capped"), F.col("median_uncapped")),
            "txn_removed_by_cap": F.col("txn_count_uncapped") - F.col("txn_count_capped"),
        }
    )
    return compared.orderBy(F.abs("pct_change").desc(), *keys)


def medians_in_global_band(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL
) -> DataFrame:
    """Median per state and month of the purchases inside one band over everything, the variant
    in which the band comes from an uncorrelated subquery."""
    keys = [STATE.column, MONTH]
    rows = visitor_rows(tables, [category], STATE, config.with_(daily_cap=None))
    counted = rows.groupBy(*keys, AMOUNT).agg(purchases_in(rows).alias("n"))
    purchases = staged(counted, "purchases", config)
    overall = bands(price_list(purchases, []), [], *config.trim, config.method)
    band = overall.select(F.struct("low", "high")).scalar()
    banded = purchases.filter(F.col(AMOUNT).between(band["low"], band["high"]))
    return price_points(banded, keys, MEDIAN, config.with_(trim=None)).select(
        *keys,
        F.col("median").alias("median_uncapped"),
        F.col("n_band").alias("txn_count_uncapped"),
    )


def cap_sensitivity(
    tables: SpendTables, config: IndexConfig, caps: Sequence[int], category: Category = RETAIL
) -> DataFrame:
    """Trimmed median and share of purchases kept per state and cap, from one ranking."""
    keys = [STATE.column, "daily_cap"]
    daily = capping.count_daily_purchases(
        visitor_rows(tables, [category], STATE, config), [STATE.column]
    )
    ranked = capping.rank_purchases(daily, [STATE.column])
    # One row per price with a count for each cap, small; the caps are told apart only then.
    counted = ranked.groupBy(STATE.column, AMOUNT).agg(
        F.sum("n").alias("n_all"), *[F.sum(capping.kept(c)).alias(f"cap_{c}") for c in caps]
    )
    counted = staged(counted, "counted", config)
    per_cap = F.array(
        *[F.struct(F.lit(c).alias("daily_cap"), F.col(f"cap_{c}").alias("n")) for c in caps]
    )
    each = counted.select(STATE.column, AMOUNT, "n_all", F.inline(per_cap))
    purchases = _present(each.filter(F.col("n") > 0), [STATE.column])
    prices = price_points(purchases, keys, MEDIAN, config)
    counts = each.groupBy(*keys).agg(
        F.sum("n_all").alias("txn_before_cap"), F.sum("n").alias("txn_after_cap")
    )
    return (
        prices.join(counts, keys)
        .select(
            *keys,
            F.col("median").alias("retail_cost"),
            "txn_before_cap",
            "txn_after_cap",
            percent_of(F.col("txn_after_cap"), F.col("txn_before_cap")).alias("pct_txn_kept"),
        )
        .orderBy(*keys)
    )


def daily_count_distribution(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL
) -> DataFrame:
    """How many card-days have 1, 2, 3 ... purchases, and whether that exceeds the cap."""
    rows = visitor_rows(tables, [category], STATE, config)
    days = rows.groupBy(CARD, "trans_date").agg(purchases_in(rows).alias("txn_per_day"))
    return (
        days.groupBy("txn_per_day")
        .agg(F.count("*").alias("card_days"), F.count_distinct(CARD).alias("cards"))
        .withColumn("over_cap", F.col("txn_per_day") > config.daily_cap)
        .orderBy("txn_per_day")
    )


def card_day_median(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL
) -> DataFrame:
    """The older retail measure: spending per card and day, and the median of that per state."""
    keys = [STATE.column]
    rows = visitor_rows(tables, [category], STATE, config).filter(present(keys))
    # Sums of decimals do not depend on the order in which tasks add them up.
    amount = F.col(AMOUNT).cast("decimal(24,6)")
    if SNAPSHOTS in rows.columns:  # a purchase is spent once per snapshot
        amount = (amount * F.col(SNAPSHOTS)).cast("decimal(34,6)")
    days = rows.groupBy(*keys, CARD, "trans_date").agg(F.sum(amount).cast("double").alias(AMOUNT))
    spent = count_purchases(days, keys)
    prices = price_points(spent, keys, {"retail_cost": 0.5}, config.with_(trim=None))
    return prices.select(*keys, "retail_cost").join(
        visitors(spent, keys).withColumnRenamed("transaction_count", "aggregated_day_count"), keys
    )


def outlier_report(
    tables: SpendTables, categories: Sequence[Category], config: IndexConfig
) -> DataFrame:
    """Per category, state and month: purchases before and after trimming and the share removed."""
    keys = ["category", STATE.column, MONTH]
    purchases = count_purchases(visitor_rows(tables, categories, STATE, config), keys)
    found = price_points(purchases, keys, {}, config)
    removed = found.select(
        *keys,
        F.col("n_before").alias("txn_before"),
        F.col("n_band").alias("txn_after"),
        (F.col("n_before") - F.col("n_band")).alias("txn_removed"),
    )
    share = percent_of(F.col("txn_removed"), F.col("txn_before"))
    return removed.withColumn("pct_removed", share)
