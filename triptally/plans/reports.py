"""Coverage, quality and distribution reports over results, and row counts along the filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.config import CATEGORIES, RETAIL, Category, IndexConfig
from triptally.operators import filters
from triptally.operators.distribution import CARD, count_purchases, percentile_vector
from triptally.operators.joins import STATE, purchases_in
from triptally.plans.category import visitor_rows
from triptally.sources.tables import SpendTables


def describe(result: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated quartiles and maximum of a result."""
    quartiles = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return result.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        quartiles.alias("quartiles"),
        F.max(column).alias("max"),
    ).select(
        "count",
        "mean",
        "std",
        "min",
        F.col("quartiles")[0].alias("p25"),
        F.col("quartiles")[1].alias("p50"),
        F.col("quartiles")[2].alias("p75"),
        "max",
    )


def _as_rows(frame: DataFrame, label: str, rows: Mapping[str, Sequence[Column]],
             names: Sequence[str]) -> DataFrame:
    """Turns one row of aggregates into one row per label."""
    structs = [
        F.struct(F.lit(key).alias(label), *[v.alias(n) for v, n in zip(values, names, strict=True)])
        for key, values in rows.items()
    ]
    return frame.select(F.inline(F.array(*structs)))


def component_ranges(result: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lowest and highest price per component."""
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)]
    rows = {c: (F.col(f"{c}_min"), F.col(f"{c}_max")) for c in columns}
    return _as_rows(result.agg(*ends), "component", rows, ("lowest", "highest"))


def missing_values(result: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column."""
    names = list(columns or result.columns)
    counted = result.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return _as_rows(counted, "column_name", {c: (F.col(c),) for c in names}, ("missing",))


def coverage(result: DataFrame, geography: str = "merch_state") -> DataFrame:
    return result.agg(
        F.count("*").alias("records"),
        F.min("month_date").alias("first_month"),
        F.max("month_date").alias("last_month"),
        F.count_distinct("month_date").alias("months"),
        F.count_distinct(geography).alias("geographies"),
    )


def month_sets(costs: DataFrame) -> DataFrame:
    """The months each category has results for."""
    return costs.groupBy("category").agg(
        F.sort_array(F.collect_set("month_date")).alias("months")
    )


def county_metrics() -> dict[str, Column]:
    """What the job that writes a county result counts on the way."""
    return {
        "meeting": F.count_if("meets_threshold"),
        "incomplete": F.count_if(F.col("total_basket_cost").isNull()),
        "first_month": F.min("month_date"),
        "last_month": F.max("month_date"),
    }


def write_verification(table: DataFrame, keys: Sequence[str] = ("county_fips", "month_date")) -> DataFrame:
    """Rows, counties, counties meeting the limits and keys present more than once, per month of a
    written table."""
    per_key = table.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("meets_threshold").alias("meeting")
    )
    return per_key.groupBy("month_date").agg(
        F.sum("n").alias("total_records"),
        F.count("*").alias("unique_counties"),
        F.sum("meeting").alias("counties_meeting_threshold"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def validation_report(table: DataFrame) -> DataFrame:
    """The county result at a glance: size, limits met, gaps and the basket's distribution."""
    prices = ("lodging_cost", "breakfast_lunch_cost", "dinner_cost", "attraction_cost", "retail_cost")
    removed = [F.col(f"{name}_txn_removed") for name in ("restaurant", "attraction", "retail")]
    total = "total_basket_cost"
    quartiles = F.percentile(total, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return table.agg(
        F.count("*").alias("rows_processed"),
        F.count_if("meets_threshold").alias("rows_meeting_threshold"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in (*prices, total)],
        F.sum(reduce(lambda a, b: a + b, removed)).alias("txn_removed"),
        F.min(total).alias("min_basket"),
        quartiles.alias("quartiles"),
        F.max(total).alias("max_basket"),
    ).select(
        "*",
        F.col("quartiles")[0].alias("p25_basket"),
        F.col("quartiles")[1].alias("p50_basket"),
        F.col("quartiles")[2].alias("p75_basket"),
    ).drop("quartiles")


def review_sample(result: DataFrame, keys: Sequence[str], n: int = 20, seed: str = "review") -> DataFrame:
    """n rows in an order that only depends on their key and the seed."""
    ticket = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed)))
    return result.withColumn("ticket", ticket).orderBy("ticket").limit(n).drop("ticket")


def sample_sizes(tables: SpendTables, config: IndexConfig) -> DataFrame:
    """Rows per category, retail shopping days and the largest visitor count per state."""
    rows = visitor_rows(tables, CATEGORIES, STATE, config).filter(F.col(STATE.column).isNotNull())
    days = rows.groupBy(STATE.column, "category", CARD, "trans_date").agg(purchases_in(rows).alias("n"))
    cards = days.groupBy(STATE.column, "category", CARD).agg(
        F.sum("n").alias("n"), F.count("*").alias("days")
    )
    known = F.col(CARD).isNotNull()
    sizes = cards.groupBy(STATE.column, "category").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("days"))).alias("days"),
        F.count_if(known).alias("visitors"),
    )

    def of(category: str, value: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("category") == category, F.col(value))), F.lit(0))

    return sizes.groupBy(F.col(STATE.column).alias("state")).agg(
        of("restaurant", "n").alias("restaurant_transactions"),
        of("accommodation", "n").alias("accommodation_stays"),
        of("attraction", "n").alias("attraction_transactions"),
        of("retail", "days").alias("retail_shopping_days"),
        F.max("visitors").alias("max_unique_visitors"),
    )


def stay_percentiles(tables: SpendTables, category: Category, config: IndexConfig) -> DataFrame:
    """The 21-point price vector per state over the period."""
    keys = [STATE.column]
    rows = visitor_rows(tables, [category], STATE, config)
    return percentile_vector(count_purchases(rows, keys), keys)


def admin_counts(geo_reference: DataFrame) -> DataFrame:
    keys = ["admin1_id", "admin1", "admin1_abbr", "admin2_id", "admin2", "country"]
    return geo_reference.groupBy(*keys).agg(F.count("*").alias("record_count"))


FUNNEL = {
    "in_period": "1 transactions in the period",
    "far": "2 from visitors",
    "matched": "3 matched to merchants",
    "physical": "4 at physical merchants",
    "coded": "5 with the category's codes",
    "located": "6 matched to a county",
    "in_country": "7 in the country",
}


def filter_funnel(
    tables: SpendTables, config: IndexConfig, category: Category = RETAIL,
    country: str = "United States",
) -> DataFrame:
    """Row counts after each successive filter and join, from one pass over each table.

    Merchant rows are counted per merchant and step before the join, so the join is one row to
    one row and a busy merchant is one row too; the counts multiply out to those of the joined
    rows, including the fan-out over snapshots and geography rows.
    """
    period = filters.in_period(config.start, config.end)
    sales = (
        tables.transactions.filter(period)
        .groupBy("mtid")
        .agg(
            F.count("*").alias("in_period"),
            F.count_if(filters.from_visitors(config.distance)).alias("far"),
        )
    )
    places = (
        tables.geo_reference.filter(F.col("admin2_id").isNotNull())
        .groupBy(F.col("admin2_id").cast("string").alias("merch_city"))
        .agg(
            F.count("*").alias("located"),
            F.count_if(F.col("country") == country).alias("in_country"),
        )
    )
    physical = F.coalesce(filters.physical(), F.lit(False))
    coded = physical & F.coalesce(filters.in_categories([category]), F.lit(False))
    # One row per merchant and place first: city names can be as common as merchants.
    shops = (
        tables.merchants.groupBy("mtid", "merch_city")
        .agg(
            F.count("*").alias("matched"),
            F.count_if(physical).alias("physical"),
            F.count_if(coded).alias("coded"),
        )
        .join(places, "merch_city", "left")
        .groupBy("mtid")
        .agg(
            F.sum("matched").alias("matched"),
            F.sum("physical").alias("physical"),
            F.sum("coded").alias("coded"),
            F.sum(F.col("coded") * F.coalesce("located", F.lit(0))).alias("located"),
            F.sum(F.col("coded") * F.coalesce("in_country", F.lit(0))).alias("in_country"),
        )
    )
    steps = ("matched", "physical", "coded", "located", "in_country")
    totals = sales.join(shops, "mtid", "left").agg(
        F.coalesce(F.sum("in_period"), F.lit(0)).alias("in_period"),
        F.coalesce(F.sum("far"), F.lit(0)).alias("far"),
        *[F.coalesce(F.sum(F.col("far") * F.col(s)), F.lit(0)).alias(s) for s in steps],
    )
    rows = {label: (F.col(step),) for step, label in FUNNEL.items()}
    return _as_rows(totals, "check_name", rows, ("count",)).orderBy("check_name")


def city_profile(merchants: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent merch_city values."""
    return (
        merchants.filter(F.col("merch_city").isNotNull())
        .groupBy("merch_city")
        .agg(F.count("*").alias("count"))
        .orderBy(F.col("count").desc(), "merch_city")
        .limit(n)
    )
