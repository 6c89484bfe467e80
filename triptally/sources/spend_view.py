"""Spend tables derived from the star-schema test tables, for checks and benchmarks.

Orders play card purchases, suppliers play merchants, nations play states and regions play
census divisions. Everything is a plain expression over the given tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triptally.config import ATTRACTION_CODES, RETAIL_CODES

# The columns used here, so that reading needs no schema inference.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _strings(values) -> Column:
    return F.split(F.lit(",".join(values)), ",")


def _merchant_code(kind: Column, size: Column) -> Column:
    attraction, retail = _strings(ATTRACTION_CODES), _strings(RETAIL_CODES)
    other = _strings(("7011", "3500", "3839", "5411"))
    return (
        F.when(kind == "ECONOMY", "5812")
        .when(kind == "SMALL", F.when(size % 2 == 0, "5814").otherwise("5812"))
        .when(kind == "LARGE", F.get(attraction, size % len(ATTRACTION_CODES)))
        .when(kind == "MEDIUM", F.get(retail, size % len(RETAIL_CODES)))
        .when(kind == "STANDARD", (size * 6 + 3501).cast("string"))
        .otherwise(F.get(other, size % 4))
    )


def _possible_codes(spark: SparkSession, folder: str) -> Column:
    """The codes that any part gives, as an array: a handful, as a scalar subquery."""
    code = _merchant_code(F.col("p_type"), F.col("p_size"))
    return _read(spark, folder, "part").select(F.collect_set(code)).scalar()


def _snapshot_days(spark: SparkSession, folder: str) -> Column:
    """The first days of the years with orders, as an array."""
    year = F.trunc(F.col("o_orderdate").cast("date"), "year")
    return _read(spark, folder, "orders").select(F.collect_set(year)).scalar()


def _state(nation: Column, name: Column) -> Column:
    return F.when(nation == 24, "XX").otherwise(name)


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return _read(spark, folder, name)

    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = read("part").select(
        "p_partkey", _merchant_code(F.col("p_type"), F.col("p_size")).alias("mcc")
    )
    bought = (
        read("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(
            read("customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .join(
            read("supplier").select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
    )
    day = F.col("o_orderdate").cast("date")
    miles = F.abs(F.col("c_nationkey") - F.col("s_nationkey")) * 20.0
    return bought.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txid"),
        F.concat_ws("-", "l_suppkey", "mcc").alias("mtid"),
        F.col("o_custkey").cast("string").alias("membccid"),
        day.alias("trans_date"),
        (F.col("l_extendedprice") / 100).alias("trans_amount"),
        miles.alias("trans_distance"),
        F.trunc(day, "year").alias("ref_date"),
    )


def merchants(spark: SparkSession, folder: str) -> DataFrame:
    """Every supplier under every code that parts give, with one snapshot per year of orders."""
    nations = _read(spark, folder, "nation").select("n_nationkey", "n_name")
    suppliers = _read(spark, folder, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    city = F.when(nation == 22, "11001").otherwise((nation + 1000).cast("string"))
    return (
        suppliers.join(nations, nation == F.col("n_nationkey"))
        .withColumn("mcc", F.explode(_possible_codes(spark, folder)))
        .withColumn("ref_date", F.explode(_snapshot_days(spark, folder)))
        .select(
            F.concat_ws("-", "s_suppkey", "mcc").alias("mtid"),
            F.col("s_name").alias("merch_desc"),
            "mcc",
            F.when(key % 5 == 4, 1).otherwise(0).cast("long").alias("merch_type"),
            F.when(key % 4 == 3, F.col("s_name")).otherwise(city).alias("merch_city"),
            _state(nation, F.col("n_name")).alias("merch_state"),
            F.when(key % 10 != 7, "US").alias("merch_country"),
            F.lit("US").alias("z_country"),
            "ref_date",
        )
    )


def bridge(spark: SparkSession, folder: str) -> DataFrame:
    """States 0 to 22; state 23 is missing and 24 is the unknown one."""
    regions = _read(spark, folder, "region")
    nations = _read(spark, folder, "nation")
    return (
        nations.filter(F.col("n_nationkey") < 23)
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("state_name"),
            F.col("n_name").alias("abbreviation"),
            F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("state_fips_code"),
            F.col("r_name").alias("census_region"),
            F.col("r_name").alias("census_region_division"),
        )
    )


def geo_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as counties of their region, with one row per supplier below them."""
    regions = _read(spark, folder, "region")
    nations = _read(spark, folder, "nation")
    suppliers = _read(spark, folder, "supplier")
    nation = F.col("n_nationkey")
    return (
        suppliers.join(nations, F.col("s_nationkey") == nation)
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.when(nation % 5 == 3, "Canada").otherwise("United States").alias("country"),
            F.col("r_name").alias("admin1"),
            F.col("r_regionkey").cast("long").alias("admin1_id"),
            F.substring("r_name", 1, 2).alias("admin1_abbr"),
            F.col("n_name").alias("admin2"),
            F.when(nation == 22, 11001)
            .when(nation != 21, nation + 1000)
            .cast("long")
            .alias("admin2_id"),
            F.col("s_name").alias("admin3"),
            F.col("s_suppkey").alias("admin3_id"),
            F.col("s_suppkey").alias("admin_pk"),
        )
    )


def lodging(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as hotel nights, 28 years earlier: dates move into the period of the
    transactions and keep their day of the week. One county has no code and lies in DC, another
    has none and does not."""
    events = _read(spark, folder, "events")
    nation = F.col("user_id") % 25
    return events.filter(F.col("event_type") == "purchase").select(
        F.when(~nation.isin(21, 22), (nation + 1000).cast("string")).alias("county_fips"),
        F.when(nation == 22, "DC").otherwise("ST").alias("state_abbr"),
        F.add_months(F.col("ts").cast("date"), -28 * 12).alias("stay_date"),
        F.col("value").alias("adr"),
        F.col("user_id").cast("string").alias("property_id"),
        F.lit("United States").alias("country"),
        (F.col("event_id") % 10 + 1).cast("double").alias("occupancy"),
    )


class SpendView:
    """The derived tables under the names of SpendTables, each built when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def transactions(self) -> DataFrame:
        return transactions(self.spark, self.folder)

    @cached_property
    def merchants(self) -> DataFrame:
        return merchants(self.spark, self.folder)

    @cached_property
    def bridge(self) -> DataFrame:
        return bridge(self.spark, self.folder)

    @cached_property
    def geo_reference(self) -> DataFrame:
        return geo_reference(self.spark, self.folder)

    @cached_property
    def lodging(self) -> DataFrame:
        return lodging(self.spark, self.folder)
