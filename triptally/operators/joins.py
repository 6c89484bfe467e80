"""Joins of transactions to their merchant, and of merchants to a geography level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SNAPSHOTS = "snapshots"


@dataclass(frozen=True)
class Level:
    """A geography level and the column its results carry."""

    name: str
    column: str


STATE = Level("state", "merch_state")
DIVISION = Level("division", "census_region_division")
NATIONAL = Level("national", "geography_level")
COUNTY = Level("county", "county_fips")
LEVELS = {level.name: level for level in (STATE, DIVISION, NATIONAL, COUNTY)}


def with_merchants(
    transactions: DataFrame, merchants: DataFrame, snapshot: bool = True
) -> DataFrame:
    """Inner join on the merchant, by default on its snapshot of the same ref_date.

    Otherwise every snapshot counts. Snapshots that look alike are one row with their number in
    `snapshots` before they meet the transactions, so a purchase is not copied once per snapshot.
    """
    if snapshot:
        return transactions.join(merchants, ["mtid", "ref_date"])
    alike = [c for c in merchants.columns if c != "ref_date"]
    return transactions.join(merchants.groupBy(*alike).agg(F.count("*").alias(SNAPSHOTS)), "mtid")


def purchases_in(rows: DataFrame) -> Column:
    """Aggregate for the number of purchases in rows that may stand for several snapshots."""
    return F.sum(SNAPSHOTS) if SNAPSHOTS in rows.columns else F.count("*")


def with_division(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """Census division of the state; states the bridge does not list drop out."""
    divisions = bridge.select(
        F.col("abbreviation").alias("merch_state"), "census_region_division"
    )
    return rows.join(divisions, "merch_state")


def counties(geo_reference: DataFrame, country: str = "United States") -> DataFrame:
    """One row per county of the country, ids as strings."""
    return (
        geo_reference.filter((F.col("country") == country) & F.col("admin2_id").isNotNull())
        .select(
            F.col("admin2_id").cast("string").alias("county_fips"),
            F.col("admin2").alias("county_name"),
            F.col("admin1").alias("state_name"),
            F.col("admin1_abbr").alias("state_abbr"),
        )
        .distinct()
    )


def with_county(rows: DataFrame, geo_reference: DataFrame, country: str) -> DataFrame:
    """County of a merchant, whose merch_city holds the county id. The id is cast to string:
    city names and phone numbers in merch_city then simply match nothing."""
    known = counties(geo_reference, country).select("county_fips").distinct()
    return rows.join(known, F.col("merch_city") == F.col("county_fips"))


def at_level(
    rows: DataFrame,
    level: Level,
    bridge: DataFrame | None = None,
    geo_reference: DataFrame | None = None,
    country: str = "United States",
) -> DataFrame:
    """Adds the level's geography column."""
    if level == DIVISION:
        return with_division(rows, bridge)
    if level == NATIONAL:
        return rows.withColumn(level.column, F.lit("US"))
    if level == COUNTY:
        return with_county(rows, geo_reference, country)
    return rows


def with_all_places(merchants: DataFrame, bridge: DataFrame) -> DataFrame:
    """Merchants with `places`, their geography at state, division and national level. States
    outside the bridge have no division."""
    divisions = bridge.select(
        F.col("abbreviation").alias("merch_state"), "census_region_division"
    )
    levels = {"state": "merch_state", "division": "census_region_division", "national": None}
    places = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                (F.col(column) if column else F.lit("US")).alias("geography"),
            )
            for level, column in levels.items()
        ]
    )
    known = F.filter(places, lambda place: place["geography"].isNotNull())
    return merchants.join(divisions, "merch_state", "left").withColumn("places", known)
