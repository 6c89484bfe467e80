"""Small literal spend tables, and a row-by-row computation of prices to compare with."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import types as T

from triptally.sources.tables import SpendTables

TXN = T.StructType(
    [
        T.StructField("txid", T.StringType()),
        T.StructField("mtid", T.StringType()),
        T.StructField("membccid", T.StringType()),
        T.StructField("trans_date", T.DateType()),
        T.StructField("trans_amount", T.DoubleType()),
        T.StructField("trans_distance", T.DoubleType()),
        T.StructField("ref_date", T.DateType()),
    ]
)
SHOP = T.StructType(
    [
        T.StructField("mtid", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("merch_type", T.LongType()),
        T.StructField("merch_city", T.StringType()),
        T.StructField("merch_state", T.StringType()),
        T.StructField("merch_country", T.StringType()),
        T.StructField("z_country", T.StringType()),
        T.StructField("ref_date", T.DateType()),
    ]
)
BRIDGE = "state_name string, abbreviation string, state_fips_code string, census_region string, census_region_division string"
WEEK = date(2025, 7, 4)
DAY = date(2025, 7, 1)


def shop(mtid, mcc, state="CA", kind=0, country="US", city=None, ref=WEEK):
    return (mtid, mcc, kind, city, state, country, "US", ref)


class Till:
    """Collects transactions with running ids."""

    def __init__(self):
        self.rows = []

    def buy(self, mtid, card, amount, day=DAY, distance=100.0, ref=WEEK, times=1):
        for _ in range(times):
            self.rows.append((f"t{len(self.rows)}", mtid, card, day, amount, distance, ref))
        return self


def spend_tables(spark, rows, shops, bridge=(), geo=None, lodging=None) -> SpendTables:
    return SpendTables(
        spark.createDataFrame(rows, TXN),
        spark.createDataFrame(list(shops), SHOP),
        spark.createDataFrame(list(bridge), BRIDGE) if bridge else None,
        geo,
        lodging,
    )


def nearest(values, share):
    """The smallest value with at least `share` of all values at or below it."""
    ordered = sorted(values)
    return ordered[max(1, math.ceil(round(len(ordered) * share, 9))) - 1]


def between(values, share):
    ordered = sorted(values)
    position = (len(ordered) - 1) * share
    low, high = math.floor(position), math.ceil(position)
    return ordered[low] + (ordered[high] - ordered[low]) * (position - low)
