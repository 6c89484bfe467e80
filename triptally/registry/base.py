"""Registration, and the parameters all registered queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from triptally.config import CountyConfig, IndexConfig
from triptally.sources.spend_view import SpendView

# A century that holds whatever dates the tables have; limits and caps fit their small groups.
FIRST, LAST = date(1970, 1, 1), date(2069, 12, 31)
WHOLE = IndexConfig(FIRST, LAST, sample_exclude=2, sample_rolling=5)
BY_TRANSACTIONS = WHOLE.with_(flag_basis="transactions")
CAPPED = WHOLE.with_(daily_cap=2)
EVERY_SNAPSHOT = WHOLE.with_(snapshot_join=False)
CAP_TEST = WHOLE.with_(daily_cap=6, snapshot_join=False)
COUNTY = CountyConfig(
    WHOLE.with_(daily_cap=2, method="cont"),
    min_lodging=5, min_restaurant=5, min_attraction=2, min_retail=2, every_month=False,
)
# The whole county index: every county in every month of the period, with data or without.
EVERY_MONTH = replace(COUNTY, every_month=True)
SENSITIVITY_CAPS = (1, 2, 3, 4)
PERIODS = ((FIRST, date(1997, 12, 31)), (date(1998, 1, 1), LAST))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers a function of the spend tables under `key`, with the SQL giving the same rows."""

    def register(build: Callable[[SpendView], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(SpendView(spark, folder))
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
