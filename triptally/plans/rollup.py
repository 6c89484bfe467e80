"""Prices and visitors of all places and periods from stored summaries of states and months."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptally.config import CATEGORIES, Category, IndexConfig
from triptally.operators import joins, sketches
from triptally.operators.distribution import AMOUNT, price_points, single_purchases
from triptally.operators.filters import present
from triptally.operators.joins import STATE
from triptally.plans.category import MONTH, prices_by_category, shares_of, visitor_rows
from triptally.sources.publish import PublishedTable
from triptally.sources.tables import SpendTables

PERIODS = {"month": F.col, "quarter": lambda c: F.trunc(c, "quarter"), "year": lambda c: F.trunc(c, "year")}


class Summaries:
    """A published table of sketches per category, state and month, to which deliveries add.

    Transactions are read once, by the delivery that brings them. Divisions, the nation, quarters and
    years are unions of what is stored; no card is shuffled, then or later.
    """

    def __init__(
        self, spark: SparkSession, path: str, config: IndexConfig,
        categories: Sequence[Category] = CATEGORIES,
    ):
        if config.daily_cap is not None:
            raise ValueError("a cap ranks purchases across states; summaries are made without one")
        self.config, self.categories = config, categories
        schema = T.StructType.fromDDL(
            f"category string, {STATE.column} string, {MONTH} date, {sketches.DIGIT} int, "
            f"{sketches.PRICES} binary, {sketches.CARDS} binary"
        )
        self.table = PublishedTable(spark, path, schema, MONTH)

    def add(self, tables: SpendTables, run: str, period: tuple[date, date] | None = None) -> None:
        """Adds a delivery; a run added again replaces its former part."""
        config = self.config if period is None else self.config.with_(start=period[0], end=period[1])
        keys = ["category", STATE.column, MONTH]
        rows = visitor_rows(tables, self.categories, STATE, config)
        known = single_purchases(rows.filter(present([*keys, AMOUNT])))
        self.table.append(sketches.summaries(known, keys, config.accuracy, cards=True), run)

    def read(self, bridge: DataFrame, period: str = "month") -> DataFrame:
        """(level, geography, category, period, digit, prices, cards) of states, divisions and the
        nation by `period` (month, quarter or year)."""
        stored = self.table.read().withColumn("period", PERIODS[period](MONTH))
        placed = joins.with_all_places(stored, bridge).select(
            "category", "period", sketches.DIGIT, sketches.PRICES, sketches.CARDS, F.inline("places")
        )
        return sketches.merged(placed, ["level", "geography", "category", "period"])

    def prices(self, bridge: DataFrame, period: str = "month") -> DataFrame:
        """Trimmed prices, purchases before and within the band, and visitors before trimming."""
        keys = ["level", "geography", "category", "period"]
        found = self.read(bridge, period)
        points = sketches.weighted_points(found, keys)
        exact = self.config.with_(method="disc")
        prices = price_points(points, keys, shares_of(self.categories), exact)
        visitors = sketches.distinct_cards(found, keys)
        return prices.join(visitors, keys).select(
            *keys, *prices_by_category(self.categories), "n_before", "n_band", "unique_visitors"
        )
