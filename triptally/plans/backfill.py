"""Monthly prices kept up to date from deliveries, without reading old transactions again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptally.config import CATEGORIES, Category, IndexConfig
from triptally.operators.capping import DAY
from triptally.operators.distribution import AMOUNT, CARD
from triptally.operators.joins import STATE, Level
from triptally.plans.category import MONTH, costs_of_purchases, countable_purchases
from triptally.sources.publish import PublishedTable
from triptally.sources.tables import SpendTables


def _state_schema(level: Level, daily: bool) -> T.StructType:
    days = f"{DAY} date, " if daily else ""
    return T.StructType.fromDDL(
        f"category string, {level.column} string, {MONTH} date, {days}{CARD} string, "
        f"{AMOUNT} double, n long"
    )


def _result_schema(level: Level, categories: Sequence[Category]) -> T.StructType:
    prices = "".join(f"{name} double, " for category in categories for name, _ in category.prices)
    return T.StructType.fromDDL(
        f"category string, {level.column} string, {MONTH} date, {prices}transaction_count long, "
        "unique_visitors long, n_before long, data_quality_flag string"
    )


class MonthlyPrices:
    """Two published tables under `path`: purchase counts, to which deliveries add, and the results.

    Counts of deliveries merge by addition, so a late delivery, even one with more purchases of a
    month that is known already, costs one pass over that delivery and over the counts of its months.
    The results note up to which version of the counts they follow; a run that stopped between
    the two is made good by the next `refresh`.
    """

    def __init__(
        self, spark: SparkSession, path: str, config: IndexConfig,
        categories: Sequence[Category] = CATEGORIES, level: Level = STATE,
    ):
        self.config, self.categories, self.level = config, categories, level
        schema = _state_schema(level, config.daily_cap is not None)
        self.counts = PublishedTable(spark, f"{path}/counts", schema, MONTH)
        self.results = PublishedTable(spark, f"{path}/results", _result_schema(level, categories), MONTH)

    def deliver(
        self, tables: SpendTables, run: str, period: tuple[date, date] | None = None
    ) -> list[str]:
        """Adds the purchases of a delivery (of `period` only, if given) and recomputes the months it
        touches, which are returned. A run delivered again replaces its former purchases."""
        self.add(tables, run, period)
        return self.refresh()

    def add(
        self, tables: SpendTables, run: str, period: tuple[date, date] | None = None
    ) -> None:
        config = self.config if period is None else self.config.with_(start=period[0], end=period[1])
        self.counts.append(countable_purchases(tables, self.categories, self.level, config), run)

    def stale_months(self) -> list[str]:
        """Months whose counts have changed since the results were computed."""
        now, seen = self.counts.manifest(), self.results.manifest()["note"].get("counts", 0)
        if seen == now["version"]:
            return []
        live = {(w["id"], m) for w in now["writes"] for m in w["live"]}
        before: set[tuple[str, str]] = set()
        if seen in self.counts.versions():
            before = {(w["id"], m) for w in self.counts.manifest(seen)["writes"] for m in w["live"]}
        else:  # never computed, or that version is gone: every month
            live |= {("", m) for m in self.results.months()}
        return sorted({month for _, month in live ^ before})

    def refresh(self) -> list[str]:
        """Recomputes the stale months from the stored counts."""
        version, stale = self.counts.manifest()["version"], self.stale_months()
        if stale:
            days = [date.fromisoformat(month) for month in stale]
            counts = self.counts.read(version).filter(F.col(MONTH).isin(days))
            costs = costs_of_purchases(counts, self.categories, self.level, self.config)
            self.results.replace_months(costs, months=stale, note={"counts": version})
        return stale

    def read(self) -> DataFrame:
        return self.results.read()
