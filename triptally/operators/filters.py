"""Row filters of the transaction, merchant, lodging and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triptally.config import UNKNOWN_STATE, Category
from triptally.functions.scalars import code_in


def present(names: Sequence[str]) -> Column:
    """None of the columns is missing. Written as plain conditions, which the optimizer knows from
    joins, so that several uses of a frame keep sharing one scan."""
    return reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in names])


def in_period(start: date, end: date, day: str = "trans_date") -> Column:
    return F.col(day).between(F.lit(start), F.lit(end))


def from_visitors(distance: float) -> Column:
    """Strictly farther from home than the limit."""
    return F.col("trans_distance") > distance


def physical() -> Column:
    return F.col("merch_type") == 0


def in_us() -> Column:
    return F.col("merch_country") == "US"


def in_categories(categories: Sequence[Category]) -> Column:
    return code_in("mcc", *categories)


def in_band(value: str, low: str, high: str) -> Column:
    return F.col(value).between(F.col(low), F.col(high))


def known_state(state: str = "merch_state") -> Column:
    """Drops only the placeholder code; a missing state is kept."""
    return ~F.col(state).eqNullSafe(UNKNOWN_STATE)


def weekend_night(day: str = "stay_date") -> Column:
    """Friday and Saturday nights."""
    return F.dayofweek(F.col(day)).isin(6, 7)


def just_below(count: str, limit: int, margin: int) -> Column:
    return F.col(count).between(limit - margin, limit - 1)


def latest_month(result: DataFrame, month: str = "month_date") -> DataFrame:
    """Rows of the last month present."""
    last = result.agg(F.max(month).alias(month))
    return result.join(last, month, "left_semi")
