"""Column expressions used by the plans; all of them are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from triptally.config import (
    DC_COUNTY_FIPS,
    EXCLUDE,
    PRICE_BUCKETS,
    ROLLING,
    SINGLE,
    BasketWeights,
    Category,
    IndexConfig,
)


def month_start(day: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day, "month")


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def months_between(start: date, end: date) -> Column:
    """Array of month starts touched by a period."""
    return F.sequence(
        F.trunc(F.lit(start), "month"), F.trunc(F.lit(end), "month"), F.expr("interval 1 month")
    )


def _code_condition(mcc: str, category: Category) -> str:
    codes = ", ".join(f"'{code}'" for code in category.codes)
    condition = f"{mcc} in ({codes})"
    if category.code_range:
        low, high = category.code_range
        condition = f"({condition} or {mcc} between '{low}' and '{high}')"
    return condition


def code_in(mcc: str, *categories: Category) -> Column:
    """Membership of any of the categories. Codes compare as strings, also in the range."""
    return F.expr(" or ".join(_code_condition(mcc, category) for category in categories))


def category_of(mcc: str, categories: Sequence[Category], other: str = "other") -> Column:
    """Name of the first category holding the code."""
    cases = (f"when {_code_condition(mcc, c)} then '{c.name}'" for c in categories)
    return F.expr(f"case {' '.join(cases)} else '{other}' end")


def above_minimum(amount: Column, category: Column, categories: Sequence[Category]) -> Column:
    """Each category's own minimum amount; a category without one keeps every row."""
    floors = [c for c in categories if c.min_amount is not None]
    keep = F.lit(True)
    for c in floors:
        keep = keep & ((category != c.name) | (amount >= c.min_amount))
    return keep


def quality_flag(sample: Column, config: IndexConfig) -> Column:
    return (
        F.when(sample < config.sample_exclude, EXCLUDE)
        .when(sample < config.sample_rolling, ROLLING)
        .otherwise(SINGLE)
    )


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; null when the whole is zero."""
    return F.round(F.try_divide(part, whole) * 100, 2)


def percent_change(new: Column, old: Column) -> Column:
    return F.round(F.try_divide(new - old, old) * 100, 2)


def card_day_key(card: Column, day: Column) -> Column:
    return F.concat(card, F.lit("_"), day.cast("string"))


def price_bucket(price: Column) -> Column:
    *bounded, (rest, _) = PRICE_BUCKETS
    label = F.when(F.lit(False), rest)
    for name, top in bounded:
        label = label.when(price < top, name)
    return label.otherwise(rest)


def price_bucket_order(bucket: Column) -> Column:
    return F.array_position(F.array(*[F.lit(label) for label, _ in PRICE_BUCKETS]), bucket)


def normalize_dc_county(county: Column, state: Column) -> Column:
    """A missing county is known only in DC, which has a single one."""
    return F.when(county.isNull() & (state == "DC"), DC_COUNTY_FIPS).otherwise(county)


def basket_cost(weights: BasketWeights) -> Column:
    """Price of one trip; null as soon as one component is missing."""
    return (
        F.col("accommodation_cost") * weights.accommodation
        + F.col("attraction_cost") * weights.attraction
        + F.col("breakfast_lunch_cost") * weights.breakfast_lunch
        + F.col("dinner_cost") * weights.dinner
        + F.col("retail_cost") * weights.retail
    )

