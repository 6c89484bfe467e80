"""Everything a run can be parameterised by: categories, period, rules, basket weights."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

# Merchant category codes and quality labels, as published in the method.
RESTAURANT_CODES = ("5812",)
RESTAURANT_CODES_WITH_FAST_FOOD = ("5812", "5814")
ACCOMMODATION_CODES = ("7011", "7012")
ACCOMMODATION_RANGE = ("3501", "3838")
ATTRACTION_CODES = (
    "7996", "7995", "7998", "7991", "7933", "7832",
    "7911", "7929", "7922", "7932", "7994", "7999",
)
RETAIL_CODES = (
    "5971", "5977", "7230", "5942", "5994", "5611", "5621", "5631",
    "5641", "5651", "5681", "5691", "5699", "5311", "5992", "5993",
    "5309", "5310", "5931", "5943", "5947", "5950", "5995", "5999",
    "5944", "5948", "5661", "5655", "5832", "5932", "5937", "5940",
    "5941", "5945", "5946", "5949", "5970", "5972",
)
# Labels of price buckets and the amounts they end below; the last has no end.
PRICE_BUCKETS = (
    ("$0-50", 50), ("$50-100", 100), ("$100-150", 150), ("$150-200", 200), ("$200-300", 300),
    ("$300+", None),
)
EXCLUDE, ROLLING, SINGLE = "EXCLUDE", "ROLLING_3MO", "SINGLE_MONTH"
UNKNOWN_STATE = "XX"
DC_COUNTY_FIPS = "11001"


@dataclass(frozen=True)
class Category:
    """One spending category: which merchants belong to it and which prices it reports.

    `prices` maps an output column to a percentile of the trimmed amounts. `spread` adds
    min/max/quartiles. `regulars` names the people in the frequent-buyer columns.
    """

    name: str
    codes: tuple[str, ...]
    prices: tuple[tuple[str, float], ...]
    code_range: tuple[str, str] | None = None
    min_amount: float | None = None
    spread: bool = False
    regulars: str = "visitors"


ACCOMMODATION = Category(
    "accommodation", ACCOMMODATION_CODES, (("accommodation_cost", 0.5),),
    code_range=ACCOMMODATION_RANGE, min_amount=50.0, spread=True, regulars="bookers",
)
ATTRACTION = Category("attraction", ATTRACTION_CODES, (("attraction_cost", 0.5),))
RESTAURANT = Category(
    "restaurant", RESTAURANT_CODES,
    (("breakfast_lunch_cost", 0.35), ("dinner_cost", 0.65), ("median_meal_cost", 0.5)),
)
RESTAURANT_MEDIAN = Category(
    "restaurant", RESTAURANT_CODES_WITH_FAST_FOOD, (("restaurant_cost", 0.5),)
)
RETAIL = Category(
    "retail", RETAIL_CODES, (("retail_cost", 0.5),), min_amount=0.0, regulars="shoppers"
)
RETAIL_NO_MINIMUM = replace(RETAIL, min_amount=None)
CATEGORIES = (ACCOMMODATION, ATTRACTION, RESTAURANT, RETAIL)


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of one run.

    method: "disc" and "cont" are exact (an observed value, or linear interpolation between
    two); "approx" takes "disc" percentiles from mergeable KLL sketches with weights, of size
    `accuracy` (KLL's k), with ranks wrong by about 0.2 % of a group at the default.
    flag_basis: what the sample-size limits count, "visitors" or "transactions".
    snapshot_join: match a transaction to the merchant snapshot of its own ref_date; False
    matches every snapshot of the merchant, so a transaction counts once per snapshot: its rows then
    carry that number as `snapshots`.
    ref_dates: first and last snapshot a run may read, on both sides of that join; None reads all.
    Tables stored by ref_date are then read only in part.
    stage: write the purchases a run reads several times, and the bands they are trimmed to, to the
    shared folder. Later steps read those tables: nothing is computed twice, a lost executor costs
    no more than the running step, and the bands, counted by then, are broadcast when they are at
    most `broadcast_rows`. False keeps a run one lazy plan.
    """

    start: date
    end: date
    distance: float = 60.0
    trim: tuple[float, float] | None = (0.05, 0.98)
    daily_cap: int | None = None
    sample_exclude: int = 600
    sample_rolling: int = 2000
    flag_basis: str = "visitors"
    method: str = "disc"
    accuracy: int = 4096
    snapshot_join: bool = True
    ref_dates: tuple[date, date] | None = None
    stage: bool = True
    broadcast_rows: int = 200_000

    def __post_init__(self) -> None:
        if self.end < self.start:
            raise ValueError(f"period ends before it starts: {self.start} > {self.end}")
        if self.method not in ("disc", "cont", "approx"):
            raise ValueError(f"unknown percentile method {self.method!r}")
        if self.flag_basis not in ("visitors", "transactions"):
            raise ValueError(f"unknown flag basis {self.flag_basis!r}")
        if self.daily_cap is not None and self.daily_cap < 1:
            raise ValueError("daily_cap must be at least 1")
        if any(round(share, 6) != share or not 0 <= share <= 1 for share in self.trim or ()):
            raise ValueError("trim takes shares from 0 to 1 with at most six decimals")

    def with_(self, **changes) -> IndexConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class BasketWeights:
    """How many of each component one trip buys."""

    accommodation: float = 2
    attraction: float = 2
    breakfast_lunch: float = 4
    dinner: float = 2
    retail: float = 2


# The implemented basket and the two others the method text describes.
COUPLE_WEEKEND = BasketWeights()
ONE_RETAIL_DAY = BasketWeights(retail=1)
SINGLE_LODGING_CHARGE = BasketWeights(accommodation=1)


@dataclass(frozen=True)
class CountyConfig:
    """The county index: its own limits, cap and quantities on top of an IndexConfig.

    every_month: a row for every month of the period; False ends at the first and last month that
    any county has data for.
    """

    index: IndexConfig
    weights: BasketWeights = COUPLE_WEEKEND
    min_properties: int = 1
    min_lodging: int = 30
    min_restaurant: int = 50
    min_attraction: int = 20
    min_retail: int = 20
    country: str = "United States"
    every_month: bool = True
