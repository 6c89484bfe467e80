"""Monthly trip-price indices from card transactions, as Spark DataFrame transformations."""

from triptally.config import (
    ACCOMMODATION,
    ATTRACTION,
    CATEGORIES,
    RESTAURANT,
    RESTAURANT_MEDIAN,
    RETAIL,
    BasketWeights,
    Category,
    IndexConfig,
)
from triptally.plans.backfill import MonthlyPrices
from triptally.plans.basket import basket_from_frames, basket_index, quality_basket
from triptally.plans.category import category_cost, category_costs
from triptally.sources.tables import SpendTables

__all__ = [
    "ACCOMMODATION",
    "ATTRACTION",
    "CATEGORIES",
    "RESTAURANT",
    "RESTAURANT_MEDIAN",
    "RETAIL",
    "BasketWeights",
    "Category",
    "IndexConfig",
    "MonthlyPrices",
    "SpendTables",
    "basket_from_frames",
    "basket_index",
    "category_cost",
    "category_costs",
    "quality_basket",
]
