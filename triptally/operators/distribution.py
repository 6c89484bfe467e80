"""Exact price distributions of weighted purchases, per group.

A purchase table here has one row per (group, card, amount) and a count `n`. Percentiles come
from the histogram of amounts: one row per distinct price of the group, combined on the map side.
What is ranked in one task is one range of a group's prices, about a percent wide, never a group; a
group holding a third of all rows, or with nearly as many prices as rows, is spread over many. Distinct cards are counted apart from it, spread over (group, card).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptally.config import IndexConfig
from triptally.operators import sketches
from triptally.operators.filters import present
from triptally.operators.joins import SNAPSHOTS, purchases_in
from triptally.sources.writers import keep

AMOUNT, CARD = "trans_amount", "membccid"
_SCALE = 1_000_000
RANGE, RANGES_PER_DOUBLING = "price_range", 64


def count_purchases(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Purchases as (keys, card, amount, n). Rows without a key or amount belong to no group."""
    known = rows.filter(present([*keys, AMOUNT]))
    return known.groupBy(*keys, CARD, AMOUNT).agg(purchases_in(rows).alias("n"))


def single_purchases(rows: DataFrame) -> DataFrame:
    """Rows as purchases that count once, or once per snapshot."""
    once = F.lit(1).cast("long")
    weight = F.col(SNAPSHOTS) if SNAPSHOTS in rows.columns else once
    return rows.withColumn("n", weight).drop(SNAPSHOTS)


def price_range(amount: Column) -> Column:
    """A number that never falls as the amount rises, equal for amounts within about one percent."""
    size = F.floor(F.log2(F.abs(amount)) * RANGES_PER_DOUBLING) + (1 << 20)
    side = F.when(amount > 0, size).when(amount < 0, -size)
    # Never null, so that joins on it filter nothing and share the shuffle below them.
    return F.coalesce(side, F.lit(0).cast("long"))


def price_list(purchases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group and distinct amount: purchases `n` at it, `upto` at or below it, and
    `n_group` in the whole group.

    No task ranks a whole group: a group's list is cut into ranges of prices, the totals of the
    ranges (a few hundred rows) give what lies below each, and amounts are ranked within a range.
    """
    histogram = purchases.groupBy(*keys, AMOUNT).agg(F.sum("n").alias("n"))
    ranged = histogram.withColumn(RANGE, price_range(F.col(AMOUNT)))
    totals = ranged.groupBy(*keys, RANGE).agg(F.sum("n").alias("n_range"))
    group = Window.partitionBy(*keys)
    below = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        *keys,
        RANGE,
        F.coalesce(F.sum("n_range").over(below), F.lit(0)).alias("below"),
        F.sum("n_range").over(group).alias("n_group"),
    )
    climbing = (
        Window.partitionBy(*keys, RANGE).orderBy(AMOUNT)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = ranged.withColumn("within", F.sum("n").over(climbing))
    return ranked.join(placed, [*keys, RANGE]).select(
        *keys, AMOUNT, "n", (F.col("below") + F.col("within")).alias("upto"), "n_group"
    )


def _nearest_rank(total: Column, share: float) -> Column:
    """Smallest rank holding at least `share` of the rows, in whole numbers."""
    scaled = total * F.lit(round(share * _SCALE)).cast("long")
    rank = F.call_function("div", scaled + (_SCALE - 1), F.lit(_SCALE))
    return F.greatest(F.lit(1).cast("long"), rank)


def _at_rank(value: str, rank: Column, upto: Column) -> Column:
    """Value at a rank; `value` never falls along the price list, so its minimum is the first."""
    return F.min(F.when(upto >= rank, F.col(value)))


def percentile_columns(
    name: str, share: float, total: Column, upto: Column, method: str
) -> tuple[dict[str, Column], Column]:
    """Aggregates over a price list, and the column that turns them into the percentile."""
    if method == "disc":
        return {name: _at_rank(AMOUNT, _nearest_rank(total, share), upto)}, F.col(name)
    position = (total - 1) * F.lit(float(share))
    lower, upper, part = f"_{name}_lower", f"_{name}_upper", f"_{name}_part"
    aggregates = {
        lower: _at_rank(AMOUNT, F.floor(position) + 1, upto),
        upper: _at_rank(AMOUNT, F.ceil(position) + 1, upto),
        part: F.max(position - F.floor(position)),
    }
    between = F.col(lower) + (F.col(upper) - F.col(lower)) * F.col(part)
    return aggregates, between


def _edge(name: str, share: float, method: str, lowest: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    """Aggregates over a price list, and from them one end of the band: its value `name`, and
    `{name}_rank`, how many purchases lie before the band or up to its end."""
    total, upto = F.col("n_group"), F.col("upto")

    def outside(rank: Column) -> Column:
        if lowest:  # purchases at amounts before the one at this rank
            return F.coalesce(F.max(F.when(upto < rank, upto)), F.lit(0))
        return F.min(F.when(upto >= rank, upto))

    parts, value = percentile_columns(name, share, total, upto, method)
    if method == "disc":
        parts[f"{name}_at"] = outside(_nearest_rank(total, share))
        return parts, {name: value, f"{name}_rank": F.col(f"{name}_at")}
    position = (total - 1) * F.lit(float(share))
    parts[f"{name}_at"] = outside(F.floor(position) + 1)
    parts[f"{name}_next"] = outside(F.ceil(position) + 1)
    # Between two amounts the band begins at the upper and ends at the lower one.
    if lowest:
        inside = value <= F.col(f"_{name}_lower")
        rank = F.when(inside, F.col(f"{name}_at")).otherwise(F.col(f"{name}_next"))
    else:
        inside = value >= F.col(f"_{name}_upper")
        rank = F.when(inside, F.col(f"{name}_next")).otherwise(F.col(f"{name}_at"))
    return parts, {name: value, f"{name}_rank": rank}


def bands(prices: DataFrame, keys: Sequence[str], low: float, high: float, method: str) -> DataFrame:
    """One row per group: the band `low`..`high`, purchases before it (`low_rank`) and up to its end
    (`high_rank`), and `n_before` in all."""
    low_parts, low_value = _edge("low", low, method, True)
    high_parts, high_value = _edge("high", high, method, False)
    found = prices.groupBy(*keys).agg(
        *[part.alias(name) for name, part in (low_parts | high_parts).items()],
        F.max("n_group").alias("n_before"),
    )
    values = [value.alias(name) for name, value in (low_value | high_value).items()]
    return found.select(*keys, *values, "n_before")


def trim(prices: DataFrame, keys: Sequence[str], low: float, high: float, method: str) -> DataFrame:
    """The price list within the group's band [low, high]. Adds the band, `n_before`, and `upto`
    and `n_group` become ranks and size of what is left."""
    found = bands(prices, keys, low, high, method)
    banded = prices.drop("n_group").join(found, list(keys))
    return banded.filter(F.col(AMOUNT).between(F.col("low"), F.col("high"))).select(
        *keys,
        AMOUNT,
        "n",
        (F.col("upto") - F.col("low_rank")).alias("upto"),
        (F.col("high_rank") - F.col("low_rank")).alias("n_group"),
        "n_before",
        "low",
        "high",
    )


def price_points(
    purchases: DataFrame, keys: Sequence[str], shares: Mapping[str, float], config: IndexConfig
) -> DataFrame:
    """Trimmed prices per group. Percentiles are taken again inside the band. With method "approx"
    the group's sketch takes the place of its price list.

    Columns: keys, one per share, min_cost, max_cost, total_amount, purchases before (`n_before`)
    and within (`n_band`) the band, and the band `low`/`high`, null without trimming.
    """
    method = config.method
    if method == "approx":
        # A sketch per group stands for its purchases; from its points on everything is the same.
        found = sketches.summaries(purchases, keys, config.accuracy)
        purchases, method = sketches.weighted_points(found, keys), "disc"
    prices = price_list(purchases, keys)
    if config.trim is None:
        prices = prices.withColumns({"n_before": F.col("n_group"), **_no_band()})
    else:
        prices = trim(prices, keys, *config.trim, method)
    aggregates, outputs = {}, []
    for name, share in shares.items():
        parts, output = percentile_columns(
            name, share, F.col("n_group"), F.col("upto"), method
        )
        aggregates |= parts
        outputs.append(output.alias(name))
    result = prices.groupBy(*keys).agg(
        *[aggregate.alias(name) for name, aggregate in aggregates.items()],
        F.min(AMOUNT).alias("min_cost"),
        F.max(AMOUNT).alias("max_cost"),
        F.sum(F.col("n") * F.col(AMOUNT)).alias("total_amount"),
        F.max("n_group").alias("n_band"),
        F.max("upto").alias("_reach"),
        *[F.max(name).alias(name) for name in ("n_before", "low", "high")],
    )
    # Always holds. Keeps ranks and counts needed where a caller reads only the band, so that the
    # histogram stays the same shuffle everywhere.
    result = result.filter(F.col("_reach") > 0)
    return result.select(*keys, *outputs, *_SUMMARY)


_SUMMARY = ("min_cost", "max_cost", "total_amount", "n_before", "n_band", "low", "high")


def _no_band() -> dict[str, Column]:
    return {name: F.lit(None).cast("double") for name in ("low", "high")}


def inside_band(
    rows: DataFrame,
    priced: DataFrame,
    keys: Sequence[str],
    config: IndexConfig,
    broadcast: bool = False,
) -> DataFrame:
    """Purchases within their group's band, both ends included.

    The band has one row per group. A caller that has counted those rows may ask for a broadcast;
    otherwise adaptive execution broadcasts the band once its measured size allows that, and
    splits skewed groups of a shuffled join if not.
    """
    if config.trim is None:
        return rows
    band = priced.select(*keys, "low", "high")
    joined = rows.join(F.broadcast(band) if broadcast else band, list(keys))
    return joined.filter(F.col(AMOUNT).between(F.col("low"), F.col("high"))).drop("low", "high")


def staged(frame: DataFrame, name: str, config: IndexConfig) -> DataFrame:
    return keep(frame, name) if config.stage else frame


def prices_and_kept(
    purchases: DataFrame,
    keys: Sequence[str],
    shares: Mapping[str, float],
    config: IndexConfig,
    few_groups: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Price points per group, and the purchases inside the bands found with them."""
    prices = staged(price_points(purchases, keys, shares, config), "prices", config)
    if config.stage:
        few_groups = prices.count() <= config.broadcast_rows
    return prices, inside_band(purchases, prices, keys, config, few_groups)


def remove_outliers(
    rows: DataFrame, keys: Sequence[str], config: IndexConfig
) -> tuple[DataFrame, DataFrame]:
    """Rows inside their group's band with the purchases `n` each stands for, and per group how many
    purchases there were and how many went."""
    rows = staged(rows.filter(present([*keys, AMOUNT])), "rows", config)
    bands, kept = prices_and_kept(single_purchases(rows), keys, {}, config)
    removed = bands.select(
        *keys,
        F.col("n_before").alias("txn_before"),
        F.col("n_band").alias("txn_after"),
        (F.col("n_before") - F.col("n_band")).alias("txn_removed"),
    )
    return kept, removed


def visitors(purchases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Purchases and distinct cards per group, apart from the percentiles: in one aggregate the
    percentile state would be kept once per card.

    The condition always holds. It keeps the counts needed even where a caller reads no count, so
    that the purchases stay the same shuffle as those behind the prices.
    """
    counted = purchases.filter(F.col("n") > 0)
    cards = counted.groupBy(*keys, CARD).agg(F.sum("n").alias("n"))
    return cards.groupBy(*keys).agg(
        F.sum("n").alias("transaction_count"), F.count(CARD).alias("unique_visitors")
    )


def percentile_vector(
    purchases: DataFrame, keys: Sequence[str], points: int = 21
) -> DataFrame:
    """Evenly spaced percentiles 0..100 % as an array, with row count, minimum and maximum."""
    shares = [i / (points - 1) for i in range(points)]
    total, upto = F.col("n_group"), F.col("upto")
    vector = [_at_rank(AMOUNT, _nearest_rank(total, share), upto) for share in shares]
    return price_list(purchases, keys).groupBy(*keys).agg(
        F.array(*vector).alias("percentiles"),
        F.sum("n").alias("total_stays"),
        F.min(AMOUNT).alias("min_cost"),
        F.max(AMOUNT).alias("max_cost"),
    )
