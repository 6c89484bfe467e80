"""Summaries that merge: price sketches with weights, and sketches of distinct cards.

Spark's KLL sketch counts every value once. A purchase row that stands for n purchases goes into the
sketches of the binary digits of n: the one for digit b holds its values once and weighs 2**b. The
rank error of each is a share of its own weight, so that of all together is the same share of the
total. Sketches of deliveries, states or months merge into those of longer periods and larger places
without going back to the rows, and their cards are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AMOUNT, CARD = "trans_amount", "membccid"
DIGIT, PRICES, CARDS = "digit", "prices", "cards"
# Values taken from a sketch: as few as its purchases need, and no more than the last of these. Powers of
# two, so that none of the ranks asked for is the border between two purchases.
POINTS = (16, 128, 1024)
LG_CARDS = 15  # distinct cards within about 0.6 % (one standard error); exact to some thousands


def summaries(
    purchases: DataFrame, keys: Sequence[str], accuracy: int, cards: bool = False,
    lg_cards: int = LG_CARDS,
) -> DataFrame:
    """(keys, digit, prices[, cards]) of purchases counted by `n`; a few rows per group, combined on
    the map side. `accuracy` is KLL's k: a rank is wrong by about 2.4 / k**0.94 of the group (0.1 %
    at 4096)."""
    digits = F.sequence(F.lit(0), F.floor(F.log2(F.col("n"))).cast("int"))
    present = F.filter(digits, lambda b: F.call_function("getbit", F.col("n"), b) == 1)
    found = [F.kll_sketch_agg_double(AMOUNT, F.lit(accuracy)).alias(PRICES)]
    if cards:
        found.append(F.hll_sketch_agg(CARD, F.lit(lg_cards)).alias(CARDS))
    weighed = purchases.filter(F.col("n") > 0).withColumn(DIGIT, F.explode(present))
    return weighed.groupBy(*keys, DIGIT).agg(*found)


def merged(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of larger groups, or of several deliveries of the same ones."""
    union = [F.kll_merge_agg_double(PRICES).alias(PRICES)]
    if CARDS in found.columns:
        union.append(F.hll_union_agg(CARDS).alias(CARDS))
    return found.groupBy(*keys, DIGIT).agg(*union)


def weighted_points(found: DataFrame, keys: Sequence[str], points: Sequence[int] = POINTS) -> DataFrame:
    """(keys, amount, n): amounts that stand for all purchases of a group, at most points[-1] for each
    digit. Totals are exact; with fewer purchases than that (and k) so is everything."""
    if any(p & (p - 1) for p in points):
        raise ValueError("points must be powers of two")
    size, grid, values = F.kll_sketch_get_n_double(PRICES), F.lit(points[-1]), None
    for count in reversed(points):
        ranks = F.array(*[F.lit((i + 0.5) / count) for i in range(count)])
        asked = F.kll_sketch_get_quantile_double(PRICES, ranks)
        values = asked if values is None else F.when(size < count, asked).otherwise(values)
        grid = F.when(size < count, F.lit(count)).otherwise(grid)
    taken = found.filter(size > 0).select(
        *keys, DIGIT, size.alias("size"), grid.alias("grid"), F.posexplode(values).alias("at", AMOUNT)
    )
    reached = taken.groupBy(*keys, DIGIT, AMOUNT, "size", "grid").agg((F.max("at") + 1).alias("reach"))
    upto = F.round(F.col("reach") * F.col("size") / F.col("grid")).cast("long")
    climbing = Window.partitionBy(*keys, DIGIT).orderBy(AMOUNT)
    counted = reached.withColumn("upto", upto).withColumn(
        "n", F.col("upto") - F.coalesce(F.lag("upto").over(climbing), F.lit(0))
    )
    weight = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(DIGIT))
    weighed = counted.filter(F.col("n") > 0).withColumn("n", F.col("n") * weight)
    return weighed.groupBy(*keys, AMOUNT).agg(F.sum("n").alias("n"))


def distinct_cards(found: DataFrame, keys: Sequence[str], name: str = "unique_visitors") -> DataFrame:
    """Estimated distinct cards per group."""
    return found.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(CARDS)).alias(name))
