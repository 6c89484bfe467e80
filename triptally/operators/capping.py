"""At most so many purchases per card and day, keeping the dearest, and what that changes.

Purchases of one card, day, place and amount are indistinguishable in every result, so they are
counted first; the cap then works on counts. Equal amounts are kept in order of place, which
makes the outcome the same on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triptally.functions.scalars import percent_of
from triptally.operators.distribution import AMOUNT, CARD, price_range
from triptally.operators.filters import present
from triptally.operators.joins import purchases_in

DAY = "trans_date"


def count_daily_purchases(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Purchases as (keys, day, card, amount, n); missing places and amounts are kept."""
    return rows.groupBy(*keys, DAY, CARD, AMOUNT).agg(purchases_in(rows).alias("n"))


def _dearest_first(within: Sequence[str], place: Sequence[str]) -> Window:
    return Window.partitionBy(*within, CARD, DAY).orderBy(
        F.col(AMOUNT).desc_nulls_last(), *[F.col(p).asc_nulls_first() for p in place]
    )


def top_of_day(
    rows: DataFrame, cap: int, place: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """The `cap` dearest rows per card and day with their rank. Spark cuts every card-day down to
    that many rows before shuffling."""
    rank = F.row_number().over(_dearest_first(within, place))
    return rows.withColumn("daily_rank", rank).filter(F.col("daily_rank") <= cap)


_PART, _CARRY = "__part", "__carry"
_LAST = -(1 << 40)  # the part of missing amounts, below that of any amount


def rank_purchases(
    daily: DataFrame, place: Sequence[str], within: Sequence[str] = ()
) -> DataFrame:
    """Daily purchase counts with `earlier`, how many dearer purchases the card-day has.

    A card-day has one row per place and distinct amount here, however often it bought. Purchases
    whose card is missing rank as one card a day, which can be most of a day: they are cut into parts
    by ranges of price about a percent wide, and a part begins to count where the dearer parts of its
    day end. That number comes to each part as a row of its own, so that nothing is joined.
    """
    missing = F.col(CARD).isNull() & F.col(DAY).isNotNull()
    part = F.when(missing, F.when(F.col(AMOUNT).isNull(), F.lit(_LAST)).otherwise(price_range(F.col(AMOUNT))))
    parts = daily.withColumn(_PART, part)
    # Cards that are known fall into one row a day here, told apart by a condition: a filter would
    # reach below the counts and make them a second computation.
    totals = parts.groupBy(*within, DAY, _PART).agg(F.sum("n").alias("n"))
    dearer_parts = (
        Window.partitionBy(*within, DAY).orderBy(F.col(_PART).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.withColumn("n", F.sum("n").over(dearer_parts)).filter(
        F.col(_PART).isNotNull() & F.col("n").isNotNull()
    )
    carried = carried.select(
        *within, DAY, _PART, "n", F.lit(None).cast(daily.schema[CARD].dataType).alias(CARD)
    )
    rows = parts.withColumn(_CARRY, F.lit(1)).unionByName(
        carried.withColumn(_CARRY, F.lit(0)), allowMissingColumns=True
    )
    dearer = (
        Window.partitionBy(*within, CARD, DAY, _PART)
        .orderBy(
            _CARRY, F.col(AMOUNT).desc_nulls_last(), *[F.col(p).asc_nulls_first() for p in place]
        )
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = rows.withColumn("earlier", F.coalesce(F.sum("n").over(dearer), F.lit(0)))
    return ranked.filter(F.col(_CARRY) == 1).drop(_PART, _CARRY)


def kept(cap: int | Column) -> Column:
    """How many of a row's purchases are among the card-day's `cap` dearest."""
    limit = F.lit(cap) if isinstance(cap, int) else cap
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), limit - F.col("earlier")))


def daily_ranks(ranked: DataFrame, chunk: int = 10_000) -> DataFrame:
    """One row per purchase with its rank in the card-day. Unfolded in chunks, so that no row
    builds a long array however often its purchase was repeated."""
    first, last = F.col("earlier") + 1, F.col("earlier") + F.col("n")
    starts = ranked.withColumn("start", F.explode(F.sequence(first, last, F.lit(chunk).cast("long"))))
    stop = F.least(F.col("start") + (chunk - 1), last)
    ranks = starts.withColumn("daily_rank", F.explode(F.sequence(F.col("start"), stop)))
    return ranks.drop("start", "earlier", "n")


def keep_dearest(ranked: DataFrame, cap: int | Column) -> DataFrame:
    """Ranked purchases reduced to the `cap` dearest per card and day, across all places."""
    return ranked.withColumn("n", kept(cap)).filter(F.col("n") > 0).drop("earlier")


def card_days(ranked: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Purchases before (`n_raw`) and after (`n_kept`) the cap per group, card and day."""
    return ranked.groupBy(*keys, CARD, DAY).agg(
        F.sum("n").alias("n_raw"), F.sum(kept(cap)).alias("n_kept")
    )


def card_patterns(days: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Per group and card: active days, days over the cap, purchases per day.

    "Over the cap" counts the group's own purchases of the day, while the cap itself ranks a
    card's purchases across all groups.
    """
    return days.groupBy(*keys, CARD).agg(
        F.count("*").alias("active_days"),
        F.count_if(F.col("n_raw") > cap).alias("days_over_cap"),
        F.count_if(F.col("n_raw") > F.col("n_kept")).alias("days_affected"),
        F.avg("n_raw").alias("avg_daily_txn_count"),
        F.max("n_raw").alias("max_daily_txn_count"),
        F.sum("n_raw").alias("n_raw"),
        F.sum("n_kept").alias("n_kept"),
    )


def capping_impact(
    ranked: DataFrame,
    keys: Sequence[str],
    cap: int,
    regulars: str = "shoppers",
    weighted_average: bool = True,
) -> DataFrame:
    """What the cap did to each group. Purchases without card or group are left out.

    The average per card and day weighs each card by its purchases (or counts each card once).
    Cards are told apart by conditions, not by a filter, which would reach below the ranking and
    make it a second one.
    """
    frequent = f"frequent_high_volume_{regulars}"
    cards = card_patterns(card_days(ranked, keys, cap), keys, cap)
    known = F.col(CARD).isNotNull()
    purchases = F.when(known, F.col("n_raw"))
    daily_average = F.when(known, F.col("avg_daily_txn_count"))
    average = F.avg(daily_average)
    if weighted_average:
        average = F.sum(daily_average * purchases) / F.sum(purchases)
    counted = cards.groupBy(*keys).agg(
        F.sum(purchases).alias("txn_before_cap"),
        F.sum(F.when(known, F.col("n_kept"))).alias("txn_after_cap"),
        F.count_if(known).alias("unique_cardholders_total"),
        F.count_if(known & (F.col("n_raw") > F.col("n_kept"))).alias("cardholders_affected_by_cap"),
        F.round(average, 2).alias("avg_txn_per_cardholder_per_day"),
        F.count_if(known & (F.col("days_over_cap") / F.col("active_days") > 0.5)).alias(frequent),
    )
    counted = counted.filter((F.col("unique_cardholders_total") > 0) & present(keys))
    total = F.col("unique_cardholders_total")
    return counted.select(
        *keys,
        "txn_before_cap",
        "txn_after_cap",
        (F.col("txn_before_cap") - F.col("txn_after_cap")).alias("txn_capped"),
        percent_of(F.col("txn_before_cap") - F.col("txn_after_cap"), F.col("txn_before_cap")).alias(
            "pct_txn_capped"
        ),
        "unique_cardholders_total",
        "cardholders_affected_by_cap",
        percent_of(F.col("cardholders_affected_by_cap"), total).alias(
            "pct_cardholders_affected_any_day"
        ),
        "avg_txn_per_cardholder_per_day",
        frequent,
        percent_of(F.col(frequent), total).alias(f"pct_{frequent}"),
    )


def capping_impact_over_period(ranked: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Period variant: every purchase counts, cards and card-days only where the card is known."""
    cards = card_patterns(card_days(ranked, keys, cap), keys, cap)
    known = F.col(CARD).isNotNull()
    counted = cards.groupBy(*keys).agg(
        F.sum("n_raw").alias("txn_before_cap"),
        F.sum("n_kept").alias("txn_after_cap"),
        F.count_if(known).alias("unique_cardholders_total"),
        F.count_if(known & (F.col("days_affected") > 0)).alias("cardholders_affected_by_cap"),
        F.coalesce(F.sum(F.when(known, F.col("days_affected"))), F.lit(0)).alias(
            "cardholder_days_affected"
        ),
    )
    capped = F.col("txn_before_cap") - F.col("txn_after_cap")
    return counted.select(
        *keys,
        "txn_before_cap",
        "txn_after_cap",
        capped.alias("txn_capped"),
        percent_of(capped, F.col("txn_before_cap")).alias("pct_txn_capped"),
        "unique_cardholders_total",
        "cardholders_affected_by_cap",
        percent_of(
            F.col("cardholders_affected_by_cap"), F.col("unique_cardholders_total")
        ).alias("pct_cardholders_affected"),
        "cardholder_days_affected",
    )
