from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta

from triptally.operators import capping

SCHEMA = "place string, month string, trans_date date, membccid string, trans_amount double"
KEYS = ["place", "month"]


def shopping():
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        day = date(2025, 7, 1) + timedelta(days=rng.randrange(4))
        place = rng.choice(["CA", "NV", "OR", None])
        amount = rng.choice([5.0, 7.5, 9.99, 20.0, 31.0, None])
        rows.append((place, "2025-07", day, rng.choice(["a", "b", "c", None]), amount))
    # One card repeats one purchase very often, with a tie between states at the cap.
    rows += [("CA", "2025-07", date(2025, 7, 9), "hot", 12.0)] * 25_000
    rows += [("NV", "2025-07", date(2025, 7, 9), "hot", 12.0)] * 3
    rows += [("NV", "2025-07", date(2025, 7, 9), "hot", 99.0)]
    return rows


def ranked_by_hand(rows):
    days = defaultdict(list)
    for row in rows:
        days[row[3], row[2]].append(row)
    for bought in days.values():
        bought.sort(key=lambda r: (r[4] is None, -(r[4] or 0), r[0] is not None, r[0] or ""))
        yield from ((row, rank) for rank, row in enumerate(bought, 1))


def ranked(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return capping.rank_purchases(capping.count_daily_purchases(frame, KEYS), ["place"])


def counted(rows):
    counts = defaultdict(int)
    for row in rows:
        counts[row] += 1
    return dict(counts)


def test_kept_purchases_equal_row_by_row_ranking(spark):
    rows = shopping()
    for cap in (1, 3, 10):
        wanted = counted(row for row, rank in ranked_by_hand(rows) if rank <= cap)
        kept = capping.keep_dearest(ranked(spark, rows), cap)
        found = {
            (r.place, r.month, r.trans_date, r.membccid, r.trans_amount): r.n
            for r in kept.collect()
        }
        assert found == wanted


def test_unfolded_ranks_equal_row_by_row_ranking(spark):
    rows = shopping()
    wanted = counted((*row, rank) for row, rank in ranked_by_hand(rows))
    ranks = capping.daily_ranks(ranked(spark, rows), chunk=1000)
    columns = ["place", "month", "trans_date", "membccid", "trans_amount", "daily_rank"]
    assert counted(tuple(r) for r in ranks.select(columns).collect()) == wanted


def test_top_of_day_equals_the_cap(spark):
    rows = shopping()
    frame = spark.createDataFrame(rows, SCHEMA)
    top = capping.top_of_day(frame, 2, ["place"]).drop("daily_rank")
    wanted = counted(row for row, rank in ranked_by_hand(rows) if rank <= 2)
    assert counted(tuple(r) for r in top.collect()) == wanted


def test_impact_equals_row_by_row_computation(spark):
    rows, cap = shopping(), 4
    per = defaultdict(lambda: defaultdict(lambda: defaultdict(lambda: [0, 0])))
    for row, rank in ranked_by_hand(rows):
        if row[0] is not None and row[3] is not None:
            entry = per[row[0]][row[3]][row[2]]
            entry[0] += 1
            entry[1] += rank <= cap
    impact = capping.capping_impact(ranked(spark, rows), KEYS, cap)
    found = {r.place: r for r in impact.collect()}
    assert set(found) == set(per)
    for place, cards in per.items():
        row = found[place]
        before = sum(n for days in cards.values() for n, _ in days.values())
        after = sum(k for days in cards.values() for _, k in days.values())
        assert (row.txn_before_cap, row.txn_after_cap) == (before, after)
        assert row.txn_capped == before - after
        assert row.unique_cardholders_total == len(cards)
        affected = sum(any(n > k for n, k in days.values()) for days in cards.values())
        assert row.cardholders_affected_by_cap == affected
        frequent = sum(
            sum(n > cap for n, _ in days.values()) / len(days) > 0.5 for days in cards.values()
        )
        assert row.frequent_high_volume_shoppers == frequent
        totals = [(sum(n for n, _ in days.values()), len(days)) for days in cards.values()]
        average = sum(n / d * n for n, d in totals) / sum(n for n, _ in totals)
        assert abs(row.avg_txn_per_cardholder_per_day - average) <= 0.005 + 1e-9


def test_each_card_once_in_the_plain_average(spark):
    rows = [("CA", "m", date(2025, 7, 1), "a", 1.0)] * 3 + [("CA", "m", date(2025, 7, 1), "b", 1.0)]
    frame = ranked(spark, rows)
    weighted = capping.capping_impact(frame, KEYS, 10).first()
    plain = capping.capping_impact(frame, KEYS, 10, weighted_average=False).first()
    assert weighted.avg_txn_per_cardholder_per_day == 2.5
    assert plain.avg_txn_per_cardholder_per_day == 2.0


def test_missing_cards_are_spread(spark):
    """A day with 400,000 different purchases without card: no task ranks more than a few percent."""
    from pyspark.sql import functions as F

    day = F.lit(date(2025, 7, 1))
    rows = spark.range(0, 400_000, 1, 8).select(
        F.lit("CA").alias("place"), F.lit("2025-07").alias("month"), day.alias("trans_date"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("c"), F.col("id"))).alias("membccid"),
        ((F.col("id") * 7919 % 400_000) / 100 + 1).alias("trans_amount"),
    )
    daily = capping.count_daily_purchases(rows, KEYS)
    found = capping.rank_purchases(daily, ["place"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__part" in next(x for x in plan.splitlines() if "Exchange hashpartitioning(membccid" in x)
    sizes = found.filter("membccid is null").withColumn("part", capping.price_range(F.col("trans_amount")))
    assert sizes.groupBy("part").count().agg(F.max("count")).first()[0] < 0.05 * 300_000
    # The same ranks as in one list.
    missing = found.filter("membccid is null").orderBy(F.desc("trans_amount"))
    assert [r.earlier for r in missing.select("earlier").collect()] == list(range(300_000))
    assert found.filter("membccid is not null").agg(F.max("earlier")).first()[0] == 0
