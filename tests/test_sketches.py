"""Weighted price sketches and card sketches against exact counts."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F
from spending import Till, shop, spend_tables

from triptally.config import CATEGORIES, RETAIL, IndexConfig
from triptally.operators import sketches
from triptally.operators.distribution import price_points
from triptally.operators.joins import STATE
from triptally.plans.category import category_cost, level_prices
from triptally.plans.rollup import Summaries
from triptally.registry import QUERIES

YEAR = IndexConfig(date(2025, 1, 1), date(2025, 12, 31), sample_exclude=2, sample_rolling=4)
APPROX = YEAR.with_(method="approx")
SHARES = {"q25": 0.25, "p35": 0.35, "p50": 0.5, "p65": 0.65, "q75": 0.75}


@pytest.fixture(scope="module")
def million(spark):
    """1e6 rows in two groups, amounts nearly all different, each standing for 1 to 40 purchases, dear
    ones for more."""
    amount = F.exp(F.randn(5) * 1.2 + 3)
    weight = (1 + F.floor(F.rand(6) * 10) + F.when(F.col("trans_amount") > 40, 30).otherwise(0)).cast("long")
    rows = spark.range(0, 1_000_000, 1, 8).select(
        (F.col("id") % 5 == 0).cast("string").alias("place"), amount.alias("trans_amount"),
        (F.col("id") % 20_011).cast("string").alias("membccid"),
    ).withColumn("n", weight)
    return rows.cache()


def exact(rows):
    out = {}
    for place, part in rows.toPandas().groupby("place"):
        part = part.sort_values("trans_amount")
        out[place] = part.trans_amount.to_numpy(), np.cumsum(part.n.to_numpy())
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_rank_error_with_weights(million, parts):
    """Ranks are within 0.3 % of the group, whether summed at once or merged from deliveries."""
    keys = ["place"]
    found = sketches.summaries(million.withColumn("part", F.col("trans_amount") * 1000 % parts), [*keys, "part"] if parts > 1 else keys, APPROX.accuracy)
    points = sketches.weighted_points(sketches.merged(found, keys), keys)
    wanted = exact(million)
    got = price_points(points, keys, SHARES, YEAR.with_(trim=None)).collect()
    for row in got:
        amounts, upto = wanted[row.place]
        assert row.n_before == upto[-1]  # totals are exact
        for name, share in SHARES.items():
            rank = upto[np.searchsorted(amounts, row[name], "right") - 1] / upto[-1]
            assert abs(rank - share) < 0.003, (name, rank)
    assert points.count() <= 2 * 1024 * 6  # digits of numbers up to 40


def test_trimmed_prices_by_sketch(million):
    keys = ["place"]
    approx = {r.place: r for r in price_points(million, keys, SHARES, APPROX).collect()}
    for place, (amounts, upto) in exact(million).items():
        row, total = approx[place], upto[-1]

        def rank(value, amounts=amounts, upto=upto, total=total):
            return upto[np.searchsorted(amounts, value, "right") - 1] / total

        low, high = rank(row.low), rank(row.high)
        assert abs(low - 0.05) < 0.003 and abs(high - 0.98) < 0.003
        for name, share in SHARES.items():
            assert abs(rank(row[name]) - (low + share * (high - low))) < 0.005
        assert abs(row.n_band / total - 0.93) < 0.006


def test_small_groups_are_exact(spark):
    rng = np.random.default_rng(3)
    for size in (1, 2, 15, 16, 17, 127, 128, 1000, 1023):
        rows = [("a", float(a), int(n)) for a, n in zip(rng.permutation(size), rng.integers(1, 9, size), strict=True)]
        frame = spark.createDataFrame(rows, "place string, trans_amount double, n long")
        points = sketches.weighted_points(sketches.summaries(frame, ["place"], 4096), ["place"])
        assert sorted((r.trans_amount, r.n) for r in points.collect()) == sorted((a, n) for _, a, n in rows)
    none = frame.withColumn("n", F.lit(0).cast("long"))
    assert sketches.weighted_points(sketches.summaries(none, ["place"], 4096), ["place"]).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        sketches.weighted_points(sketches.summaries(frame, ["place"], 4096), ["place"], (100,))


def test_card_sketches_unite(million):
    """20,011 cards, all in both groups: within 2 % (three standard errors), united too."""
    found = sketches.summaries(million, ["place"], 200, cards=True)
    for row in sketches.distinct_cards(found, ["place"]).collect():
        assert abs(row.unique_visitors - 20_011) < 400
    both = sketches.merged(found.withColumn("place", F.lit("all")), ["place"])
    assert abs(sketches.distinct_cards(both, ["place"]).first().unique_visitors - 20_011) < 400


def _tables(spark):
    shops = [shop(f"{kind}{state}", code, state=state) for state in ("CA", "OR", "NV")
             for kind, code in (("h", "7011"), ("d", "5812"), ("z", "7998"), ("m", "5311"))]
    shops += [shop("mCA", "5311", ref=date(2025, 7, 11))]
    till = Till()
    for i in range(400):
        for s in shops[:12]:
            if i % 3 or s[0].endswith("CA"):
                till.buy(s[0], f"c{i % 37 + len(s[0])}", 50.0 + (i * 7) % 90, day=date(2025, 1 + i % 6, 1 + i % 20))
    bridge = [("California", "CA", "06", "West", "Pacific"), ("Oregon", "OR", "41", "West", "Pacific")]
    return spend_tables(spark, till.rows, shops, bridge=bridge)


def _same(a, b, drop=()):
    names = [c for c in a.columns if c not in drop]
    return sorted(map(repr, a.select(*names).collect())) == sorted(map(repr, b.select(*names).collect()))


@pytest.mark.parametrize("change", [{"daily_cap": 2}, {"snapshot_join": False}, {"stage": False}])
def test_sketches_take_caps_and_snapshots(spark, change):
    tables = _tables(spark)
    approx = category_cost(tables, RETAIL, STATE, APPROX.with_(**change))
    assert _same(approx, category_cost(tables, RETAIL, STATE, YEAR.with_(**change)), ("calculation_timestamp",))


def test_summaries_roll_up(spark, tmp_path):
    tables = _tables(spark)
    stored = Summaries(spark, str(tmp_path / "s"), APPROX)
    half = date(2025, 3, 10)  # a month from two deliveries
    for run, period in (("a", (YEAR.start, half)), ("b", (date(2025, 3, 11), YEAR.end)), ("a", (YEAR.start, half))):
        stored.add(tables, run, period)
    monthly = stored.prices(tables.bridge).withColumnRenamed("period", "month_date")
    assert _same(monthly, level_prices(tables, CATEGORIES, YEAR), ("unique_visitors",))
    quarters = {(r.level, r.geography, r.category, r.period): r for r in stored.prices(tables.bridge, "quarter").collect()}
    rows = [r for r in tables.transactions.collect() if r.mtid == "mNV"]
    spring = [r for r in rows if r.trans_date.month in (4, 5, 6)]
    row = quarters["state", "NV", "retail", date(2025, 4, 1)]
    assert (row.n_before, row.unique_visitors) == (len(spring), len({r.membccid for r in spring}))
    assert ("division", None, "retail", date(2025, 4, 1)) not in quarters  # Nevada has no division
    with pytest.raises(ValueError, match="cap"):
        Summaries(spark, str(tmp_path / "t"), APPROX.with_(daily_cap=2))


def test_no_card_is_shuffled(spark, tmp_path):
    """The only exchange of the transactions moves sketches."""
    tables = _tables(spark)
    from triptally.operators.distribution import single_purchases
    from triptally.plans.category import visitor_rows

    rows = single_purchases(visitor_rows(tables, CATEGORIES, STATE, YEAR))
    found = sketches.summaries(rows, ["category", "merch_state", "month_date"], 200, cards=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = next(line for line in plan.splitlines() if "Exchange hashpartitioning(category" in line)
    assert "membccid" not in top and "digit" in top


def test_registered_sketches(spark):
    found = QUERIES["visitors_by_quarter"](spark, "/root/testdata/sf0.001")
    assert {"unique_visitors", "n_before"} <= set(found.columns) and found.count() > 0
