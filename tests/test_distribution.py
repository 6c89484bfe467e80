from __future__ import annotations

import random
from collections import defaultdict
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from spending import between, nearest

from triptally.config import IndexConfig
from triptally.operators import distribution as dist

CONFIG = IndexConfig(date(2025, 1, 1), date(2025, 12, 31), stage=False)
SHARES = {"q25": 0.25, "p35": 0.35, "p50": 0.5, "p65": 0.65, "q75": 0.75}
SCHEMA = "place string, membccid string, trans_amount double"


def priced(spark, rows, config):
    purchases = dist.count_purchases(spark.createDataFrame(rows, SCHEMA), ["place"])
    prices = dist.price_points(purchases, ["place"], SHARES, config)
    counts = dist.visitors(dist.inside_band(purchases, prices, ["place"], config), ["place"])
    return {r.place: r for r in prices.join(counts, "place").collect()}


def expected(rows, percentile):
    groups = defaultdict(list)
    for place, card, amount in rows:
        if place is not None and amount is not None:
            groups[place].append((card, amount))
    result = {}
    for place, bought in groups.items():
        amounts = [amount for _, amount in bought]
        low, high = percentile(amounts, 0.05), percentile(amounts, 0.98)
        kept = [(card, amount) for card, amount in bought if low <= amount <= high]
        if kept:
            result[place] = (amounts, kept, low, high)
    return result


def check(found, rows, percentile):
    wanted = expected(rows, percentile)
    assert set(found) == set(wanted)
    for place, (amounts, kept, low, high) in wanted.items():
        row, left = found[place], [amount for _, amount in kept]
        assert (row.low, row.high) == (low, high)
        assert (row.n_before, row.n_band, row.transaction_count) == (
            len(amounts), len(left), len(left),
        )
        assert (row.min_cost, row.max_cost) == (min(left), max(left))
        assert row.unique_visitors == len({card for card, _ in kept} - {None})
        for name, share in SHARES.items():
            assert row[name] == percentile(left, share), (place, name)


def shopping(seed):
    rng = random.Random(seed)
    rows = []
    for place, size in (("one", 1), ("two", 2), ("some", 37), ("many", 900)):
        for _ in range(size):
            amount = round(rng.lognormvariate(3, 1), 2)
            rows.append((place, f"c{rng.randrange(size // 3 + 1)}", amount))
    rows += [("same", f"c{i % 4}", 9.99) for i in range(50)]
    rows += [("hot", "c1", 4.5)] * 3000 + [("hot", None, float(i)) for i in range(100)]
    rows += [("refunds", "c", -20.0), ("refunds", "d", 0.0), ("refunds", None, 15.5)]
    rows += [(None, "c", 1.0), ("some", "c", None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_rank_prices_equal_brute_force(spark, seed):
    rows = shopping(seed)
    check(priced(spark, rows, CONFIG), rows, nearest)


def test_interpolated_prices_equal_brute_force(spark):
    rows = shopping(3)
    check(priced(spark, rows, CONFIG.with_(method="cont")), rows, between)


def test_interpolation_agrees_with_numpy(spark):
    rows = [("x", "c", float(v)) for v in np.random.default_rng(5).gamma(2, 40, 501)]
    found = priced(spark, rows, CONFIG.with_(method="cont", trim=None))["x"]
    for name, share in SHARES.items():
        assert found[name] == pytest.approx(np.quantile([r[2] for r in rows], share), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["c", "d", None]),
                  st.integers(-500, 500).map(lambda cents: cents / 100)),
        min_size=1, max_size=60,
    )
)
def test_any_small_purchases(spark, rows):
    check(priced(spark, rows, CONFIG), rows, nearest)


def test_sketch_is_exact_on_small_groups(spark):
    rows = shopping(4)
    frame = spark.createDataFrame(rows, SCHEMA).dropna(subset=["place", "trans_amount"])
    purchases = dist.count_purchases(frame, ["place"])
    sketched = dist.price_points(purchases, ["place"], SHARES, CONFIG.with_(method="approx"))
    exact = expected(rows, nearest)
    for row in sketched.collect():
        _, kept, low, high = exact[row.place]
        assert (row.low, row.high, row.n_band) == (low, high, len(kept))
        assert row.p50 == nearest([amount for _, amount in kept], 0.5)


def test_percentile_vector_runs_from_minimum_to_maximum(spark):
    rows = [("x", "c", float(i)) for i in range(1, 101)]
    purchases = dist.count_purchases(spark.createDataFrame(rows, SCHEMA), ["place"])
    row = dist.percentile_vector(purchases, ["place"]).first()
    assert len(row.percentiles) == 21
    assert row.percentiles[0] == row.min_cost == 1.0
    assert row.percentiles[-1] == row.max_cost == 100.0
    assert row.percentiles == [nearest([r[2] for r in rows], i / 20) for i in range(21)]


def test_removal_counts_add_up(spark):
    rows = spark.createDataFrame(shopping(6), SCHEMA)
    kept, removed = dist.remove_outliers(rows, ["place"], CONFIG)
    left = {r.place: r["count"] for r in kept.groupBy("place").count().collect()}
    for row in removed.collect():
        assert row.txn_before == row.txn_after + row.txn_removed
        assert left[row.place] == row.txn_after


@pytest.mark.parametrize("method, percentile", [("disc", nearest), ("cont", between)])
def test_one_group_of_all_distinct_amounts(spark, method, percentile):
    rng = random.Random(8)
    amounts = list({round(rng.lognormvariate(3, 2), 6) for _ in range(4000)}) + [0.0, -1.5, -70.25, -1.5001]
    rows = [("p", f"c{i % 900}", a) for i, a in enumerate(amounts)]
    found = priced(spark, rows, CONFIG.with_(method=method))["p"]
    low, high = percentile(amounts, 0.05), percentile(amounts, 0.98)
    kept = [a for a in amounts if low <= a <= high]
    assert (found.low, found.high) == pytest.approx((low, high), rel=1e-12)
    assert found.n_before == len(amounts) and found.n_band == len(kept) == found.transaction_count
    for name, share in SHARES.items():
        assert found[name] == pytest.approx(percentile(kept, share), rel=1e-12)


def test_no_task_ranks_a_group(spark):
    frame = spark.createDataFrame([("p", "c", 1.0)], SCHEMA)
    prices = dist.price_list(dist.count_purchases(frame, ["place"]), ["place"])
    plan = prices._jdf.queryExecution().executedPlan().toString()
    ranking = [line for line in plan.splitlines() if " Window [" in line and "trans_amount" in line]
    assert ranking and all("price_range" in line for line in ranking)


def test_price_ranges_never_fall():
    steps = [-1e9, -100.0, -1.01, -1.0, -1e-9, 0.0, 1e-9, 0.01, 0.999, 1.0, 1.02, 99.99, 1e9]
    ranges = [0 if x == 0 else int(np.sign(x) * (np.floor(np.log2(abs(x)) * 64) + (1 << 20))) for x in steps]
    assert ranges == sorted(ranges)


def test_refused_settings():
    for changes in ({"method": "median"}, {"daily_cap": 0}, {"trim": (0.0500000001, 0.98)}, {"trim": (-0.1, 0.98)}):
        with pytest.raises(ValueError):
            CONFIG.with_(**changes)
    # Sketches have weights.
    for changes in ({"daily_cap": 2}, {"snapshot_join": False}):
        assert CONFIG.with_(method="approx", **changes).method == "approx"
