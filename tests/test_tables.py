"""The derived spend tables, sinks and orders of results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triptally.config import PRICE_BUCKETS
from triptally.functions.scalars import price_bucket, price_bucket_order
from triptally.plans.cap_test import price_distribution
from triptally.registry import QUERIES
from triptally.sources.spend_view import SCHEMAS, SpendView

DATA = "/root/testdata/sf0.001"


def test_years_and_codes_come_from_the_tables(spark, tmp_path):
    """Orders of later years and parts of larger sizes keep their merchants."""
    for name in SCHEMAS:
        table = spark.read.schema(SCHEMAS[name]).parquet(f"{DATA}/{name}.parquet")
        if name == "orders":
            table = table.withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 4 years"))
        if name == "part":
            table = table.withColumn("p_size", F.col("p_size") + 50)
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    view = SpendView(spark, str(tmp_path))
    joined = view.transactions.join(view.merchants, ["mtid", "ref_date"])
    assert joined.count() == view.transactions.count() > 0
    assert joined.agg(F.max("trans_date")).first()[0].year >= 2004


def test_price_buckets_and_their_order(spark):
    prices = [10.0, 49.99, 50.0, 99.0, 100.0, 150.0, 199.99, 200.0, 299.0, 300.0, 5000.0]
    report = spark.createDataFrame([(p, 1.0) for p in reversed(prices)], "median_retail_txn double, pct_txn_capped double")
    rows = price_distribution(report).collect()
    assert [r.median_retail_bucket for r in rows] == [label for label, _ in PRICE_BUCKETS]
    assert [r.num_states for r in rows] == [2, 2, 1, 2, 2, 2]
    one = report.select(price_bucket(F.col("median_retail_txn")).alias("b")).select(price_bucket_order(F.col("b")).alias("o"))
    assert {r.o for r in one.collect()} == set(range(1, 7))


@pytest.mark.parametrize("name, order", [
    ("state_retail", lambda r: (r.month_date, -r.transaction_count, r.merch_state)),
    ("retail_cap_test", lambda r: r.state_abbr),
    ("retail_cap_compare", lambda r: (-abs(r.pct_change), r.merch_state, r.month_date)),
    ("topk_desc", lambda r: (-r.median_retail_txn, r.state_abbr)),
    ("topk_asc", lambda r: (r.median_retail_txn, r.state_abbr)),
    ("scan_counties", lambda r: r.county_fips),
    ("national_basket_index", lambda r: (r.geography_level, r.month_date)),
])
def test_results_come_in_order(spark, name, order):
    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) > 1 and rows == sorted(rows, key=order)
