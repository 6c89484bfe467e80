"""What the physical plans must look like."""

from __future__ import annotations

from datetime import date

import pytest

from triptally.config import ACCOMMODATION, CATEGORIES, RETAIL, IndexConfig
from triptally.operators.joins import STATE
from triptally.plans.category import category_cost, category_costs
from triptally.registry import QUERIES
from triptally.sources import writers
from triptally.sources.spend_view import SpendView
from triptally.sources.tables import SpendTables

DATA = "/root/testdata/sf0.001"
YEAR = IndexConfig(date(1996, 1, 1), date(1996, 12, 31), sample_exclude=2, sample_rolling=5)


def executed(frame) -> str:
    """The final plan of adaptive execution."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def scan_nodes(frame, table: str) -> list[str]:
    """Every scan of a table in the executed plan, subqueries included; what is reused counts once."""
    frame.collect()
    found = []

    def visit(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            visit(node.plan())
        elif not kind.startswith("Reused"):
            if kind == "FileSourceScanExec" and table in node.toString():
                found.append(node.toString())
            for part in (node.children(), node.subqueries()):
                for i in range(part.size()):
                    visit(part.apply(i))

    visit(frame._jdf.queryExecution().executedPlan())
    return found


def scans(frame, table: str) -> int:
    return len(scan_nodes(frame, table))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("spend"))
    view = SpendView(spark, DATA)
    view.transactions.write.parquet(f"{folder}/transactions")
    writers.write_merchants(view.merchants, f"{folder}/merchants")
    return SpendTables.from_parquet(spark, f"{folder}/transactions", f"{folder}/merchants")


@pytest.mark.parametrize("config", [YEAR, YEAR.with_(daily_cap=2), YEAR.with_(method="cont")])
def test_one_scan_of_the_transactions(stored, config):
    lazy = config.with_(stage=False)
    for frame in (
        category_cost(stored, RETAIL, STATE, lazy),
        category_costs(stored, CATEGORIES, STATE, lazy),
    ):
        assert scans(frame, "/transactions]") == 1
    # Staged, the transactions are read once while writing and never again.
    assert "/transactions]" not in executed(category_cost(stored, RETAIL, STATE, config))


@pytest.mark.parametrize(
    "name",
    ["state_basket_index", "national_basket_index", "county_basket_index", "retail_cap_test",
     "retail_cap_compare", "cap_sensitivity", "retail_filter_funnel", "all_levels", "join_basket",
     "union_by_name", "scalar_subquery_band", "agg_capping_impact_state", "agg_lodging_adr",
     "agg_cardday_median", "agg_outlier_report"],
)
def test_one_scan_behind_composed_results(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert scans(frame, "lineitem.parquet") <= 1
    assert scans(frame, "events.parquet") <= 1


def test_filters_and_columns_reach_the_scan(stored):
    plan = executed(category_cost(stored, ACCOMMODATION, STATE, YEAR.with_(stage=False)))
    scan = next(line for line in plan.splitlines() if "/transactions]" in line)
    for pushed in (
        "GreaterThanOrEqual(trans_date,1996-01-01)",
        "LessThanOrEqual(trans_date,1996-12-31)",
        "GreaterThan(trans_distance,60.0)",
        "GreaterThanOrEqual(trans_amount,50.0)",
    ):
        assert pushed in scan
    assert "txid" not in scan.split("ReadSchema")[1]


def test_snapshots_are_pruned(stored):
    config = YEAR.with_(ref_dates=(date(1996, 1, 1), date(1996, 1, 1)), stage=False)
    plan = executed(category_cost(stored, RETAIL, STATE, config))
    scan = next(line for line in plan.splitlines() if "/merchants]" in line)
    assert "ref_date" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_python_and_no_cross_joins(spark):
    for name in ("county_basket_index", "state_retail_cap", "geo_comparison", "cap_sensitivity"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas"):
            assert operator not in plan, (name, operator)


def test_top_of_day_is_cut_before_the_shuffle(spark):
    plan = QUERIES["flt_rank_cap"](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_joins_prune_partitions(spark):
    """The dates of the chosen releases reach both scans while the join runs."""
    from triptally.plans.category import visitor_rows
    from triptally.registry.tables import stored_by_snapshot

    tables, releases = stored_by_snapshot(SpendView(spark, DATA))
    chosen = tables.at_releases(releases.filter("revision % 3 = 0"))
    rows = visitor_rows(chosen, [RETAIL], STATE, IndexConfig(date(1990, 1, 1), date(2010, 1, 1)))
    for table in ("/transactions", "/merchants"):
        found = scan_nodes(rows, f"{table}]")
        assert found and all("dynamicpruning" in x.split("PartitionFilters: [")[1] for x in found), found
    years = {r.ref_date.year for r in chosen.merchants.select("ref_date").distinct().collect()}
    assert years and all(year % 3 == 0 for year in years)


def test_stored_buckets_join_without_a_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from triptally.plans.category import visitor_rows
    from triptally.sources.writers import write_bucketed

    view = SpendView(spark, DATA)
    for kind in ("transactions", "merchants"):
        write_bucketed(getattr(view, kind), f"bucketed_{kind}", 8, str(tmp_path / kind))
    stored = SpendTables.from_catalog(spark, "bucketed_transactions", "bucketed_merchants")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = visitor_rows(stored, [RETAIL], STATE, YEAR)
        plan = executed(rows)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        # The whole category: the only shuffles are those of the counts.
        lazy = executed(category_cost(stored, RETAIL, STATE, YEAR.with_(stage=False)))
        assert not [x for x in lazy.splitlines() if "Exchange hashpartitioning(mtid" in x]
        loose = visitor_rows(SpendTables(view.transactions, view.merchants), [RETAIL], STATE, YEAR)
        assert "Exchange hashpartitioning(mtid" in executed(loose)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows.agg(F.sum("trans_amount")).first()[0] == pytest.approx(loose.agg(F.sum("trans_amount")).first()[0])
    for kind in ("transactions", "merchants"):
        spark.sql(f"DROP TABLE bucketed_{kind}")
