"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from triptally.registry import QUERIES

HEADLINE = (
    "state_accommodation", "state_attraction", "state_restaurant", "state_retail",
    "state_retail_cap", "division_accommodation", "division_retail_cap",
    "national_accommodation", "national_retail", "agg_all_categories", "state_basket_index",
    "county_basket_index", "retail_cap_test", "retail_cap_compare", "cap_sensitivity",
    "retail_filter_funnel", "all_levels",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("triptally-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="triptally-bench-"))
        .getOrCreate()
    )


def run(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, names[0], folder)
    # The better of two runs: the first one mostly measures class loading and compilation.
    seconds = {name: round(min(run(spark, name, folder) for _ in range(2)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
