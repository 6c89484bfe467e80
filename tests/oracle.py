"""Runs registered queries beside their SQL and compares rows.

    python tests/oracle.py [--sf sf0.01] [--only name ...] [--from name]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def differences(columns_a, rows_a, columns_b, rows_b) -> list[str]:
    """Empty when both hold the same columns and the same rows, in any order, doubles included."""
    if sorted(columns_a) != sorted(columns_b):
        return [f"columns differ: {sorted(set(columns_a) ^ set(columns_b))}"]
    order = sorted(columns_a)

    def count(columns, rows):
        at = [columns.index(name) for name in order]
        return Counter(tuple(_plain(row[i]) for i in at) for row in rows)

    a, b = count(list(columns_a), rows_a), count(list(columns_b), rows_b)
    if a == b:
        return []
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    shown = [f"rows {len(rows_a)} vs {len(rows_b)}, differing {len(only_a)} vs {len(only_b)}"]
    shown.append(str(order))
    shown += [f"  spark {row}" for row in sorted(only_a, key=repr)[:3]]
    shown += [f"  sql   {row}" for row in sorted(only_b, key=repr)[:3]]
    return shown


def main() -> int:
    from pyspark.sql import SparkSession

    from triptally.registry import ORACLES, QUERIES

    options = argparse.ArgumentParser()
    options.add_argument("--sf", default="sf0.01")
    options.add_argument("--only", nargs="*")
    options.add_argument("--since")
    options.add_argument("--until")
    options.add_argument("--sql-only", action="store_true")
    chosen = options.parse_args()
    names = chosen.only or list(QUERIES)
    if chosen.since:
        names = names[names.index(chosen.since):]
    if chosen.until:
        names = names[: names.index(chosen.until) + 1]
    folder = f"{DATA}/{chosen.sf}"
    db = connect(folder)
    spark = None
    if not chosen.sql_only:
        spark = (
            SparkSession.builder.master("local[8]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.session.timeZone", "UTC")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names:
        started = time.time()
        try:
            expected = db.sql(ORACLES[name])
            expected_columns, expected_rows = expected.columns, expected.fetchall()
            between = time.time()
            if spark is None:
                print(f"{name}: {len(expected_rows)} rows {between - started:.2f}s", flush=True)
                continue
            frame = QUERIES[name](spark, folder)
            rows = frame.collect()
            problems = differences(frame.columns, rows, expected_columns, expected_rows)
        except Exception as error:  # noqa: BLE001  (a report over many queries)
            problems, between = [f"{type(error).__name__}: {str(error)[:600]}"], time.time()
        if problems:
            failed.append(name)
            print(f"FAIL {name}", *problems, sep="\n    ", flush=True)
        else:
            print(f"ok   {name} {len(rows)} rows, {time.time() - between:.1f}s", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
