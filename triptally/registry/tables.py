"""Sources and sinks. Sinks write to a fresh folder and return what was written, read back."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from triptally.config import ATTRACTION, CATEGORIES as ALL, RETAIL, CountyConfig
from triptally.operators import joins
from triptally.operators.filters import in_period
from triptally.operators.distribution import count_purchases, visitors
from triptally.operators.joins import COUNTY as COUNTY_LEVEL
from triptally.operators.joins import STATE
from triptally.plans.basket import basket_from_exports, basket_index
from triptally.plans.category import category_cost, visitor_rows, visitor_transactions
from triptally.plans.county import CATEGORIES, county_index
from triptally.registry import sql
from triptally.registry.base import EVERY_MONTH, PERIODS, WHOLE, query
from triptally.schemas import BASKET, COUNTY_INDEX, category_export
from triptally.session import fresh_folder
from triptally.sources import tables as readers
from triptally.sources import writers
from triptally.sources.publish import PublishedTable, append_to_catalog

RUN = ("calculation_timestamp",)


@query(
    "scan_parquet",
    sql.on_spend(
        """SELECT mtid, membccid, trans_date, trans_amount, trans_distance, ref_date, merch_desc, mcc,
  merch_type, merch_city, merch_state, merch_country FROM txn JOIN merch USING (mtid, ref_date)"""
    ),
)
def scan_parquet(t):
    folder = fresh_folder(t.spark, "spend")
    t.transactions.write.parquet(f"{folder}/transactions")
    writers.write_merchants(t.merchants, f"{folder}/merchants")
    read = readers.SpendTables.from_parquet(
        t.spark, f"{folder}/transactions", f"{folder}/merchants"
    )
    bought = read.transactions.drop("txid").join(read.merchants, ["mtid", "ref_date"])
    return bought.drop("z_country")


@query("scan_bridge", sql.on_spend("SELECT * FROM bridge"))
def scan_bridge(t):
    folder = fresh_folder(t.spark, "bridge")
    t.bridge.write.parquet(folder)
    return t.spark.read.parquet(folder)


@query(
    "scan_table",
    sql.on_spend(
        """SELECT merch_state, merch_type, merchants, coalesce(purchases, 0) AS purchases
FROM (SELECT merch_state, merch_type, count(*) AS merchants FROM merch GROUP BY ALL)
LEFT JOIN (SELECT merch_state, merch_type, count(*) AS purchases
  FROM txn JOIN merch USING (mtid, ref_date) GROUP BY ALL) USING (merch_state, merch_type)"""
    ),
)
def scan_table(t):
    t.transactions.createOrReplaceTempView("triptally_transactions")
    t.merchants.createOrReplaceTempView("triptally_merchants")
    read = readers.SpendTables.from_catalog(
        t.spark, "triptally_transactions", "triptally_merchants"
    )
    keys = ["merch_state", "merch_type"]
    known = read.merchants.groupBy(*keys).agg(F.count("*").alias("merchants"))
    per_merchant = read.transactions.groupBy("mtid", "ref_date").agg(F.count("*").alias("n"))
    bought = per_merchant.join(read.merchants, ["mtid", "ref_date"]).groupBy(*keys)
    counted = known.join(bought.agg(F.sum("n").alias("purchases")), keys, "left")
    return counted.withColumn("purchases", F.coalesce("purchases", F.lit(0)))


@query("scan_bridge_csv", sql.on_spend("SELECT * FROM bridge"))
def scan_bridge_csv(t):
    folder = fresh_folder(t.spark, "bridge-csv")
    header = ("State Name", "Abbreviation", "FIPS_code", "Census_Region", "Census_Region_Division")
    t.bridge.toDF(*header).write.option("header", True).csv(folder)
    return readers.read_bridge_csv(t.spark, folder)


def _two_periods(template) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({template(WHOLE.with_(start=start, end=end))})" for start, end in PERIODS
    )


@query("scan_csv_glob", _two_periods(lambda config: sql.category_cost(ATTRACTION, "state", config)))
def scan_csv_glob(t):
    folder = fresh_folder(t.spark, "exports")
    for start, end in PERIODS:
        result = category_cost(t, ATTRACTION, STATE, WHOLE.with_(start=start, end=end))
        writers.write_category_csv(result, folder, "attraction", "state", start, end)
    exports = readers.read_exports(t.spark, folder, category_export(ATTRACTION))
    return exports.drop("export_file", *RUN)


COUNTIES_SQL = sql.on_spend(
    """SELECT DISTINCT CAST(admin2_id AS VARCHAR) AS county_fips, admin2 AS county_name,
  admin1 AS state_name, admin1_abbr AS state_abbr
FROM geo WHERE country = 'United States' AND admin2_id IS NOT NULL"""
)


@query("scan_counties", COUNTIES_SQL)
def scan_counties(t):
    return joins.counties(t.geo_reference).orderBy(COUNTY_LEVEL.column)


@query("distinct_counties", COUNTIES_SQL)
def distinct_counties(t):
    return joins.counties(t.geo_reference)


@query("sink_category_csv", sql.category_cost(RETAIL, "state", WHOLE))
def sink_category_csv(t):
    path = writers.write_category_csv(
        category_cost(t, RETAIL, STATE, WHOLE), fresh_folder(t.spark, "results"),
        "retail", "state", WHOLE.start, WHOLE.end,
    )
    read = t.spark.read.schema(category_export(RETAIL)).option("header", True).csv(path)
    return read.drop(*RUN)


@query("sink_index_csv", sql.basket("SELECT * FROM idx", WHOLE))
def sink_index_csv(t):
    path = writers.write_index_csv(basket_index(t, WHOLE), fresh_folder(t.spark, "index"))
    return t.spark.read.schema(BASKET).option("header", True).csv(path)


# A first delivery from farther visitors only, and the later period calculated again from all of them.
_FIRST_RUN = WHOLE.with_(distance=100.0)
_SECOND_RUN = WHOLE.with_(start=PERIODS[1][0])


def _latest_run_sql() -> str:
    first, second = (sql.basket_ctes(config) for config in (_FIRST_RUN, _SECOND_RUN))
    early = f"month_date < DATE '{_SECOND_RUN.start}'"
    return f"""SELECT * FROM ({sql.on_spend(f"WITH {first} SELECT * FROM idx WHERE {early}")})
UNION ALL SELECT * FROM ({sql.on_spend(f"WITH {second} SELECT * FROM idx")})"""


@query("basket_from_exports", _latest_run_sql())
def basket_from_exports_(t):
    """Exported files of two runs that overlap, read together; the later run counts."""
    folder = fresh_folder(t.spark, "exports")
    for config in (_FIRST_RUN, _SECOND_RUN):
        for category in ALL:
            result = category_cost(t, category, STATE, config)
            writers.write_category_csv(
                result, f"{folder}/{category.name}", category.name, "state", config.start, config.end
            )
    exports = {
        c.name: readers.read_exports(t.spark, f"{folder}/{c.name}", category_export(c)) for c in ALL
    }
    return basket_from_exports(exports)


def _county_of(start: date, end: date) -> CountyConfig:
    return replace(EVERY_MONTH, index=EVERY_MONTH.index.with_(start=start, end=end))


@query("sink_append_schema", sql.county("SELECT * FROM county", EVERY_MONTH, CATEGORIES))
def sink_append_schema(t):
    """Two runs append to a catalog table, one of them twice; the table is read by its name."""
    folder = fresh_folder(t.spark, "county-index")
    name = f"county_index_{folder.rsplit('-', 1)[-1]}"
    for start, end in (*PERIODS, PERIODS[1]):
        result = county_index(t, _county_of(start, end))
        append_to_catalog(result, name, COUNTY_INDEX, f"{start}_{end}", folder)
    return t.spark.table(name).drop("created_at", "run_id")


@query(
    "sink_replace_month",
    f"""SELECT * EXCLUDE (period_start, period_end)
FROM ({sql.category_cost(ATTRACTION, 'state', WHOLE)}) WHERE month_date <> DATE '2000-05-01'""",
)
def sink_replace_month(t):
    """The last months are first published from an incomplete delivery, then processed again; one of
    them has no purchases any more."""
    schema = category_export(ATTRACTION)
    table = PublishedTable(t.spark, fresh_folder(t.spark, "monthly"), schema)
    late = date(2000, 1, 1)
    table.replace_months(category_cost(t, ATTRACTION, STATE, WHOLE.with_(end=date(1999, 12, 31))))
    table.replace_months(category_cost(t, ATTRACTION, STATE, WHOLE.with_(distance=100.0, start=late)))
    complete = category_cost(t, ATTRACTION, STATE, WHOLE.with_(start=late))
    complete = complete.filter(F.col("month_date") != F.lit(date(2000, 5, 1)))
    table.replace_months(complete, period=(late, WHOLE.end))
    return table.read().drop(*RUN, "period_start", "period_end")


@query(
    "sink_versions",
    f"""SELECT 1 AS version, * EXCLUDE (period_start, period_end)
FROM ({sql.category_cost(ATTRACTION, 'state', WHOLE.with_(distance=100.0))})
UNION ALL SELECT 2, * EXCLUDE (period_start, period_end)
FROM ({sql.category_cost(ATTRACTION, 'state', WHOLE)})""",
)
def sink_versions(t):
    """What was published stays readable by its version after a later run has replaced it."""
    schema = category_export(ATTRACTION)
    table = PublishedTable(t.spark, fresh_folder(t.spark, "versions"), schema)
    period = (WHOLE.start, WHOLE.end)
    for distance in (100.0, WHOLE.distance):
        result = category_cost(t, ATTRACTION, STATE, WHOLE.with_(distance=distance))
        table.replace_months(result, period=period)
    both = [table.read(v).select(F.lit(v).alias("version"), "*") for v in table.versions()]
    return both[0].unionByName(both[1]).drop(*RUN, "period_start", "period_end")


PRUNED = WHOLE.with_(ref_dates=(date(1996, 1, 1), date(1997, 1, 1)))


@query(
    "prune_ref_date",
    sql.on_spend(
        """SELECT ref_date, merch_state, count(*) AS purchases, count(DISTINCT mtid) AS merchants
FROM txn JOIN merch USING (mtid, ref_date)
WHERE trans_distance > 60 AND ref_date BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'
GROUP BY ALL"""
    ),
)
def prune_ref_date(t):
    folder = fresh_folder(t.spark, "merchants")
    writers.write_merchants(t.merchants, folder)
    stored = t.spark.read.parquet(folder).filter(in_period(*PRUNED.ref_dates, "ref_date"))
    rows = joins.with_merchants(visitor_transactions(t, PRUNED), stored)
    # Purchases per merchant first, so that a busy merchant is one row.
    per_merchant = rows.groupBy("ref_date", "merch_state", "mtid").agg(F.count("*").alias("n"))
    return per_merchant.groupBy("ref_date", "merch_state").agg(
        F.sum("n").alias("purchases"), F.count("*").alias("merchants")
    )


@query(
    "prune_by_join",
    sql.on_spend(
        f"""WITH base AS ({sql.rows([ATTRACTION], "state", WHOLE)})
SELECT merch_state, month_date, count(*) AS transaction_count,
  count(DISTINCT membccid) AS unique_visitors
FROM base WHERE year(trans_date) % 3 = 0 GROUP BY ALL"""
    ),
)
def prune_by_join(t):
    """Visitors at the snapshots of every third release; the tables are read at these only."""
    tables, releases = stored_by_snapshot(t)
    rows = visitor_rows(tables.at_releases(releases.filter("revision % 3 = 0")), [ATTRACTION], STATE, WHOLE)
    keys = ["merch_state", "month_date"]
    return visitors(count_purchases(rows, keys), keys)


def stored_by_snapshot(t):
    """Transactions, merchants and the list of releases, stored by ref_date."""
    folder = fresh_folder(t.spark, "snapshots")
    writers.write_transactions(t.transactions, f"{folder}/transactions")
    writers.write_merchants(t.merchants, f"{folder}/merchants")
    revisions = t.spark.read.parquet(f"{folder}/merchants").select("ref_date").distinct()
    revisions.withColumn("revision", F.year("ref_date")).write.parquet(f"{folder}/releases")
    tables = readers.SpendTables.from_parquet(t.spark, f"{folder}/transactions", f"{folder}/merchants")
    return tables, t.spark.read.parquet(f"{folder}/releases")
