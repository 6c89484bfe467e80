"""Readers. Parquet schemas come from the file footers, CSV schemas are always given."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptally.schemas import REGION_BRIDGE


@dataclass(frozen=True)
class SpendTables:
    """The input tables of a run; only transactions and merchants are always needed."""

    transactions: DataFrame
    merchants: DataFrame
    bridge: DataFrame | None = None
    geo_reference: DataFrame | None = None
    lodging: DataFrame | None = None

    @staticmethod
    def from_parquet(
        spark: SparkSession,
        transactions: str,
        merchants: str,
        bridge: str | None = None,
        geo_reference: str | None = None,
        lodging: str | None = None,
    ) -> SpendTables:
        def read(path: str | None) -> DataFrame | None:
            return spark.read.parquet(path) if path else None

        return SpendTables(
            read_transactions(spark, transactions),
            spark.read.parquet(merchants),
            read(bridge),
            read(geo_reference),
            read(lodging),
        )

    @staticmethod
    def from_catalog(
        spark: SparkSession,
        transactions: str,
        merchants: str,
        bridge: str | None = None,
        geo_reference: str | None = None,
        lodging: str | None = None,
    ) -> SpendTables:
        def table(name: str | None) -> DataFrame | None:
            return spark.table(name) if name else None

        return SpendTables(
            amounts_as_double(spark.table(transactions)),
            spark.table(merchants),
            table(bridge),
            table(geo_reference),
            table(lodging),
        )

    def at_releases(self, releases: DataFrame, most: int = 10_000) -> SpendTables:
        """Both tables reduced to the snapshots that `releases` has rows for.

        The dates are joined, so tables stored by ref_date are read in part only, whatever condition
        picked the releases: the join prunes their partitions while it runs. Snapshot dates are few;
        up to `most` of them, counted here, are broadcast.
        """
        chosen = releases.select("ref_date").distinct()
        if chosen.count() <= most:
            chosen = F.broadcast(chosen)
        return replace(
            self, transactions=self.transactions.join(chosen, "ref_date"),
            merchants=self.merchants.join(chosen, "ref_date"),
        )


def amounts_as_double(transactions: DataFrame) -> DataFrame:
    """Amounts may be stored as FLOAT; everything downstream computes in DOUBLE."""
    floats = [
        field.name for field in transactions.schema if isinstance(field.dataType, T.FloatType)
    ]
    return transactions.withColumns({name: F.col(name).cast("double") for name in floats})


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return amounts_as_double(spark.read.parquet(path))


def read_bridge_csv(spark: SparkSession, path: str) -> DataFrame:
    """State to census division, from a CSV with a header of its own; codes keep leading zeros."""
    names = REGION_BRIDGE.fieldNames()
    raw = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(raw).option("header", True).option("enforceSchema", True).csv(path)


def read_exports(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All CSV exports of a category, with the file each row came from in `export_file`."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    return rows.select("*", F.col("_metadata.file_path").alias("export_file"))
