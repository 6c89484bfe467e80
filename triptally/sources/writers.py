"""Writers. All rows are written by the executors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptally.session import fresh_folder


def keep(result: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and returns the written table.

    For results used several times: later steps read the table instead of recomputing it, and a
    lost executor costs no more than the running step.
    """
    folder = fresh_folder(result.sparkSession, name)
    result.write.parquet(folder)
    return result.sparkSession.read.schema(result.schema).parquet(folder)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever the tables lie."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def export_name(category: str, level: str, start: date, end: date) -> str:
    return f"{category}_{level}_results_{start:%Y%m%d}_{end:%Y%m%d}.csv"


def write_category_csv(
    result: DataFrame, folder: str, category: str, level: str, start: date, end: date
) -> str:
    """Writes a category result as a CSV folder named after category, level and period."""
    path = f"{folder}/{export_name(category, level, start, end)}"
    result.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_index_csv(index: DataFrame, path: str) -> str:
    index.write.mode("overwrite").option("header", True).csv(path)
    return path


def conform(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts to the schema's columns and types; a null in a required column fails the write."""

    def column(field: T.StructField):
        value = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            message = F.raise_error(F.lit(f"{field.name} must not be null"))
            value = F.when(value.isNotNull(), value).otherwise(message)
        return value.alias(field.name)

    return frame.select(*[column(field) for field in schema])


def write_merchants(merchants: DataFrame, path: str) -> None:
    """Merchant snapshots, partitioned so that a run reads only the snapshots it joins. The
    rebalance gathers each snapshot into few files and splits one that is too large for a task."""
    merchants.hint("rebalance", "ref_date").write.mode("overwrite").partitionBy("ref_date").parquet(path)


def write_transactions(transactions: DataFrame, path: str) -> None:
    """Transactions by snapshot, as `write_merchants` stores merchants."""
    transactions.hint("rebalance", "ref_date").write.mode("overwrite").partitionBy("ref_date").parquet(path)


def write_bucketed(
    frame: DataFrame, name: str, buckets: int, path: str | None = None,
    keys: tuple[str, ...] = ("mtid", "ref_date"),
) -> None:
    """A catalog table whose rows lie in buckets by `keys`. Tables with equally many buckets of the same
    keys join bucket by bucket, without a shuffle; one file a bucket is written here."""
    writer = frame.repartition(buckets, *keys).write.mode("overwrite")
    writer = writer.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
