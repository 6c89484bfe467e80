"""Reading the given tables, and tables written between the steps of one operator."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from triptally.session import fresh_folder


def unused(columns: list[str], name: str) -> str:
    """The name, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields(frame: DataFrame) -> str:
    """The columns of a frame as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Steps:
    """Tables between the steps of one run, in the folder all executors share.

    Each step reads what the one before has written: a lost executor costs no more than the step
    that runs, and no plan is computed twice. `drop` deletes what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = fresh_folder(spark, name)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete shuffle files of finished steps: it does so when the driver collects
        its garbage, which a driver with free memory would not do for a long time."""
        gc.collect()
        self.spark._jvm.System.gc()
