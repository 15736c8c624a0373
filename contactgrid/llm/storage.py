"""Tables written once to the shared folder, and their removal."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from contactgrid.session import shared_folder, ship_package


class Workspace:
    """A run's tables below the cluster's shared folder.

    A written table ends the lineage: a lost executor costs its running tasks and nothing before
    the table. `drop` removes a table that no later step reads, to give its disk back.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.folder = shared_folder(spark)
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.folder}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and continue from the written table."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.path = path
        return kept

    def release(self) -> None:
        """Let Spark remove the shuffle files of steps that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove_folder(self.spark, table.path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(jvm_path, True)
