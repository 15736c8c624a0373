"""Session defaults for the engine and the shared folder for reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # skewed join partitions are split even when that costs a later shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows are wide: smaller read splits keep a task's working set bounded
    "spark.sql.files.maxPartitionBytes": "134217728",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """Session with the recommended settings; `settings` use `__` for dots and win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    overrides = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**RECOMMENDED, **overrides}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark application.

    Functions that run in tasks refer to it, and executors need not have it installed: the zip
    goes out over Spark's own distribution of files.
    """
    context = spark.sparkContext
    if hasattr(context, "_shipped_package"):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.TemporaryDirectory()  # the driver's own; Spark serves the file from here
    path = os.path.join(folder.name, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for place, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(place, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._shipped_package = folder  # goes with the context


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in `spark.checkpoint.dir`.

    Where that is unset, the SQL warehouse, which executors share as well, holds it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        f"{spark.conf.get('spark.sql.warehouse.dir')}/_work")
    return f"{base}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to shared storage and continue from the written table.

    For a small result of a large scan that several branches of a plan need: the scan runs once,
    the lineage ends at files that outlive executors, and later reads prune columns.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
