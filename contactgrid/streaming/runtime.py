"""Sources and drains for streaming jobs over files in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactgrid.session import shared_folder
from contactgrid.sources.tables import SCHEMAS


def read_stream(
    spark: SparkSession, folder: str, table: str, files_per_batch: int = 100
) -> DataFrame:
    """Parquet files of a table as a stream; the trigger size bounds a micro-batch."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return (spark.readStream.schema(SCHEMAS[table])
            .option("pathGlobFilter", f"{table}.parquet")
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run an append-mode stream over everything available and read back what it wrote.

    The file sink commits each micro-batch once, also after a restart from the checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    query = (stream.writeStream.outputMode("append").format("parquet")
             .option("checkpointLocation", f"{folder}/checkpoint")
             .option("path", f"{folder}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
