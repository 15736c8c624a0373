"""Address lists in plain text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.functions.text import strip_space
from contactgrid.session import materialize

MAX_LINE_LENGTH = 2048


def read_address_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines of text files with a dense position (`line_index`).

    Position follows file name and place in the file. A task reads blocks of files in order, so the
    increasing ids it gives fix the place inside a block; blocks are placed by their line counts.
    """
    block = ["file", "block"]
    lines = materialize(spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id")))
    sizes = lines.groupBy(*block).agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = F.sum("lines").over(Window.orderBy(*block)) - F.col("lines")  # one row a block
    numbered = lines.join(sizes.withColumn("before", before).drop("lines"), block).withColumn(
        "line_index", F.col("before") + F.col("id") - F.col("first"))
    text = strip_space(F.col("line"))
    kept = numbered.withColumns({"original_input": text, "line_length": F.length("line")}).filter(
        F.col("original_input") != "")
    return kept.select("line_index", "line_length", "original_input")


def list_violations(lines: DataFrame, max_inputs: int) -> DataFrame:
    """One row of limits that a list breaks; empty when the list may be processed."""
    summary = lines.agg(
        F.count(F.lit(1)).alias("inputs"),
        F.min(F.when(F.col("line_length") > MAX_LINE_LENGTH, F.col("line_index"))).alias("long"))
    found = F.array_compact(F.array(
        F.when(F.col("long").isNotNull(), F.struct(
            F.lit("LINE_TOO_LONG").alias("violation"), F.col("long").alias("detail"))),
        F.when(F.col("inputs") > max_inputs, F.struct(
            F.lit("TOO_MANY_INPUTS").alias("violation"), F.col("inputs").alias("detail")))))
    return summary.select(F.inline(found))
