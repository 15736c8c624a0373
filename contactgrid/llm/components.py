"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.llm.storage import Workspace


def connected_components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) that is not its component's smallest.

    Every round is a few joins and groupings whose table is written to shared storage; nothing of
    the graph reaches the driver but a count and a checksum. A hub's neighbours are reduced to
    their minimum before the shuffle, and its rows in the join are left to skew splitting.
    """
    now = work.keep(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.where("b > a").join(low, "a").select(
            F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
        large = work.keep(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b != low").select(
            F.col("b").alias("a"), F.col("low").alias("b"))
        after = work.keep(small.union(low).distinct(), "small-star")
        work.drop(now, large)
        now = after
