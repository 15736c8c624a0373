"""Nearest neighbours through balanced posting lists.

1. Centroids come from a bounded sample, halved again and again across its main direction, so that
   every list starts with about as many sample vectors. They form an in-memory graph; its size is
   bounded by the sample, so every task holds it.
2. Every vector goes to its nearest list, and, if it lies near a border, to up to `COPIES` in all:
   lists within `BORDER` times the nearest distance, unless a chosen centroid is closer to theirs
   than `APART` times the vector is. More copies would only save probes; no vector is left out.
3. A query reads the lists whose centroid is within `PROBE` times the distance of the nearest one
   (and the nearest `LEAST_LISTS`), found by a best-first walk over the graph.
4. Lists are stored in blocks of at most about `BLOCK_ROWS` vectors, and so are the queries of a
   list; a unit of work is one block of each. Distances are Euclidean, in double precision, on the
   original vectors.

Equal vectors are indexed once, with their smallest ids: as many as a result can hold, and one more
for the query's own. That drops no possible result, and a vector that a third of all rows share
costs one entry.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do those of another length than the most common one (ties: the shorter); a null id takes no
part; rows of the same id are one candidate a vector, and never their own neighbour; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace

SAMPLE_ROWS = 20_000
LIST_SAMPLE = 24
LINKS = 24
WIDTH = 8
BORDER = 1.12
COPIES = 6
APART = 0.5
PROBE = 1.17
LEAST_LISTS = 12
BLOCK_ROWS = 2000
QUERY_EVERY = 100
NEIGHBOURS = 10


def split_balanced(points: np.ndarray, size: int) -> np.ndarray:
    """Centroids of parts of about equal cardinality, at most `size` points each."""
    found, waiting = [], [points]
    while waiting:
        part = waiting.pop()
        if len(part) <= size:
            found.append(part.mean(0))
            continue
        middle = part.mean(0)
        direction = part[np.square(part - middle).sum(1).argmax()] - middle
        for _ in range(5):  # towards the main axis
            direction = (part - middle).T @ ((part - middle) @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = np.argsort((part - middle) @ direction, kind="stable")
        half = len(part) // 2
        waiting += [part[order[half:]], part[order[:half]]]
    return np.array(found)


class CentroidGraph:
    """Centroids linked to their nearest others, and evenly spread entry points."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count = len(centroids)
        links = min(LINKS, count - 1)
        near = np.zeros((count, links + 1), np.int64)
        for start in range(0, count, 256):
            part = centroids[start:start + 256]
            distance = np.square(part[:, None] - centroids[None]).sum(2)
            near[start:start + 256] = np.argsort(distance, axis=1, kind="stable")[:, :links + 1]
        # the entry itself may come anywhere among equal centroids; a link to it does no harm
        self.links = near
        self.entries = np.unique(np.linspace(0, count - 1, min(count, 16)).astype(np.int64))

    def search(self, vectors: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each vector and their distances, best first.

        Every round follows the links of each vector's `WIDTH` best centroids not yet followed; a
        vector is done when none of those is among its `wanted` best.
        """
        count, total = len(vectors), len(self.centroids)
        wanted = min(wanted, total)
        distance = np.full((count, total), np.inf)
        followed = np.zeros((count, total), bool)
        rows = np.repeat(np.arange(count), len(self.entries))
        nodes = np.tile(self.entries, count)
        active = np.arange(count)
        while len(rows):
            distance[rows, nodes] = np.sqrt(np.square(
                vectors[rows] - self.centroids[nodes]).sum(1))
            open_ = np.where(followed[active], np.inf, distance[active])
            width = min(WIDTH, total)
            best = np.argpartition(open_, width - 1, axis=1)[:, :width]
            reach = np.partition(distance[active], wanted - 1, axis=1)[:, wanted - 1]
            use = np.take_along_axis(open_, best, 1)
            use = np.isfinite(use) & (use <= reach[:, None])
            active, best, use = active[use.any(1)], best[use.any(1)], use[use.any(1)]
            from_, place = np.nonzero(use)
            followed[active[from_], best[from_, place]] = True
            keys = np.unique((active[from_, None] * total + self.links[best[from_, place]]).ravel())
            rows, nodes = keys // total, keys % total
            new = ~np.isfinite(distance[rows, nodes])
            rows, nodes = rows[new], nodes[new]
            if not len(rows) and len(active):  # nothing new: go on with the next best known
                rows, nodes = active[:1], distance[active[:1]].argmin(1)
        order = np.argsort(distance, axis=1, kind="stable")[:, :wanted]
        return order, np.take_along_axis(distance, order, 1)

    def lists_to_store(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list, and border lists no chosen one makes redundant."""
        order, distance = self.search(vectors, COPIES * 2)
        chosen = np.zeros(order.shape, bool)
        chosen[:, 0] = True
        for place in range(1, order.shape[1]):
            near = (distance[:, place] <= distance[:, 0] * BORDER) & (chosen.sum(1) < COPIES)
            for earlier in range(place):
                apart = np.sqrt(np.square(self.centroids[order[:, place]]
                                          - self.centroids[order[:, earlier]]).sum(1))
                near &= ~chosen[:, earlier] | (apart >= distance[:, place] * APART)
            chosen[:, place] = near
        row, place = np.nonzero(chosen)
        return row, order[row, place]

    def lists_to_read(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs of the lists a query reads; widened until the ratio ends them."""
        wanted = 64
        while True:
            order, distance = self.search(vectors, wanted)
            use = distance <= distance[:, :1] * PROBE
            if wanted >= len(self.centroids) or not use[:, -1].any():
                break
            wanted *= 2
        use[:, :LEAST_LISTS] = True
        row, place = np.nonzero(use)
        return row, order[row, place]


def usable(table: DataFrame, vector: str) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part."""
    rows = table.select("vec_id", F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (length.n if length else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def assign(vectors: DataFrame, graph: CentroidGraph, reading: bool) -> DataFrame:
    """first, tag, vec, list: `vectors` once for each list they are stored in, or read."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = graph.lists_to_read if reading else graph.lists_to_store
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                row, chosen = choose(matrix(part.column(2)))
                taken = part.take(pa.array(row))
                yield pa.record_batch([*taken.columns, pa.array(chosen, pa.int32())],
                                      names=["first", "tag", "vec", "list"])

    return vectors.select("first", "tag", "vec").mapInArrow(
        pick, "first long, tag long, vec array<double>, list int")


def blocked(lists: DataFrame, own: str, other: str, mine: np.ndarray,
            theirs: np.ndarray) -> DataFrame:
    """`lists` with its own block, once for each block of the other side of its list."""
    block = F.pmod(F.xxhash64("first", "tag"), F.get(F.lit(mine.tolist()), F.col("list")))
    others = F.get(F.lit(theirs.tolist()), F.col("list"))
    return lists.where(others > 0).withColumn(own, block.cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), (others - 1).cast("int"))))


def nearest_vectors(queries: DataFrame, vectors: DataFrame, graph: CentroidGraph,
                    wanted: int, work: Workspace) -> DataFrame:
    """q_first, q_tag, first, tag, score: the `wanted` nearest distinct vectors of each query."""
    stored = work.keep(assign(vectors, graph, False), "lists")
    read = work.keep(assign(queries, graph, True), "probes")

    def blocks(table: DataFrame) -> np.ndarray:
        found = np.zeros(len(graph.centroids), np.int64)
        for row in table.groupBy("list").count().collect():  # one row a centroid
            found[row.list] = -(-row["count"] // BLOCK_ROWS)
        return found

    mine, theirs = blocks(stored), blocks(read)
    right = blocked(stored, "v_block", "q_block", mine, theirs)
    left = blocked(read, "q_block", "v_block", theirs, mine)

    def score(asked: pa.Table, listed: pa.Table) -> pa.Table:
        parts = []
        if asked.num_rows and listed.num_rows:
            points = matrix(listed["vec"])
            first = listed["first"].to_numpy()
            keep = min(wanted, len(points))
            sought = matrix(asked["vec"])
            step = max(1, 4_000_000 // points.size)
            for start in range(0, len(sought), step):
                distance = np.sqrt(np.square(
                    sought[start:start + step, None] - points[None]).sum(2))
                order = np.lexsort((np.broadcast_to(first, distance.shape), distance),
                                   axis=1)[:, :keep]
                row = np.repeat(np.arange(len(order)) + start, keep)
                parts.append((row, order.ravel(), np.take_along_axis(distance, order, 1).ravel()))
        row, place, values = ((np.concatenate(part) for part in zip(*parts, strict=True)) if parts
                              else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        return pa.table({
            "q_first": asked["first"].take(row), "q_tag": asked["tag"].take(row),
            "first": listed["first"].take(place), "tag": listed["tag"].take(place),
            "score": values})

    key = ["list", "v_block", "q_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        score, "q_first long, q_tag long, first long, tag long, score double")
    best = Window.partitionBy("q_first", "q_tag").orderBy("score", "first", "tag")
    return found.distinct().withColumn("place", F.row_number().over(best)).where(
        F.col("place") <= wanted).drop("place")


def nearest_rows(table: DataFrame, vector: str, every: int, wanted: int,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    work = Workspace(spark)
    rows = work.keep(usable(table, vector).distinct(), "usable")
    asked = F.col("vec_id") % every == 0
    tag = F.xxhash64("vec")
    distinct = work.keep(rows.groupBy("vec").agg(
        F.min("vec_id").alias("first"), F.max(asked).alias("asked")).withColumn("tag", tag),
        "distinct")
    sample = distinct.orderBy("tag", "first").limit(sample_rows).select("vec").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    graph = CentroidGraph(split_balanced(matrix(sample["vec"]), LIST_SAMPLE))
    near = work.keep(nearest_vectors(distinct.where("asked"), distinct, graph, wanted + 1, work),
                     "near")
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    ids = (rows.withColumn("place", F.dense_rank().over(smallest))
           .where(F.col("place") <= wanted + 1).withColumn("tag", tag)
           .withColumn("first", F.min("vec_id").over(Window.partitionBy("vec")))
           .select("first", "tag", "vec_id").distinct())
    best = Window.partitionBy("q_first", "q_tag").orderBy("score", "vec_id")
    listed = near.join(ids, ["first", "tag"]).select(
        "q_first", "q_tag", "vec_id", "score").withColumn(
            "place", F.row_number().over(best)).where(F.col("place") <= wanted + 1)
    queries = rows.where(asked).select(F.col("vec_id").alias("query_id"), "vec").join(
        distinct.where("asked").select("vec", F.col("first").alias("q_first"),
                                       F.col("tag").alias("q_tag")), "vec").drop("vec")
    final = Window.partitionBy("query_id", "q_tag").orderBy("place")
    return (queries.join(listed, ["q_first", "q_tag"]).where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= wanted)
            .select("query_id", "rank", "vec_id", "score"))


@register("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_rows(table, "embedding", QUERY_EVERY, NEIGHBOURS)
