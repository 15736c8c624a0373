"""Similarity join of word-shingle sets, through R-trees of count vectors.

Two documents link if the Jaccard similarity of their sets of shingles (A-Z lower-cased words) is at
least `TENTHS` tenths. The join is exact, but for equal 64-bit hashes of different shingles.

Method. A set's shingles are hashed into groups; the counts of the groups are a point. Two sets
share at most the sum of the smaller counts, so an R-tree over points, whose entries hold the
largest count of each group below them and the range of sizes, drops two entries as soon as that sum
cannot reach the overlap that the threshold asks for. Pairs of points that survive are verified on
their whole sets.

Which points meet in a tree. All sets are put in one order of shingles; similar sets share one of
their first n - ceil(n * tenths / 10) + 1 shingles (the prefix). A tree is built for every shingle
that stands in the prefixes of different sets; of a pair, the smaller set must have it among its
first n - ceil(n * 2 * tenths / (10 + tenths)) + 1 even (where it is indexed). The order starts with the rare shingles: at most
`COMMON` very frequent ones, found by counting, come last, so that passages that many documents
share do not bring unrelated documents together. Trees are kept apart by class of size: a set is
native to its class and a guest in the next one, which holds every larger set it can be similar to.

Only links between different components matter, so pairs are sought in rounds. A spanning round
takes from each tree a forest of surviving pairs between components, best bounds first; links found
are contracted, and trees without such pairs are done. The first round takes `FIRST_TREES` trees of
each point, the second one all, and the last one verifies all pairs between components that still
survive. Equal sets are one point; trees of the same
points are built once; texts are sent to comparisons, not to trees. A tree of more than `NODE_ROWS`
points is cut into parts, in the last round into all pairs of parts.

Edge cases: a null, empty or blank text has the empty set, which links with nothing; with fewer
words than a shingle has, all of them are one shingle; equal rows link; a null doc_id links, and a
component of null ids only has a null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.llm.components import connected_components
from contactgrid.llm.queries import register
from contactgrid.llm.simhash import representatives
from contactgrid.llm.storage import Workspace
from contactgrid.llm.wordhash import shingle_sets
from contactgrid.sources.tables import read_table

SHINGLE = 5
TENTHS = 8
#: Frequent shingles that come last in the order; only the order depends on them.
COMMON = 1 << 16
COMMON_DOCS = 64
#: Shingles that a counting task holds before it sums them up.
COUNTED = 1 << 21
#: Points of a part of a tree, entries below an entry, and bytes of counts compared at once.
NODE_ROWS = 1 << 11
FAN = 8
COMPARED = 1 << 22
#: Pairs of texts that are verified at once.
COMPARED_PAIRS = 256
#: Trees that each point enters in the first round.
FIRST_TREES = 2
#: Bounds of the number of groups, which is the least size of a class: with so many, two sets must
#: be nearly as similar as the threshold asks for to survive.
MIN_GROUPS, MAX_GROUPS = 16, 1 << 13
#: Most texts that are fetched by a broadcast of their names (24 bytes each).
BROADCAST_ROWS = 1 << 18
#: Most links whose components one task finds.
TASK_EDGES = 1 << 18


def prefix_length(size: int, tenths: int) -> int:
    """Leading members of which two similar sets share one."""
    return size - -(-size * tenths // 10) + 1 if size else 0


def indexed_length(size: int, tenths: int) -> int:
    """Leading members of which the smaller of two similar sets has one that both lead with."""
    return size - -(-size * 2 * tenths // (10 + tenths)) + 1 if size else 0


def levels_of(size: int, tenths: int) -> range:
    """Octaves of size of a set and of larger sets similar to it; the first is its own."""
    return range(size.bit_length() - 1, (size * 10 // tenths).bit_length())


def groups_of(level: int) -> int:
    """Number of groups in an octave of sizes."""
    return min(MAX_GROUPS, max(MIN_GROUPS, 1 << level))


def count_vector(hashes: np.ndarray, groups: int) -> bytes:
    """Counts of the groups, 255 at most; what is above counts as able to match anything."""
    counts = np.bincount((hashes % np.uint64(groups)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The most frequent shingles, at most `COMMON`, sorted; they only choose the order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = 0

        def summed():
            found = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            times = np.diff(np.r_[first, len(found)])
            found, times = found[first[times > 1]], times[times > 1]
            names, place = np.unique(np.r_[many[0], found], return_inverse=True)
            return names, np.bincount(place, np.r_[many[1], times], len(names)).astype(np.int64)

        for batch in batches:
            for found in shingle_sets(batch.column(0).cast(pa.binary()).to_pylist(), shingle):
                waiting.append(found)
                rows += len(found)
                if rows > COUNTED:
                    many = summed()
                    waiting, rows = [], 0
        if waiting:
            many = summed()
        often = many[1] > 3
        yield pa.record_batch([pa.array(many[0][often].view(np.int64)), pa.array(many[1][often])],
                              names=["token", "n"])

    local = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        count, "token long, n long")
    often = local.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_DOCS)
    rows = often.orderBy(F.desc("n"), "token").limit(COMMON).select("token").collect()
    return np.sort(np.array([row.token for row in rows], np.int64).view(np.uint64))


KEYED = ("doc_id long, tie long, node long, size long, indexed int, prefix array<long>,"
         " points array<struct<level: int, counts: binary>>")
_POINTS = pa.list_(pa.struct([("level", pa.int32()), ("counts", pa.binary())]))


def add_prefixes(docs: DataFrame, shingle: int, tenths: int, common: np.ndarray) -> DataFrame:
    """doc_id, tie, node (a hash of the set; null for the empty one), size, prefix, points."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shipped.value
        for batch in batches:
            nodes, sizes, prefixes, points = [], [], [], []
            for found in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), shingle):
                sizes.append(len(found))
                nodes.append(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)
                             if len(found) else None)
                points.append([{"level": level, "counts": count_vector(found, groups_of(level))}
                               for level in levels_of(len(found), tenths)] if len(found) else [])
                want = prefix_length(len(found), tenths)
                if len(last) and len(found):
                    place = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    frequent = last[place] == found
                    rare = found[~frequent][:want]
                    found = np.r_[rare, found[frequent][:want - len(rare)]]
                prefixes.append(found[:want].view(np.int64))
            bounds = np.r_[0, np.cumsum([len(one) for one in prefixes])].astype(np.int32)
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([indexed_length(size, tenths) for size in sizes], pa.int32()),
                pa.ListArray.from_arrays(
                    bounds, np.concatenate([*prefixes, np.zeros(0, np.int64)])),
                pa.array(points, _POINTS)],
                names=["doc_id", "tie", "node", "size", "indexed", "prefix", "points"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(
        compute, KEYED)


def shared_prefixes(work: Workspace, keyed: DataFrame) -> DataFrame:
    """token, level, node, indexed, native: points of every tree; of trees of the same points only one."""
    levels = F.col("points.level")
    rows = keyed.where("node IS NOT NULL").select(
        "node", F.element_at(levels, 1).alias("own"), F.element_at(levels, -1).alias("top"),
        "indexed", F.posexplode("prefix").alias("place", "token"))
    rows = rows.select("token", "node", "own", "top", (F.col("place") < F.col("indexed")).alias(
        "indexed"))
    busy = rows.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"),
                                     F.bool_or("indexed").alias("used"))
    busy = busy.where("low != high AND used").select("token")
    members = rows.join(busy, "token").distinct().withColumn(
        "level", F.explode(F.sequence("own", "top")))
    members = work.keep(members.select("token", "level", "node", "indexed", (
        F.col("level") == F.col("own")).alias("native")), "members")
    alike = members.groupBy("token", "level").agg(
        F.count("*").alias("many"), F.bit_xor(F.xxhash64("node", "indexed")).alias("all"),
        (F.bool_or("native") & F.bool_or("indexed")).alias("used")).where("many > 1 AND used")
    once = alike.groupBy("level", "many", "all").agg(F.min("token").alias("token")).select(
        "token", "level")
    return work.keep(members.join(once, ["token", "level"]), "trees")


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text: one text of each of the `nodes`; few names are broadcast, many are joined."""
    work = Workspace(docs.sparkSession)
    chosen = work.keep(sets.join(nodes, "node", "left_semi").select("node", "tie"), "chosen")
    wanted = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    text = F.coalesce("text", F.lit(""))
    return work.keep(docs.select(F.xxhash64(text).alias("tie"), text.alias("text")).join(
        wanted, "tie").dropDuplicates(["tie"]).select("node", "text"), "texts")


class CountTree:
    """R-tree over count vectors, built from the whole set of points.

    Level 0 holds the points, ordered by halving along the group in which they are spread most; an
    entry of a higher level spans up to FAN entries below and has their largest counts, the largest
    excess (shingles that the counts leave out), and the range of their sizes.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray,
                 native: np.ndarray, indexed: np.ndarray, tenths: int):
        self.tenths = tenths
        self.order = self._halved(counts)
        counts, sizes = counts[self.order], sizes[self.order]
        self.label, self.native = labels[self.order], native[self.order]
        self.indexed = indexed[self.order]
        excess = sizes - counts.sum(1, dtype=np.int64)
        self.levels = [(counts, excess, sizes, sizes)]
        self.starts: list[np.ndarray] = []
        while len(self.levels[-1][0]) > 1:
            high, excess, low_size, high_size = self.levels[-1]
            starts = np.arange(0, len(high), FAN)
            self.levels.append((
                np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts),
                np.minimum.reduceat(low_size, starts), np.maximum.reduceat(high_size, starts)))
            self.starts.append(np.r_[starts, len(high)])
        self._refresh()

    @staticmethod
    def _halved(counts: np.ndarray) -> np.ndarray:
        ready, open_parts = [], [np.arange(len(counts))]
        while open_parts:
            part = open_parts.pop()
            if len(part) <= FAN:
                ready.append(part)
                continue
            spread = counts[part].var(0)
            part = part[np.argsort(counts[part, int(spread.argmax())], kind="stable")]
            middle = -(-len(part) // 2 // FAN) * FAN
            open_parts += [part[middle:], part[:middle]]
        return np.concatenate(ready)

    def _refresh(self) -> None:
        self.low, self.high = [self.label], [self.label]
        for starts in self.starts:
            self.low.append(np.minimum.reduceat(self.low[-1], starts[:-1]))
            self.high.append(np.maximum.reduceat(self.high[-1], starts[:-1]))

    def pairs(self, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of points that may be similar and have different labels.

        `spanning` takes a pair only if it joins labels that no pair taken before has joined.
        """
        top = len(self.starts)
        roots = np.arange(len(self.levels[top][0]))
        step = max(1, COMPARED // self.levels[0][0].shape[1])
        stack, taken = [(top, roots, roots)], []
        while stack:
            level, left, right = stack.pop()
            if len(left) > step:
                stack.append((level, left[step:], right[step:]))
                left, right = left[:step], right[:step]
            high, excess, low_size, high_size = self.levels[level]
            apart = (self.low[level][left] != self.high[level][right]) | (
                self.high[level][left] != self.low[level][right])
            apart &= (high_size[left] * 10 >= low_size[right] * self.tenths) & (
                high_size[right] * 10 >= low_size[left] * self.tenths)
            left, right = left[apart], right[apart]
            shared = np.minimum(high[left], high[right]).sum(1, dtype=np.int64) + np.minimum(
                excess[left], excess[right])
            needed = (low_size[left] + low_size[right]) * self.tenths
            near = shared * (10 + self.tenths) >= needed
            left, right = left[near], right[near]
            if not len(left):
                continue
            if level:
                stack.append((level - 1, *self._children(level, left, right)))
                continue
            known = self.native[left] | self.native[right]
            known &= np.where(low_size[left] == low_size[right],
                              self.indexed[left] | self.indexed[right], np.where(
                low_size[left] < low_size[right], self.indexed[left], self.indexed[right]))
            left, right = left[known], right[known]
            if spanning:
                best = np.argsort(-(shared / np.maximum(needed, 1))[near][known], kind="stable")
                left, right = self._forest(left[best], right[best])
            taken.append((self.order[left], self.order[right]))
        found = [np.concatenate(part) for part in zip(*taken, strict=True)] if taken else [
            np.zeros(0, np.int64)] * 2
        return found[0], found[1]

    def _children(self, level: int, left: np.ndarray, right: np.ndarray):
        starts = self.starts[level - 1]
        wide, high = starts[left + 1] - starts[left], starts[right + 1] - starts[right]
        many = wide * high
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        per = np.repeat(high, many)
        a = np.repeat(starts[left], many) + place // per
        b = np.repeat(starts[right], many) + place % per
        ordered = (a < b) | ((a == b) & (level > 1))
        return a[ordered], b[ordered]

    def _forest(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that join labels, in the order given: each label takes its first pair, again and
        again until no pair has two labels."""
        used = []
        while len(left):
            low = np.minimum(self.label[left], self.label[right])
            high = np.maximum(self.label[left], self.label[right])
            apart = low != high
            left, right, low, high = left[apart], right[apart], low[apart], high[apart]
            joined, first = np.unique(high, return_index=True)
            used.append((left[first], right[first]))
            # every taken pair leads from a label to a smaller one, so the leads end
            lead = low[first]
            while len(joined):
                place = np.minimum(np.searchsorted(joined, lead), len(joined) - 1)
                further = joined[place] == lead
                if not further.any():
                    break
                lead = np.where(further, lead[place], lead)
            if len(joined):
                place = np.minimum(np.searchsorted(joined, self.label), len(joined) - 1)
                self.label = np.where(joined[place] == self.label, lead[place], self.label)
        if used:
            self._refresh()
        found = [np.concatenate(part) for part in zip(*used, strict=True)] if used else [left] * 2
        return found[0], found[1]


TREE = ["token", "level", "first", "second"]


def candidates(rooted: DataFrame, points: DataFrame, tenths: int, spanning: bool) -> DataFrame:
    """token, level, a, b: points of different roots that survive in a tree of `rooted`."""
    mixed = rooted.groupBy("token", "level").agg(
        F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = mixed.where("low != high").select("token", "level", "many")
    parts = F.ceil(F.col("many") / F.lit(NODE_ROWS)).cast("int")
    rows = (rooted.join(mixed, ["token", "level"]).withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("node", "token"), "parts").cast("int")))
    others = F.array("own") if spanning else F.sequence(F.lit(0), F.col("parts") - 1)
    rows = rows.withColumn("other", F.explode(others)).join(points, ["node", "level"]).select(
        "token", "level", F.least("own", "other").alias("first"),
        F.greatest("own", "other").alias("second"), "node", "root", "native", "indexed", "size", "counts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(name).to_numpy() for name in TREE], 1)
            node, root, native, indexed, size = (table.column(name).to_numpy() for name in (
                "node", "root", "native", "indexed", "size"))
            counts = table.column("counts")
            bounds = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            pairs = [(np.zeros(0, np.int64),) * 4]
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if end - begin > 1 and native[begin:end].any():
                    vectors = np.frombuffer(b"".join(counts[begin:end].to_pylist()), np.uint8)
                    tree = CountTree(size[begin:end], vectors.reshape(end - begin, -1),
                                     root[begin:end], native[begin:end], indexed[begin:end],
                                     tenths)
                    left, right = tree.pairs(spanning)
                    a, b = node[begin + left], node[begin + right]
                    pairs.append((np.full(len(a), keys[begin, 0]), np.full(len(a), keys[begin, 1]),
                                  np.minimum(a, b), np.maximum(a, b)))
            columns = [np.concatenate(part) for part in zip(*pairs, strict=True)]
            if not spanning:  # the trees do not matter any more
                _, once = np.unique(np.stack(columns[2:], 1), axis=0, return_index=True)
                columns = [column[once] for column in columns]
            columns[1] = columns[1].astype(np.int32)
            return pa.record_batch([pa.array(column) for column in columns],
                                   names=["token", "level", "a", "b"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            keys = np.stack([batch.column(name).to_numpy() for name in TREE], 1)
            cut = int(np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])[-1])
            before = waiting[0].slice(0, 1).select(TREE).to_pylist()
            if cut or before != batch.slice(cut, 1).select(TREE).to_pylist():
                # the last tree may go on in the next batch
                yield found(pa.Table.from_batches([*waiting[:-1], batch.slice(0, cut)]))
                waiting = [batch.slice(cut)]
        if waiting:
            yield found(pa.Table.from_batches(waiting))

    return rows.repartition(*TREE).sortWithinPartitions(*TREE).mapInArrow(
        search, "token long, level int, a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """The rows of `pairs` (a, b) whose whole sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, COMPARED_PAIRS):
                batch = whole.slice(begin, COMPARED_PAIRS)
                near = [
                    len(np.intersect1d(one, two, assume_unique=True)) * (10 + tenths) >= (
                        len(one) + len(two)) * tenths
                    for one, two in zip(*(shingle_sets(
                        batch.column(side).cast(pa.binary()).to_pylist(), shingle)
                        for side in (2, 3)), strict=True)]
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(
                    pa.array(near, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("first"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("second"))
    return pairs.join(right, "b").join(left, "a").select(
        "a", "b", "first", "second").mapInArrow(compare, "a long, b long")


def components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `edges` that are not their component's smallest.

    Up to `TASK_EDGES` edges (16 bytes each) are united in one task; more of them by joins.
    """
    if edges.count() > TASK_EDGES:
        return connected_components(work, edges)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        yield pa.record_batch([pa.array(list(parent), pa.int64()),
                               pa.array([find(x) for x in parent], pa.int64())],
                              names=["node", "root"])

    return edges.coalesce(1).mapInArrow(unite, "node long, root long")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, tenths: int = TENTHS) -> DataFrame:
    """doc_id, tie, node, size, root of every document.

    `node` stands for the document's set (null for the empty one); `root` is a node that stands for
    all sets reachable by links.
    """
    work = Workspace(docs.sparkSession)
    keyed = work.keep(add_prefixes(docs, shingle, tenths, common_shingles(docs, shingle)), "keyed")
    trees = shared_prefixes(work, keyed)
    sets = work.keep(keyed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("tie").alias("tie"), F.first(F.struct("size", "points")).alias("of")), "sets")
    points = sets.join(trees.select("node").distinct(), "node", "left_semi").select(
        "node", "of.size", F.inline("of.points"))
    points = work.keep(points, "points")
    cut = trees.groupBy("token", "level").agg(F.count("*").alias("many")).where(
        F.col("many") > NODE_ROWS).select("token", "level")
    by_token = Window.partitionBy("node").orderBy("token", "level")
    members = trees.withColumn("rank", F.row_number().over(by_token)).where(
        F.col("rank") <= FIRST_TREES).drop("rank")
    edges = roots = tried = None
    for step in ("first", "spanning", "last"):
        rooted = members.withColumn("root", F.col("node")) if roots is None else members.join(
            roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = work.keep(candidates(rooted, points, tenths, step != "last"), "found")
        pairs = found.select("a", "b").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = work.keep(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        texts = texts_of(docs, sets, pairs.select(F.explode(F.array("a", "b")).alias("node")))
        links = work.keep(verified(pairs, texts, shingle, tenths), "links")
        edges = work.keep(links if edges is None else edges.union(links), "edges")
        roots = work.keep(components(work, edges), "roots")
        # a whole tree without surviving pairs has none in later rounds either; of one that was
        # cut, the pairs across its parts are still to be met
        members = trees if step == "first" else trees.join(
            found.select("token", "level").union(cut).distinct(), ["token", "level"])
    rows = keyed.select("doc_id", "tie", "node", "size")
    return rows.join(roots, "node", "left").select(
        "doc_id", "tie", "node", "size", F.coalesce("root", "node").alias("root"))


def keep_different(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Texts without words are copies of each other here.
    """
    return representatives(docs, similar_sets(docs))


@register("op13_count_vector_join")
def op13_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component by links."""
    rows = similar_sets(read_table(spark, sf_dir, "documents"))
    ids = rows.where("root IS NOT NULL").groupBy("root").agg(
        F.min("doc_id").alias("component_id"))
    linked = rows.where("root IS NOT NULL").join(ids, "root")
    alone = rows.where("root IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("size").alias("n_shingles"), "component_id"]
    return linked.select(*columns).union(alone.select(*columns))
