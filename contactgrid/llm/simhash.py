"""Near duplicates by 64-bit fingerprints, linked through a Gray-order hierarchical index.

Fingerprint: A-Z lower-cased, words, three-word shingles with repeats, XXH64 (seed 42) of each; a
bit is set if more than half of the hashes have it.

Index. Distinct fingerprints only. Fingerprints at most `distance` bits apart agree on at least one
of `distance + 1` bands, so the upper nodes are the (band, pattern) pairs: each holds what its
members share, and no link is lost between them. Inside an upper node members are sorted by Gray rank
(neighbours then share long runs of bits), and every run of `FAN` becomes a node with the mask and
pattern of the bits all its members share; runs of runs follow. The search goes down from pairs of
nodes and drops a pair as soon as the shared bits alone differ in more than `distance` places, or all
members are linked already. Only a spanning star of each local component leaves the task.

An upper node of more than `NODE_ROWS` members is split into parts; every pair of parts is a unit
of its own, so that no task holds more than two parts.

Edge cases: null, empty and blank texts have fingerprint zero; fewer than three words make one
shingle; equal rows get equal results; a null doc_id is linked, and a component of null ids only
has a null id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.components import connected_components
from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.sources.tables import read_table

SHINGLE = 3
DISTANCE = 3
FAN = 8
NODE_ROWS = 1 << 13
#: Rows of the sorted members that one index is built over, and pairs compared at once.
SLAB_ROWS = 1 << 16
PAIRS = 1 << 15
#: Hashes whose bits are counted at once.
COUNTED = 1 << 14


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles, in order and with repeats; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in
                     zip(starts, ends[width - 1:].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a whole text as an unsigned number."""
    hashes = shingle_hashes(text, shingle)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at:at + COUNTED].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(),
                          "little")


def add_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie (a hash of the text), fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py(), shingle) for text in batch.column(2)],
                             np.uint64)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                names=["doc_id", "tie", "fingerprint"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(
        compute, "doc_id long, tie long, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over sorted codes; `node` numbers the upper node of each code.

    Level 0 holds the codes; an entry of a higher level spans up to FAN entries of the one below
    and has the pattern, and the mask, of the bits that all its codes share.
    """

    def __init__(self, node: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), node))
        self.codes, node = codes[order], node[order]
        self.label = np.arange(len(codes))
        both, either = self.codes, self.codes
        self.levels = [(self.codes, np.full(len(codes), ~np.uint64(0)))]
        self.starts: list[np.ndarray] = []
        while True:
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            sizes = np.diff(np.r_[first, len(node)])
            if sizes.max() == 1:
                break
            place = np.arange(len(node)) - np.repeat(first, sizes)
            starts = np.flatnonzero(place % FAN == 0)
            both = np.bitwise_and.reduceat(both, starts)
            either = np.bitwise_or.reduceat(either, starts)
            self.levels.append((both, ~(both ^ either)))
            self.starts.append(np.r_[starts, len(node)])
            node = node[starts]
        self._refresh()

    def _refresh(self) -> None:
        """Smallest and largest label below every entry."""
        self.low, self.high = [self.label], [self.label]
        for starts in self.starts:
            self.low.append(np.minimum.reduceat(self.low[-1], starts[:-1]))
            self.high.append(np.maximum.reduceat(self.high[-1], starts[:-1]))

    def link(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (code, representative) that span the components inside each upper node."""
        top = len(self.starts)
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, left, right = stack.pop()
            if len(left) > PAIRS:
                stack += [(level, left[PAIRS:], right[PAIRS:])]
                left, right = left[:PAIRS], right[:PAIRS]
            pattern, mask = self.levels[level]
            linked = (self.low[level][left] == self.high[level][right]) & (
                self.high[level][left] == self.low[level][right])
            different = (pattern[left] ^ pattern[right]) & mask[left] & mask[right]
            near = ~linked & (np.bitwise_count(different) <= distance)
            left, right = left[near], right[near]
            if not len(left):
                continue
            if level:
                stack.append((level - 1, *self._children(level, left, right)))
            else:
                self._unite(left, right)
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[moved], self.codes[self.label[moved]]

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

    def _unite(self, left: np.ndarray, right: np.ndarray) -> None:
        pairs = np.unique(np.stack([self.label[left], self.label[right]], 1), axis=0)
        parent = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if parent:
            new = np.arange(len(self.label))
            for x in parent:
                new[x] = find(x)
            self.label = new[self.label]
            self._refresh()


def bands_for(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of one band more than `distance`: so many flips leave a band as it is."""
    ends = [64 * band // (distance + 1) for band in range(distance + 2)]
    return [(low, high - low) for low, high in zip(ends, ends[1:], strict=False)]


def link_fingerprints(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that join every two of the distinct `codes` within `distance` bits."""
    bands = F.array(*[F.shiftrightunsigned("fingerprint", low).bitwiseAND(
        F.lit((1 << bits) - 1 if bits < 64 else -1)) for low, bits in bands_for(distance)])
    members = codes.select("fingerprint", F.posexplode(bands).alias("band", "pattern"))
    sizes = members.groupBy("band", "pattern").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(NODE_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), "parts").cast("int")
    units = (members.join(sizes, ["band", "pattern"]).withColumn("parts", parts)
             .withColumn("own", own)
             .select("band", "pattern", "fingerprint", "own",
                     F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
             .select("band", "pattern", F.least("own", "other").alias("first"),
                     F.greatest("own", "other").alias("second"), "fingerprint"))
    key = ["band", "pattern", "first", "second"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(node: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            code, root = GrayIndex(node, codes).link(distance)
            return pa.record_batch([pa.array(code.view(np.int64)), pa.array(root.view(np.int64))],
                                   names=["a", "b"])

        def linked_units(keys: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            return linked(np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(1)]), codes)

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            *parts, codes = (column.to_numpy().astype(np.int64) for column in batch.columns)
            waiting.append((np.stack(parts, 1), codes.view(np.uint64)))
            rows += len(codes)
            if rows > SLAB_ROWS:
                keys, codes = (np.concatenate(part) for part in zip(*waiting, strict=True))
                whole = (keys != keys[-1]).any(1)  # the last unit may go on in the next batch
                if whole.any():
                    yield linked_units(keys[whole], codes[whole])
                waiting, rows = [(keys[~whole], codes[~whole])], int((~whole).sum())
        if rows:
            yield linked_units(*(np.concatenate(part) for part in zip(*waiting, strict=True)))

    return units.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, tie, fingerprint (signed), root and component_id of every document.

    `root` names the component by one of its fingerprints; a component_id may name several.
    """
    work = Workspace(docs.sparkSession)
    prints = work.keep(add_fingerprints(docs, shingle), "fingerprints")
    codes = work.keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")),
                      "codes")
    roots = connected_components(work, link_fingerprints(codes.select("fingerprint"), distance))
    rooted = codes.join(roots, codes.fingerprint == roots.node, "left").select(
        "fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root"))
    rooted = work.keep(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = rooted.join(ids, "root").select("fingerprint", "root", "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", "tie", "fingerprint", "root", "component_id")


def representatives(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One document of each group of `rooted` (doc_id, tie, root), columns as in `docs`.

    The smallest doc_id stays. Null ids come last; a group of null ids only keeps one document.
    """
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    first = F.struct(unnamed, "doc_id", "tie")
    chosen = rooted.groupBy("root").agg(F.min(first).alias("first")).select(
        "first.unnamed", F.coalesce("first.doc_id", F.lit(0)).alias("key"), "first.tie")
    row = docs.select(F.struct("*").alias("row"), unnamed,
                      F.coalesce("doc_id", F.lit(0)).cast("long").alias("key"),
                      F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    # one key for both steps: texts are shuffled once
    key = ["unnamed", "key", "tie"]
    return row.join(chosen, key, "left_semi").dropDuplicates(key).select("row.*")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component of near fingerprints."""
    return representatives(docs, near_duplicates(docs))


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id")
