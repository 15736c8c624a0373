"""Packing documents into fixed-length sequences by linear grouping and best fit.

Lengths are whole numbers up to the capacity, so the corpus enters the plan as a histogram of at
most `capacity` entries: the plan's size depends on the capacity, not on the corpus.

1. Pieces longer than `capacity / SMALL_SHARE` are large. Sorted by length and cut into groups of
   equal cardinality, each counts as long as the longest of its group.
2. For these few sizes, configurations (multisets that fit a sequence) are optimised: a covering
   linear program solved by generating columns with a knapsack, then rounded down; what the
   rounding leaves joins the small pieces in step 4.
3. Actual pieces take the places of their groups, in order of length; copies of a configuration
   that got the same lengths form one class with one gap.
4. The rest goes, longest first, into the class with the smallest gap that holds it; what fits
   nowhere opens new sequences.

Every decision covers a run of equal lengths and a run of sequences. Tasks then look up each
piece's sequence and offset by its length and its rank among the pieces of that length. The ranks
come from counts per (input task, length): no length, however common, meets in one task.

Edge cases: a null or empty text is the end id alone, a sequence member of length 1; equal rows are
packed each; a null doc_id is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.wordids import encoder, ship_vocabulary, vocabulary_file
from contactgrid.sources.tables import read_table

CAPACITY = 4096
GROUPS = 48
SMALL_SHARE = 3
PIECES = "task int, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long,"
          " offset long")


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of each document's ids with their checksums; only documents over `capacity` are cut."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for batch in batches:
            words = encoder(shipped)
            rows = []
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns),
                                    strict=True):
                ids = np.frombuffer(words.encode(text), f"<u{words.width}").astype("<u4")
                words.make_room()
                ids = np.append(ids, np.array([end_id], "<u4"))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    rows.append((task, doc_id, piece, start, len(part),
                                 zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                names=["task", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def group_large(histogram: dict[int, int], smallest: int, groups: int) -> list[dict[int, int]]:
    """Lengths over `smallest` as groups of equal cardinality: {length: count} each, longest last.

    A length that spans a border is split between the groups on both sides.
    """
    large = sorted((n, count) for n, count in histogram.items() if n > smallest)
    total = sum(count for _, count in large)
    found: list[dict[int, int]] = []
    passed = 0
    for n, count in large:
        while count:
            border = -(-total * (len(found) or 1) // groups)
            if not found or passed >= border:
                found.append({})
                continue
            taken = min(count, border - passed)
            found[-1][n] = taken
            passed, count = passed + taken, count - taken
    return [group for group in found if group]


def best_configuration(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size to put into one sequence for the greatest worth (a knapsack)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    widths = np.array(sizes)
    for room in range(min(sizes), capacity + 1):
        fitting = widths <= room
        gains = np.where(fitting, best[room - np.where(fitting, widths, 0)] + worth, -1.0)
        pick = int(gains.argmax())
        best[room] = best[room - 1]
        if gains[pick] > best[room] + 1e-12:
            best[room], last[room] = gains[pick], pick
    used, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            used[last[room]] += 1
            room -= sizes[last[room]]
    return used


def optimise_configurations(
    sizes: list[int], demand: list[int], capacity: int, rounds: int = 400,
) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of copies that cover nearly all of `demand`, never more.

    Revised simplex steps on the covering program; each entering column is a knapsack's answer.
    """
    basis = np.diag([float(capacity // size) for size in sizes])
    need = np.array(demand, float)
    level = np.linalg.solve(basis, need)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = best_configuration(sizes, np.maximum(worth, 0), capacity).astype(float)
        if column @ worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = column
        level = np.maximum(np.linalg.solve(basis, need), 0)
    left, chosen = np.array(demand, np.int64), []
    for place in np.argsort(-level):
        column = basis[:, place].astype(np.int64)
        used = column > 0
        copies = min(int(level[place] + 1e-6), int((left[used] // column[used]).min()))
        if copies:
            chosen.append((column, copies))
            left -= copies * column
    return chosen


class PackingPlan:
    """Where the r-th piece of each length goes: rows (first rank, first sequence, pieces a
    sequence, first offset), per length in rank order."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int, small_share: int):
        self.capacity = capacity
        self.rows: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
        self.next_rank = dict.fromkeys(histogram, 0)
        self.left = dict(histogram)
        self.sequences = 0
        self.classes: list[tuple[int, int, int]] = []  # gap, first sequence, how many; sorted
        members = group_large(histogram, capacity // small_share, groups)
        if members:
            self._configure(members)
        self._fit_rest()

    def _take(self, n: int, sequence: int, count: int, each: int, offset: int) -> None:
        self.rows[n].append((self.next_rank[n], sequence, each, offset))
        self.next_rank[n] += count
        self.left[n] -= count

    def _configure(self, members: list[dict[int, int]]) -> None:
        sizes: list[int] = []
        demand: list[int] = []
        pools: list[list[list[int]]] = []
        for member in members:
            size = max(member)
            if sizes and sizes[-1] == size:  # groups that round to the same size are one
                demand[-1] += sum(member.values())
                pools[-1] += [[n, c] for n, c in member.items()]
            else:
                sizes.append(size)
                demand.append(sum(member.values()))
                pools.append([[n, c] for n, c in member.items()])
        for pool in pools:
            pool.sort(reverse=True)
        for column, copies in optimise_configurations(sizes, demand, self.capacity):
            slots = [g for g, times in enumerate(column) for _ in range(times)]
            first, self.sequences = self.sequences, self.sequences + copies
            # copies first .. first + copies, cut where a slot's actual length changes
            runs = [(0, copies, 0)]  # from, to, filled
            for group in slots:
                parts, pool = [], pools[group]
                for begin, end, filled in runs:
                    while begin < end:
                        n, available = pool[0]
                        count = min(available, end - begin)
                        self._take(n, first + begin, count, 1, filled)
                        parts.append((begin, begin + count, filled + n))
                        begin += count
                        pool[0][1] -= count
                        if not pool[0][1]:
                            pool.pop(0)
                runs = parts
            for begin, end, filled in runs:
                if filled < self.capacity:
                    insort(self.classes, (self.capacity - filled, first + begin, end - begin))

    def _fit_rest(self) -> None:
        for n in sorted(self.left, reverse=True):
            while self.left[n]:
                place = bisect_left(self.classes, (n, -1, -1))
                if place == len(self.classes):
                    opened = -(-self.left[n] // (self.capacity // n))
                    gap, first, many = self.capacity, self.sequences, opened
                    self.sequences += opened
                else:
                    gap, first, many = self.classes.pop(place)
                self._fill(n, gap, first, many)

    def _fill(self, n: int, gap: int, first: int, many: int) -> None:
        """Put pieces of length n into sequences of one class, each filled before the next."""
        each = min(gap // n, self.left[n])
        full = min(many, self.left[n] // each)
        self._take(n, first, full * each, each, self.capacity - gap)
        rest = min(self.left[n], each) if full < many else 0
        if rest:
            self._take(n, first + full, rest, rest, self.capacity - gap)
        for left, begin, count in ((gap - each * n, first, full),
                                   (gap - rest * n, first + full, 1 if rest else 0),
                                   (gap, first + full + bool(rest), many - full - bool(rest))):
            if left and count > 0:
                insort(self.classes, (left, begin, count))


def count_ranks(pieces: DataFrame) -> DataFrame:
    """`pieces` with `rank`, the place among the pieces of the same length, from 0.

    A place inside (task, length), bounded by an input task, plus the pieces of that length in
    earlier tasks.
    """
    own = Window.partitionBy("task", "length")
    earlier = Window.partitionBy("length").orderBy("task")
    bases = pieces.groupBy("task", "length").agg(F.count("*").alias("here")).select(
        "task", "length", (F.sum("here").over(earlier) - F.col("here")).alias("base"))
    placed = pieces.withColumn(
        "place", F.row_number().over(own.orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return placed.join(bases, ["task", "length"]).withColumn(
        "rank", F.col("base") + F.col("place")).drop("base", "place")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1,
    groups: int = GROUPS, small_share: int = SMALL_SHARE,
) -> DataFrame:
    """Each piece's sequence and offset, for `docs` (doc_id, text).

    The driver holds the histogram of lengths and the plan: both are bounded by the capacity.
    """
    work = Workspace(docs.sparkSession)
    pieces = work.keep(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    histogram = {row.length: row.pieces for row in
                 pieces.groupBy("length").agg(F.count("*").alias("pieces")).collect()}
    plan = PackingPlan(histogram, capacity, groups, small_share)
    table = {n: np.array(rows, np.int64) for n, rows in plan.rows.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(name).to_numpy() for name in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                own, rows = lengths == n, table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], "right") - 1]
                inside = ranks[own] - row[:, 0]
                sequence[own] = row[:, 1] + inside // row[:, 2]
                offset[own] = row[:, 3] + inside % row[:, 2] * n
            yield pa.record_batch(
                [*(batch.column(name) for name in ("doc_id", "piece", "start", "length",
                                                   "ids_crc32")),
                 pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return count_ranks(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PACKED)


@register("op3_pack_documents")
def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_file())
