"""Repeated passages, by a logarithmic family of suffix arrays.

A byte goes if a string of `WINDOW` bytes that covers it starts anywhere else too. Two suffixes
that agree on that many bytes are neighbours in a suffix array; arrays here are sorted by names
(128-bit hashes) of the suffixes' heads, an order as good as the alphabet's for finding equal ones.

Levels. `IndexFamily` holds sorted tables in shared storage. A new batch of documents gets its own
array; it is merge-scanned against every level for names they share; then it becomes a level, and
levels of equal rank merge into one of the next, so that a name is rewritten a logarithmic number of
times. Later batches can be added to a family at any time.

What is indexed. Not every suffix: windows whose anchors coincide form runs (`windows`), and equal
windows have equal anchors.

1. The family finds the anchor strings that occur more than once; only their runs go on.
2. A run whose whole text occurs more than once is repeated in full.
3. The other runs, at the borders of repeated passages, are compared window by window with the runs
   of the same anchor string, one copy of each. Texts of these runs are dealt out by anchor string;
   a task takes them in batches through a family of its own, held in numpy arrays.
4. An anchor string with more than `UNIT_RUNS` such runs is not left to one task: its windows are
   dealt out by name and counted, with sums before the shuffle.

Edge cases: a null text is empty; texts shorter than the window keep all; overlapping occurrences
and equal rows count as elsewhere; a null doc_id is kept; an empty table gives no rows; documents
never join; very long documents are one row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.windows import KEY, WINDOW, Hashes, anchor_runs
from contactgrid.sources.tables import read_table

BATCHES = 4
#: Bytes of text that are hashed at once (a longer document is taken alone).
CHUNK_BYTES = 1 << 18
#: Runs that a task's family holds, on average, and the most that one anchor string may bring.
UNIT_RUNS = 1 << 13
#: Runs whose windows enter a task's family at once.
BATCH_RUNS = 1024
REPEATED, WANTED, COMPARED = 0, 1, 2


def chunks_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `CHUNK_BYTES` in all."""
    begin = size = 0
    for place, text in enumerate(texts):
        if size and size + len(text) > CHUNK_BYTES:
            yield begin, place
            begin, size = place, 0
        size += len(text)
    if texts:
        yield begin, len(texts)


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id, tie, first, last, key, name, check: every run of windows of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py().encode() for text in batch.column(2)]
            for begin, end in chunks_of(texts):
                bounds = np.r_[0, np.cumsum([len(text) for text in texts[begin:end]])]
                hashes = Hashes(np.frombuffer(b"".join(texts[begin:end]), np.uint8))
                first, last, anchor = anchor_runs(hashes, bounds)
                doc = np.searchsorted(bounds, first, "right") - 1
                rows = pa.array(doc + begin)
                names = [hashes.of(anchor, anchor + KEY, 0), hashes.of(first, last + WINDOW, 0),
                         hashes.of(first, last + WINDOW, 1)]
                yield pa.record_batch([
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(first - bounds[doc], pa.int32()),
                    pa.array(last - bounds[doc], pa.int32()),
                    *(pa.array(name.view(np.int64)) for name in names)],
                    names=["doc_id", "tie", "first", "last", "key", "name", "check"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(
        find, "doc_id long, tie long, first int, last int, key long, name long, check long")


class IndexFamily:
    """Levels of sorted, distinct names in shared storage; the last one is the newest."""

    def __init__(self, work: Workspace):
        self.work = work
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, names: DataFrame) -> DataFrame:
        """Index a batch of `names` (key: long); returns those that occurred before or twice."""
        array = self.work.keep(names.groupBy("key").agg(
            (F.count("*") > 1).alias("twice")).sortWithinPartitions("key"), "array")
        found = array.where("twice").select("key")
        for _, level in self.levels:
            found = found.union(array.where("NOT twice").join(level, "key", "left_semi").select(
                "key"))
        found = self.work.keep(found.distinct(), "matches")
        rank, newest = 0, array.select("key")
        newest.path = array.path
        while self.levels and self.levels[-1][0] == rank:
            _, older = self.levels.pop()
            merged = self.work.keep(older.union(newest).distinct().sortWithinPartitions("key"),
                                    "level")
            self.work.drop(older, newest)
            rank, newest = rank + 1, merged
        self.levels.append((rank, newest))
        self.work.release()
        return found


def repeated_keys(work: Workspace, runs: DataFrame, batches: int) -> DataFrame:
    """Anchor strings that occur more than once, found batch by batch."""
    family = IndexFamily(work)
    batch = F.pmod(F.xxhash64("doc_id", "tie", F.lit("batch")), F.lit(batches))
    found = None
    for number in range(batches):
        more = family.add(runs.where(batch == number).select("key"))
        found = more if found is None else found.union(more)
    return found.distinct()


class WindowFamily:
    """Levels of (name, check, number) arrays in a task's memory, sorted by name.

    `add` numbers the windows of a batch, marks every window that equals one of another number, on
    both sides, and merges levels as the tables above are merged.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.marked: list[np.ndarray] = []
        self.starts: list[int] = []
        self.count = 0

    def add(self, names: np.ndarray, checks: np.ndarray) -> None:
        order = np.argsort(names, kind="stable")
        names, checks, numbers = names[order], checks[order], order + self.count
        self.starts.append(self.count)
        self.marked.append(np.zeros(len(names), bool))
        self.count += len(names)
        names, checks, numbers = self._once(names, checks, numbers)
        for level in self.levels:
            place = np.minimum(np.searchsorted(level[0], names), len(level[0]) - 1)
            same = (level[0][place] == names) & (level[1][place] == checks)
            self._mark(numbers[same])
            self._mark(level[2][place[same]])
        newest = (names, checks, numbers)
        while self.levels and len(self.levels[-1][0]) < 2 * len(newest[0]):
            older = self.levels.pop()
            joined = [np.concatenate(pair) for pair in zip(older, newest, strict=True)]
            order = np.argsort(joined[0], kind="stable")
            newest = self._once(*(part[order] for part in joined))
        if len(newest[0]):
            self.levels.append(newest)

    def _once(self, names, checks, numbers):
        """One entry for each name; entries that equal the one before them are marked, with it."""
        same = np.r_[False, (names[1:] == names[:-1]) & (checks[1:] == checks[:-1])]
        self._mark(numbers[same])
        self._mark(numbers[np.r_[same[1:], False]])
        return names[~same], checks[~same], numbers[~same]

    def _mark(self, numbers: np.ndarray) -> None:
        batch = np.searchsorted(self.starts, numbers, "right") - 1
        for place in np.unique(batch):
            self.marked[place][numbers[batch == place] - self.starts[place]] = True


def window_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and checks of all windows of the texts, and how many each text has."""
    counts = np.array([len(text) - WINDOW + 1 for text in texts], np.int64)
    ends = np.cumsum([len(text) for text in texts])
    hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
    passed = np.cumsum(counts) - counts
    places = np.arange(counts.sum()) + np.repeat(ends - counts - WINDOW + 1 - passed, counts)
    return hashes.of_all(WINDOW)[places], hashes.of_all(WINDOW, 1)[places], counts


def stretches(marked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of each stretch of marked windows, by texts that hold `counts`."""
    text = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = np.r_[False, marked[:-1]] & (inner > 0)
    after = np.r_[marked[1:], False] & (inner < np.repeat(counts, counts) - 1)
    first, last = np.flatnonzero(marked & ~before), np.flatnonzero(marked & ~after)
    return text[first], inner[first], inner[last]


FOUND = "doc_id long, tie long, first int, last int"


def compare_runs(members: DataFrame, parts: int) -> DataFrame:
    """Stretches of repeated windows in the wanted `members`, dealt out by anchor string."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = WindowFamily()
        kept = []
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_RUNS):
                part = whole.slice(begin, BATCH_RUNS)
                names, checks, counts = window_names(part.column(4).to_pylist())
                family.add(names, checks)
                kept.append((part.select([0, 1, 2, 3]), counts))
        for (part, counts), marked in zip(kept, family.marked, strict=True):
            text, first, last = stretches(marked, counts)
            wanted = part.column(3).to_numpy(zero_copy_only=False)[text] == WANTED
            text, first, last = text[wanted], first[wanted], last[wanted]
            start = part.column(2).to_numpy()[text]
            rows = pa.array(text)
            yield pa.record_batch([
                part.column(0).take(rows), part.column(1).take(rows),
                pa.array(first + start, pa.int32()), pa.array(last + start, pa.int32())],
                names=["doc_id", "tie", "first", "last"])

    return members.repartition(parts, "key").select(
        "doc_id", "tie", "first", "role", "bytes").mapInArrow(compare, FOUND)


def count_windows(members: DataFrame) -> DataFrame:
    """The same for anchor strings with very many runs: windows counted by name."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH_RUNS):
                part = whole.slice(begin, BATCH_RUNS)
                names, checks, counts = window_names(part.column(4).to_pylist())
                text = np.repeat(np.arange(len(counts)), counts)
                inner = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                rows = pa.array(text)
                yield pa.record_batch([
                    part.column(0).take(rows), part.column(1).take(rows),
                    pa.array(inner + part.column(2).to_numpy()[text], pa.int32()),
                    part.column(3).take(rows), pa.array(names.view(np.int64)),
                    pa.array(checks.view(np.int64))],
                    names=["doc_id", "tie", "first", "role", "name", "check"])

    named = members.select("doc_id", "tie", "first", "role", "bytes").mapInArrow(
        name, "doc_id long, tie long, first int, role int, name long, check long")
    often = named.groupBy("name", "check").agg(F.count("*").alias("n")).where("n > 1")
    return named.where(F.col("role") == WANTED).join(often, ["name", "check"]).select(
        "doc_id", "tie", "first", F.col("first").alias("last"))


def removed_spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by windows first .. last."""
    order = np.argsort(first, kind="stable")
    spans: list[list[int]] = []
    for a, b in zip(first[order].tolist(), last[order].tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + WINDOW)
        else:
            spans.append([a, b + WINDOW])
    return [(a, b) for a, b in spans]


def cut_text(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """`raw` without the bytes in `spans`."""
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end:a])
        end = b
    return b"".join([*kept, raw[end:]])


def _row(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    left = cut_text(raw, spans)
    return len(raw), len(spans), left


READ = ("kind int, doc_id long, tie long, n_bytes long, n_spans long, kept binary, key long,"
        " first int, role int, known array<int>")
NAMES = [field.split()[0] for field in READ.split(", ")]
DONE, WAITING, MEMBER = 0, 1, 2


def read_runs(docs: DataFrame, chosen: DataFrame, keep_text: bool) -> DataFrame:
    """One pass over the texts with the chosen runs of each.

    Rows by kind: DONE, a document without wanted runs, finished; WAITING, another one, its bytes
    in `kept` and its repeated runs in `known`; MEMBER, a wanted or compared run, its bytes in
    `kept`. Without `keep_text` finished documents carry the digest of what they keep.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, tie, text, runs in zip(*(column.to_pylist() for column in batch.columns),
                                               strict=True):
                raw = text.encode()
                roles = {REPEATED: [], WANTED: [], COMPARED: []}
                for run in runs or ():
                    roles[run["role"]].append(run)
                known = roles[REPEATED]
                if roles[WANTED]:
                    flat = [edge for run in known for edge in (run["first"], run["last"])]
                    rows.append((WAITING, doc_id, tie, len(raw), None, raw, None, None, None,
                                 flat))
                else:
                    spans = removed_spans(np.array([run["first"] for run in known], np.int64),
                                          np.array([run["last"] for run in known], np.int64))
                    size, count, left = _row(raw, spans)
                    rows.append((DONE, doc_id, tie, size, count, finish(left), None, None, None,
                                 [edge for span in spans for edge in span]))
                for run in roles[WANTED] + roles[COMPARED]:
                    rows.append((MEMBER, doc_id, tie, None, None,
                                 raw[run["first"]:run["last"] + WINDOW], run["key"], run["first"],
                                 run["role"], None))
                if len(rows) >= 1024:
                    yield as_batch(rows)
                    rows = []
            yield as_batch(rows)

    finish = (lambda left: left) if keep_text else (lambda left: hashlib.sha256(left).digest())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
             pa.int32(), pa.int32(), pa.list_(pa.int32()))

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(column, kind) for column, kind in
                                zip(columns, kinds, strict=True)], names=NAMES)

    runs = chosen.groupBy("doc_id", "tie").agg(F.collect_list(
        F.struct("first", "last", "key", "role")).alias("runs"))
    runs = runs.select(F.col("doc_id").alias("run_id"), F.col("tie").alias("run_tie"), "runs")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))
    joined = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("run_id")) & (
        F.col("tie") == F.col("run_tie")), "left")
    return joined.select("doc_id", "tie", "text", "runs").mapInArrow(read, READ)


def choose_runs(work: Workspace, runs: DataFrame, keys: DataFrame) -> DataFrame:
    """The runs that matter, with their role: REPEATED in full, WANTED, or COMPARED with those."""
    shared = work.keep(runs.join(keys, "key", "left_semi"), "shared-runs")
    sizes = shared.groupBy("key", "name", "check").agg(
        F.count("*").alias("copies"),
        F.min(F.struct("doc_id", "tie", "first", "last")).alias("one"))
    sizes = work.keep(sizes, "run-copies")
    single = sizes.where("copies = 1").select("key", "one.*")
    wanted = single.select("doc_id", "tie", "first", "last", "key", F.lit(WANTED).alias("role"))
    compared = sizes.where("copies > 1").join(
        single.select("key").distinct(), "key", "left_semi").select(
            "one.*", "key", F.lit(COMPARED).alias("role"))
    repeated = shared.join(sizes.where("copies > 1").select("key", "name", "check"),
                           ["key", "name", "check"], "left_semi").select(
        "doc_id", "tie", "first", "last", "key", F.lit(REPEATED).alias("role")).distinct()
    return wanted.union(compared).union(repeated)


def remove_repeats(docs: DataFrame, batches: int = BATCHES, unit_runs: int = UNIT_RUNS,
                   keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_spans, spans (flat from, to), kept of every document.

    `kept` holds the bytes left, or their SHA-256 digest without `keep_text`.
    """
    work = Workspace(docs.sparkSession)
    runs = work.keep(document_runs(docs), "runs")
    keys = work.keep(repeated_keys(work, runs, batches), "keys")
    chosen = work.keep(choose_runs(work, runs, keys), "chosen")
    work.release()
    read = work.keep(read_runs(docs, chosen, keep_text), "read")
    work.drop(runs)
    work.release()
    members = read.where(F.col("kind") == MEMBER).select(
        "doc_id", "tie", "key", "first", "role", F.col("kept").alias("bytes"))
    sizes = chosen.where(F.col("role") != REPEATED).groupBy("key").agg(F.count("*").alias("runs"))
    big = work.keep(sizes.where(F.col("runs") > unit_runs).select("key"), "big-keys")
    total = chosen.where(F.col("role") != REPEATED).count()
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // unit_runs))
    found = compare_runs(members.join(big, "key", "left_anti"), parts).union(
        count_windows(members.join(big, "key", "left_semi")))
    found = work.keep(found, "found")
    spans = found.groupBy("doc_id", "tie").agg(F.collect_list(
        F.struct("first", "last")).alias("more")).select(
            F.col("doc_id").alias("found_id"), F.col("tie").alias("found_tie"), "more")
    waiting = read.where(F.col("kind") == WAITING).join(
        spans, F.col("doc_id").eqNullSafe(F.col("found_id")) & (
            F.col("tie") == F.col("found_tie")), "left").select("doc_id", "kept", "known", "more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw, known, more in zip(*(column.to_pylist() for column in batch.columns),
                                                strict=True):
                more = more or []
                first = np.array([*known[::2], *(run["first"] for run in more)], np.int64)
                last = np.array([*known[1::2], *(run["last"] for run in more)], np.int64)
                found = removed_spans(first, last)
                size, count, left = _row(raw, found)
                rows.append((doc_id, size, count, [edge for span in found for edge in span],
                             left if keep_text else hashlib.sha256(left).digest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            yield pa.record_batch([pa.array(column, kind) for column, kind in
                                   zip(columns, kinds, strict=True)],
                                  names=["doc_id", "n_bytes", "n_spans", "spans", "kept"])

    done = read.where(F.col("kind") == DONE).select(
        "doc_id", "n_bytes", "n_spans", F.col("known").alias("spans"), "kept")
    return done.union(waiting.mapInArrow(
        finish, "doc_id long, n_bytes long, n_spans long, spans array<int>, kept binary"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages.

    `text` is what is kept; characters that a span cuts into are shown as replacement characters.
    """
    cut = remove_repeats(read_table(spark, sf_dir, "documents"))
    n_kept = F.octet_length("kept").cast("long")
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - n_kept).alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"), n_kept.alias("n_kept"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
