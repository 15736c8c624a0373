"""Repair of conversation structure: the cheapest edits, by branch and bound.

A conversation's turns become an optional system turn and pairs of a user and an assistant turn.
Edits: Keep a turn (0), Rerole it to user or assistant (3), Delete it (4), Insert an empty user or
assistant turn (3). Blank and repeated turns must go; a truncated turn that stays costs 3 more. The
audit is the edits' initials in order; of the cheapest repairs the one with the least audit counts.

Search. A node is (turns taken, state of the roles so far). The search runs depth first over an
explicit stack of prefixes, the one with the least bound on top. A prefix goes if its cost and the
suffix's lower bound (the least costs of the remaining turns by state, audits aside) exceed the
incumbent by more than any difference of states is worth, or if the node's dominance table holds a
cheaper prefix, or one as cheap with a lesser audit. When the stack is empty, the incumbents are
proved.

Long conversations. Two prefixes of one node with equal costs are never one the start of the other,
so the better one stays better whatever follows: turns are searched in stretches of `STRETCH`, each
from every state, and the results are combined in order. Turns are dealt out by ranges of
conversation and turn, so a hot conversation lies in many partitions. One that surely begins and
ends inside a partition is finished there; of another, each partition leaves its best ways from
state to state, which are combined in order of the partitions. Its text's digest is streamed over
the repaired turns, in one task since a digest is sequential. A task holds audits, one byte a turn,
and `HELD_CHARS` characters of one conversation at most.

Turns are taken in the order of turn (nulls first), role and text. A turn counts as repeated if an
equal role and text stand earlier in its conversation; a grouping finds that, not a task's memory.

Edge cases: a null conv_id is a conversation of its own; a null role or text is one space; equal rows
are repeated turns; a role counts by its first letter; a conversation without turns costs nothing
and has an empty audit and the digest of the empty text; an empty table gives no rows; gaps beyond
64 bits count as none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.sources.tables import read_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, a system turn, last a user, last an assistant. The first and the last are
#: complete repairs.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What one state can be worth more than another: at most two inserts, or one and a deletion.
SLACK = INSERT + DELETE
#: Turns that are searched at once, and stretches a worker remembers.
STRETCH = 48
REMEMBERED = 1 << 16
#: Characters of a conversation that a task holds for the digest; longer ones are streamed later.
HELD_CHARS = 1 << 22
#: Leading characters of a text that place a turn in a range; equal ones stay together.
RANGE_CHARS = 32
#: Turn codes: the role's letter, or "-" for one that must go; a capital letter if truncated.
GONE = "-"
Found = tuple[int, str]


def add_after(state: int) -> int:
    """State after a turn in the role that must follow."""
    return ASSISTANT if state == USER else USER


def kept_state(state: int, code: str) -> int | None:
    """State after keeping a turn, or None where its role cannot stand."""
    letter = code.lower()
    if letter == "s":
        return SYSTEM if state == NOTHING else None
    return add_after(state) if letter == ("a" if state == USER else "u") else None


def least_costs(codes: str) -> list[list[int]]:
    """What the turns from each place on cost at least, by state, whatever they end in.

    The relaxed problem has costs only, no audits, and one insert between two turns, which is as
    many as any repair needs.
    """
    bounds = [[0] * 4]
    for code in reversed(codes):
        after = bounds[-1]
        stays = TRUNCATED if code.isupper() else 0
        least = []
        for state in range(4):
            cost = DELETE + after[state]
            if code != GONE:
                cost = min(cost, stays + REROLE + after[add_after(state)])
                kept = kept_state(state, code)
                if kept is not None:
                    cost = min(cost, stays + KEEP + after[kept])
            least.append(cost)
        bounds.append([min(cost, INSERT + least[add_after(state)])
                       for state, cost in enumerate(least)])
    return bounds[::-1]


def search(codes: str, start: int) -> dict[int, Found]:
    """End state: cheapest (cost, audit) of the turns `codes` from state `start`, proved.

    End states that another one beats by more than `SLACK` are left out.
    """
    bounds, end = least_costs(codes), len(codes)
    best: dict[int, Found] = {}
    seen: dict[tuple[int, int], Found] = {}
    limit = None
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        if limit is not None and cost + bounds[at][state] > limit:
            continue
        dominant = seen.get((at, state))
        if dominant is not None and dominant <= (cost, audit):
            continue
        seen[at, state] = cost, audit
        if at == end:
            best[state] = cost, audit  # the dominance table let only better ones through
            limit = cost + SLACK if limit is None else min(limit, cost + SLACK)
        after = [(at, add_after(state), cost + INSERT, audit + "I")]
        if at < end:
            code = codes[at]
            after.append((at + 1, state, cost + DELETE, audit + "D"))
            if code != GONE:
                stays = cost + (TRUNCATED if code.isupper() else 0)
                after.append((at + 1, add_after(state), stays + REROLE, audit + "R"))
                kept = kept_state(state, code)
                if kept is not None:
                    after.append((at + 1, kept, stays + KEEP, audit + "K"))
        after.sort(key=lambda node: (-node[2] - bounds[node[0]][node[1]], node[0]))
        stack += after
    return best


def extend(table: dict[int, Found], codes: str) -> dict[int, Found]:
    """Cheapest (cost, audit) by state after `codes`, from those by state before."""
    for begin in range(0, len(codes), STRETCH):
        after: dict[int, Found] = {}
        part = codes[begin:begin + STRETCH]
        for state, (cost, audit) in table.items():
            for end, (more, edits) in cached_search(part, state).items():
                found = cost + more, audit + edits
                if end not in after or found < after[end]:
                    after[end] = found
        table = after
    return table


_KNOWN: dict[tuple[str, int], dict[int, Found]] = {}


def cached_search(codes: str, start: int) -> dict[int, Found]:
    """`search`, with a bounded memory of earlier stretches."""
    found = _KNOWN.get((codes, start))
    if found is None:
        if len(_KNOWN) > REMEMBERED:
            _KNOWN.clear()
        found = _KNOWN[codes, start] = search(codes, start)
    return found


def accepted(table: dict[int, Found]) -> Found:
    """The cheapest complete repair."""
    return min(found for state, found in table.items() if state in (NOTHING, ASSISTANT))


class Writer:
    """Digest of repaired turns, turn by turn."""

    def __init__(self, audit: str):
        self.digest, self.audit, self.at, self.state = hashlib.sha256(), audit, 0, NOTHING
        self.first = True

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.state = add_after(self.state)
            self._write("user" if self.state == USER else "assistant", "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        """Take the next turn."""
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept_state(self.state, role[:1])
            self._write(role, text)
        elif edit == "R":
            self.state = add_after(self.state)
            self._write("user" if self.state == USER else "assistant", text)

    def done(self) -> str:
        """Hexadecimal digest after the last turn."""
        self._inserted()
        return self.digest.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that the damage leaves, by the rows' checksums."""
    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    way = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    text = F.when(F.col("way") == 1, "").when(
        F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", named("role").alias("role"),
                                named("text").alias("text"), way.alias("way")).where("way != 0")
    times = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(times)).select(
        "conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"))


def coded_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault, code: distinct turns, first faults, codes.

    `fault` and `code` are those of the first copy; every other copy must go.
    """
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("content", content)
    first = rows.groupBy("conv_id", "content").agg(
        F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").select(
            F.col("conv_id").alias("conv"), F.col("content").alias("same"), "first")
    rows = rows.join(first, rows.conv_id.eqNullSafe(F.col("conv")) & (
        F.col("content") == F.col("same")), "left")
    repeated = F.col("same").isNotNull() & ~F.col("first").eqNullSafe(F.col("place"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(repeated, "duplicate").when(
        ~last.isin(".", "!", "?"), "truncated")
    letter = F.substring("role", 1, 1)
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(
        F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return rows.withColumn("fault", fault).withColumn("code", code).select(
        "conv_id", "turn", "role", "text", "copies", "fault", "code")


WAYS = "array<struct<start: int, end: int, cost: long, audit: string>>"
PART = ("conv_id long, part int, rows long, lowest long, highest long, turns long, blank long,"
        f" duplicate long, truncated long, illegal long, first string, last string, ways {WAYS},"
        " cost long, audit string, digest string")
_WAYS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                            ("audit", pa.string())]))
PART_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32())]
    + [(name, pa.int64()) for name in ("rows", "lowest", "highest", "turns", "blank", "duplicate",
                                       "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string()), ("ways", _WAYS), ("cost", pa.int64()),
       ("audit", pa.string()), ("digest", pa.string())])
LEGAL = ("su", "ua", "au")


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, PART_SCHEMA)


class Stretch:
    """Turns of one conversation in one partition, in order."""

    def __init__(self, conv_id: int | None, part: int):
        self.row = {"conv_id": conv_id, "part": part} | dict.fromkeys(
            ("rows", "turns", "blank", "duplicate", "truncated", "illegal"), 0) | dict.fromkeys(
            ("lowest", "highest", "first", "last"))
        self.codes: list[str] = []
        self.texts: list[tuple[str, str, int]] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str | None,
            code: str) -> None:
        """Take a turn and its copies."""
        row, letter = self.row, role[:1]
        if turn is not None and turn != row["highest"]:
            row["lowest"] = turn if row["lowest"] is None else row["lowest"]
            row["highest"] = turn
            row["turns"] += 1
        if row["last"] is None:
            row["first"] = letter
        else:
            row["illegal"] += row["last"] + letter not in LEGAL
        row["illegal"] += copies - 1
        row["last"] = letter
        row["rows"] += copies
        if fault:
            row[fault] += 1
        row["blank" if fault == "blank" else "duplicate"] += copies - 1
        self.codes.append(code + GONE * (copies - 1))
        self.size += len(text) + len(role) + 64
        if self.size <= HELD_CHARS:
            self.texts.append((role, text, copies))
        else:
            self.texts.clear()

    def whole(self) -> dict:
        """The row of a conversation that begins and ends here."""
        row = self.row
        row["cost"], row["audit"] = accepted(extend({NOTHING: (0, "")}, "".join(self.codes)))
        writer = Writer(row["audit"])
        for role, text, copies in self.texts:
            for _ in range(copies):
                writer.add(role, text)
        row["digest"] = writer.done()
        return row

    def open(self) -> dict:
        """The row of a conversation that may have turns in other partitions."""
        codes = "".join(self.codes)
        self.row["ways"] = [
            {"start": start, "end": end, "cost": cost, "audit": audit}
            for start in (NOTHING, SYSTEM, USER, ASSISTANT)
            for end, (cost, audit) in extend({start: (0, "")}, codes).items()]
        return self.row


def read_parts(coded: DataFrame) -> DataFrame:
    """One row for each conversation and partition; `digest` marks those that are finished."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: Stretch | None = None
        begins = False  # whether the conversation surely begins in this partition
        rows: list[dict] = []
        for batch in batches:
            for conv_id, *turn in zip(*(column.to_pylist() for column in batch.columns),
                                      strict=True):
                if now is None or conv_id != now.row["conv_id"]:
                    if now is not None:
                        rows.append(now.whole() if begins and now.size <= HELD_CHARS
                                    else now.open())
                        begins = True
                    now = Stretch(conv_id, part)
                now.add(*turn)
            if len(rows) >= 256:
                yield as_batch(rows)
                rows = []
        if now is not None:
            rows.append(now.open())
        yield as_batch(rows)

    head = F.substring("text", 1, RANGE_CHARS)
    dealt = coded.repartitionByRange("conv_id", "turn", "role", head)
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "turn", "role", "text", "copies", "fault", "code").mapInArrow(read, PART)


def join_parts(parts: DataFrame) -> DataFrame:
    """The rows of open conversations, joined in the order of their partitions; no digest yet."""

    def joined(row: dict, table: dict[int, Found]) -> dict:
        row["cost"], row["audit"] = accepted(table)
        return row | {"ways": None}

    def follow(row: dict, more: dict) -> None:
        row["illegal"] += more["illegal"] + (row["last"] + more["first"] not in LEGAL)
        row["last"] = more["last"]
        row["turns"] += more["turns"] - (
            more["lowest"] is not None and more["lowest"] == row["highest"])
        row["lowest"] = more["lowest"] if row["lowest"] is None else row["lowest"]
        row["highest"] = row["highest"] if more["highest"] is None else more["highest"]
        for name in ("rows", "blank", "duplicate", "truncated"):
            row[name] += more[name]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, table = None, {}
        for batch in batches:
            rows = []
            for place in range(batch.num_rows):
                more = batch.slice(place, 1).to_pylist()[0]
                if row is None or more["conv_id"] != row["conv_id"]:
                    if row is not None:
                        rows.append(joined(row, table))
                    row, table = more, {NOTHING: (0, "")}
                else:
                    follow(row, more)
                after: dict[int, Found] = {}
                for way in more["ways"]:
                    if way["start"] in table:
                        cost, audit = table[way["start"]]
                        found = cost + way["cost"], audit + way["audit"]
                        if way["end"] not in after or found < after[way["end"]]:
                            after[way["end"]] = found
                table = after
            yield as_batch(rows)
        if row is not None:
            yield as_batch([joined(row, table)])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        join, PART)


def stream_digests(coded: DataFrame, joined: DataFrame) -> DataFrame:
    """conv_id, digest of the repaired text, written turn by turn behind each audit."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = None, None
        for batch in batches:
            names, digests = [], []
            for conv_id, audit, role, text, copies in zip(
                    *(column.to_pylist() for column in batch.columns), strict=True):
                if audit is not None:
                    if writer is not None:
                        names.append(name)
                        digests.append(writer.done())
                    name, writer = conv_id, Writer(audit)
                else:
                    for _ in range(copies):
                        writer.add(role, text)
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(digests, pa.string())],
                                  names=["conv_id", "digest"])
        if writer is not None:
            yield pa.record_batch([pa.array([name], pa.int64()), pa.array([writer.done()])],
                                  names=["conv_id", "digest"])

    # at most two conversations a partition are open, and those too long to hold
    wanted = joined.select(F.col("conv_id").alias("open"))
    turns = coded.join(wanted, F.col("conv_id").eqNullSafe(F.col("open")), "left_semi").select(
        "conv_id", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"),
        "role", "text", "copies")
    heads = joined.select("conv_id", F.lit(0), F.lit(None).cast("long"), "audit",
                          F.lit(None).cast("string"), F.lit(None).cast("string"),
                          F.lit(None).cast("long"))
    return heads.toDF(*turns.columns).union(turns).repartition("conv_id").sortWithinPartitions(
        "conv_id", "kind", "turn", "role", "text").select(
            "conv_id", "audit", "role", "text", "copies").mapInArrow(
                digest, "conv_id long, digest string")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, digest of `turns`.

    `turns` are conv_id, turn, role, text without nulls in role and text.
    """
    work = Workspace(turns.sparkSession)
    coded = work.keep(coded_turns(turns), "turns")
    parts = work.keep(read_parts(coded), "parts")
    joined = work.keep(join_parts(parts.where("digest IS NULL")), "joined")
    digests = stream_digests(coded, joined).select(F.col("conv_id").alias("named"), "digest")
    ended = joined.drop("digest").join(
        digests, F.col("conv_id").eqNullSafe(F.col("named"))).select(*parts.columns)
    gaps = F.expr("try_subtract(try_subtract(highest, lowest), turns - 1)")
    return parts.where("digest IS NOT NULL").union(ended).select(
        "conv_id", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate",
        "truncated", "illegal", "cost", "audit", "digest")


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    conversations = read_table(spark, sf_dir, "conversations")
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "named")
    every = conversations.select("conv_id").distinct().join(
        found, F.col("conv_id").eqNullSafe(F.col("named")), "left")
    counts = [F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in
              ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias(
                            "repaired_sha256"))
