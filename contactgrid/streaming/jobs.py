"""Streaming jobs. Each has a batch twin among the operators that gives the same final state.

Keyed state lives in tables in shared storage and is advanced by joins and windows: no key's rows
are gathered in Python, and nothing is remembered by the driver. State that only grows by new keys is
kept in buckets (`state.py`); state that every micro-batch renews is the last batch's folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.operators.keyed import null_safe_join, one_per_key, winner_per_key
from contactgrid.operators.results import upsert_findings
from contactgrid.session import shared_folder
from contactgrid.streaming.state import KeyedState, numbered_folders, remove_folder


# --- aggregates ------------------------------------------------------------------------------
def progress_counts(events: DataFrame, key: str, kind: str) -> DataFrame:
    """Running count per (job, event kind); update mode sends only what changed."""
    return events.groupBy(key, kind).agg(F.count(F.lit(1)).alias("events"))


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode stream and return the latest row per key.

    Every micro-batch is written to its own folder under its id, so a repeated batch replaces
    itself; the newest batch of a key holds its current value.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def throughput(
    events: DataFrame, time: str, size: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Count per (sliding) window; rows later than the watermark are dropped."""
    span = F.window(time, size, slide or size)
    counts = events.withWatermark(time, late).groupBy(span).agg(
        F.count(F.lit(1)).alias("terminal"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "terminal")


def drop_replays(results: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """First result per key within the watermark; replays are dropped."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


# --- keyed state -----------------------------------------------------------------------------
class BatchTables:
    """Tables that a stream appends to, one folder per micro-batch.

    A repeated micro-batch replaces its own folder, and reads only folders before it, so a replay
    or a restart cannot apply twice; the newest state is found from the folders, never from memory.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, name: str):
        self.spark, self.schema, self.path = spark, schema, f"{folder}/{name}"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        """Rows of all batches."""
        if not numbered_folders(self.spark, self.path, "batch_id"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, batch_id long").option(
            "basePath", self.path).parquet(self.path).drop("batch_id")

    def last(self, before: int) -> DataFrame:
        """Rows of the newest batch before one."""
        saved = numbered_folders(self.spark, self.path, "batch_id")
        known = [n for n in saved if n < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(saved[max(known)])

    def keep_last(self, batch_id: int) -> None:
        """Remove what neither the next batch nor a repetition of this one can read."""
        saved = numbered_folders(self.spark, self.path, "batch_id")
        for number in sorted(n for n in saved if n < batch_id)[:-1]:
            remove_folder(self.spark, saved[number])


def run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    """Apply `step` to every micro-batch that is available; a batch is computed once."""
    def once(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            step(held, batch_id)
        finally:
            held.unpersist()

    query = (stream.writeStream.foreachBatch(once)
             .option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def replay_status(
    results: DataFrame, key: list[str], time: str, tie: str, folder: str | None = None,
    forget_after: str | None = None, buckets: int = 64,
) -> DataFrame:
    """NEW, REPLAY or CONFLICT per result: the first checksum of a key is kept as its state.

    A micro-batch is reduced to the first result of each key, which meets the stored firsts of the
    same buckets in a join; no key's rows are gathered. Firsts older than `forget_after` before the
    batch's newest result no longer count, and leave the state when their folder is folded.
    """
    spark = results.sparkSession
    folder = folder or shared_folder(spark)
    firsts = KeyedState(spark, f"{folder}/firsts",
                        "key string, at timestamp, tie long, checksum string", ["key"], buckets)
    out = BatchTables(spark, folder, "tie long, replay_status string", "out")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"),
            F.col(time).cast("timestamp").alias("at"), F.col(tie).cast("bigint").alias("tie"),
            "checksum")

        def current(state: DataFrame) -> DataFrame:
            if not forget_after:
                return state
            newest = rows.agg(F.max("at").alias("newest"))  # one row
            return state.join(F.broadcast(newest)).filter(
                F.col("at") >= F.col("newest") - F.expr(f"interval {forget_after}")).drop("newest")

        def fold(state: DataFrame) -> DataFrame:
            return winner_per_key(current(state), ["key"], [F.col("state_version")])

        known = current(firsts.near(rows, batch_id)).groupBy("key").agg(
            F.min_by(F.struct("checksum"), "state_version").alias("known"))
        mine = rows.groupBy("key").agg(F.min(F.struct("at", "tie", "checksum")).alias("first"))
        heads = mine.join(known, "key", "left")
        joined = rows.join(heads, "key")
        new = F.col("known").isNull() & (F.col("tie") == F.col("first.tie")) & (
            F.col("at") == F.col("first.at"))
        held = F.when(F.col("known").isNull(), F.col("first.checksum")).otherwise(
            F.col("known.checksum"))
        out.write(joined.select("tie", F.when(new, F.lit("NEW")).when(
            F.col("checksum").eqNullSafe(held), F.lit("REPLAY")).otherwise(
            F.lit("CONFLICT")).alias("replay_status")), batch_id)
        fresh = heads.filter("known is null").select("key", "first.*").persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            firsts.append(fresh, batch_id, fold)
        finally:
            fresh.unpersist()

    run_batches(results, folder, step)
    return out.read()


def following_times(
    rows: DataFrame, key: str, time_us: str, tie: str, slice_seconds: int = 600
) -> DataFrame:
    """`next_us`: the time of the next row of the same key, null for its last one.

    Rows are ordered inside (key, slice of time); the last row of a slice takes the first time of
    the key's next slice that has rows, so only one row a slice meets in one task per key.
    """
    sliced = rows.withColumn("slice", F.floor(F.col(time_us) / F.lit(slice_seconds * 1_000_000)))
    inside = F.lead(time_us).over(Window.partitionBy(key, "slice").orderBy(time_us, tie))
    heads = sliced.groupBy(key, "slice").agg(F.min(time_us).alias("head"))
    after = heads.select(key, "slice", F.lead("head").over(
        Window.partitionBy(key).orderBy("slice")).alias("after_us"))
    joined = null_safe_join(sliced.withColumn("inside_us", inside), after, [key, "slice"], "inner")
    return joined.withColumn("next_us", F.coalesce("inside_us", "after_us")).drop(
        "slice", "inside_us", "after_us")


def _with_timer(
    rows: DataFrame, key: str, time: str, tie: str, until: Column, late: str,
    folder: str | None = None,
) -> DataFrame:
    """(key, expired_at_us) whenever the deadline of a key's latest row passes unrenewed.

    `until` is the deadline a row sets, null when the row clears it. Inside a micro-batch each row
    looks at the next one of its key; the last row of a key is carried over, and fires once the
    newest time seen, less `late`, has passed its deadline, which also ends its state. The state is
    what the last micro-batch carried; older folders are removed. Rows without a time are left out.
    """
    spark = rows.sparkSession
    folder = folder or shared_folder(spark)
    state = BatchTables(spark, folder, "key string, at_us long, tie long, until_us long", "state")
    clock = BatchTables(spark, folder, "newest_us long", "clock")
    out = BatchTables(spark, folder, "key string, expired_at_us bigint", "out")

    def step(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select(
            F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("at_us"),
            F.col(tie).cast("bigint").alias("tie"), F.unix_micros(until).alias("until_us")).filter(
            "at_us is not null")
        chained = following_times(fresh.unionByName(state.last(batch_id)), "key", "at_us", "tie")
        newest = fresh.agg(F.max("at_us").alias("newest_us")).union(clock.last(batch_id)).agg(
            F.max("newest_us").alias("newest_us"))
        clock.write(newest, batch_id)
        mark = F.expr(f"newest_us - unix_micros(timestamp'1970-01-01' + interval {late})")
        # one row, the largest time seen
        timed = chained.join(F.broadcast(newest.select(mark.alias("mark"))))
        passed = F.coalesce("next_us", "mark") > F.col("until_us")
        timed = timed.withColumn("fires", F.coalesce(passed, F.lit(False))).persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            out.write(timed.filter("fires").select(
                "key", F.col("until_us").alias("expired_at_us")), batch_id)
            state.write(timed.filter(
                "next_us is null and not fires and until_us is not null").select(
                "key", "at_us", "tie", "until_us"), batch_id)
        finally:
            timed.unpersist()
        state.keep_last(batch_id)
        clock.keep_last(batch_id)

    run_batches(rows, folder, step)
    return out.read()


def presence_expiry(
    presence: DataFrame, key: str, time: str, tie: str, ttl_seconds: int = 45,
    late: str = "1 minute",
) -> DataFrame:
    """One row per lapse of an instance: no record for `ttl_seconds` after its last one."""
    until = F.col(time) + F.expr(f"interval {ttl_seconds} seconds")
    return _with_timer(presence, key, time, tie, until, late)


def lease_expiry(
    changes: DataFrame, key: str, time: str, tie: str, until: Column, late: str = "1 minute"
) -> DataFrame:
    """One row per lease that ran out; `until` is the lease a change sets, null for a release."""
    return _with_timer(changes, key, time, tie, until, late)


# --- upsert sink -----------------------------------------------------------------------------
def upsert_stream(
    deltas: DataFrame, state: DataFrame, keys: list[str], now: Column, folder: str | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Findings after all micro-batches: `state` merged with the keys that the stream brought.

    A micro-batch adds only the keys that no earlier one had, and reads only the buckets they fall
    into; the merge happens when the result is read, so no batch rewrites the stored findings, and
    a restart with nothing new gives the same result.
    """
    spark = deltas.sparkSession
    folder = folder or shared_folder(spark)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in deltas.schema)
    seen = KeyedState(spark, f"{folder}/seen", fields, keys, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        mine = one_per_key(batch, keys).select(*deltas.columns)
        fresh = null_safe_join(
            mine, seen.near(batch, batch_id).select(*keys), keys, "left_anti").persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            seen.append(fresh, batch_id)
        finally:
            fresh.unpersist()

    run_batches(deltas, folder, step)
    fresh = seen.read().drop("state_version")
    return upsert_findings(state, fresh, keys, now).select(*state.columns)
