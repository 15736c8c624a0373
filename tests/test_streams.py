import random

import pytest
from pyspark.sql import functions as F

from contactgrid.streaming import jobs as S
from contactgrid.streaming.state import KeyedState

SCHEMA = "k string, seq long, at long, delay long"


@pytest.fixture
def feed(spark, tmp_path):
    """Requests in several files, so that the state crosses micro-batches."""
    rng, at, rows = random.Random(3), 0, []
    for i in range(300):
        at += rng.choice([0, 200, 900, 5_000, 70_000])
        rows.append(("hot" if i % 3 else f"d{i % 4}", i, at, rng.choice([0, 500, 4_000])))
    for n in range(3):
        part = rows[n * 100:(n + 1) * 100]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    stream = (spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    return rows, stream


def test_replays_across_batches(feed):
    rows, stream = feed
    tagged = stream.withColumn("checksum", (F.col("delay") > 0).cast("string"))
    got = {r.tie: r.replay_status for r in S.replay_status(tagged, ["k"], "at", "seq").collect()}
    first, expected = {}, {}
    for k, seq, _, delay in rows:
        if k not in first:
            first[k], expected[seq] = delay > 0, "NEW"
        else:
            expected[seq] = "REPLAY" if first[k] == (delay > 0) else "CONFLICT"
    assert got == expected


def test_lapses_across_batches(feed):
    rows, stream = feed
    timed = stream.withColumn("time", F.timestamp_millis("at"))
    got = S.presence_expiry(timed, "k", "time", "seq", ttl_seconds=3, late="1 second").collect()
    newest, expected, last = max(r[2] for r in rows), [], {}
    for k, _, at, _ in rows:
        if k in last and at > last[k] + 3000:
            expected.append((k, (last[k] + 3000) * 1000))
        last[k] = at
    expected += [(k, (at + 3000) * 1000) for k, at in last.items() if newest - 1000 > at + 3000]
    assert sorted((r.key, r.expired_at_us) for r in got) == sorted(expected)


def test_restart_without_new_data_keeps_the_merge(spark, feed, tmp_path):
    _, stream = feed
    stored = spark.createDataFrame(
        [("hot", 1, 1), ("old", 1, 1)], "k string, first_found_at int, last_found_at int")
    runs = [S.upsert_stream(stream.select("k"), stored, ["k"], F.lit(9), f"{tmp_path}/state")
            for _ in range(2)]
    first, second = (sorted(map(tuple, run.collect())) for run in runs)
    assert first == second
    assert first == [("d0", 9, 9), ("d1", 9, 9), ("d2", 9, 9), ("d3", 9, 9), ("hot", 1, 9),
                     ("old", 1, 1)]


def test_updates_keep_the_latest_count(feed):
    rows, stream = feed
    got = S.drain_updates(S.progress_counts(stream, "k", "delay"), ["k", "delay"]).collect()
    expected = {}
    for k, _, _, delay in rows:
        expected[k, delay] = expected.get((k, delay), 0) + 1
    assert {(r.k, r.delay): r.events for r in got} == expected


def kept_files(folder):
    return [f for f in folder.rglob("*.parquet") if "layout" not in f.parts]


def test_state_is_folded_and_old_folders_go(spark, tmp_path):
    """Twenty versions: each key once, few folders a bucket, no folder that nothing refers to."""
    state = KeyedState(spark, f"{tmp_path}/s", "k long, v long", ["k"], buckets=4)
    for n in range(20):
        rows = spark.range(n * 40, n * 40 + 40).selectExpr("id as k", f"{n}L as v").coalesce(1)
        state.append(rows, n)
    got = sorted((r.k, r.v) for r in state.read().collect())
    assert got == [(k, k // 40) for k in range(800)]
    layout = state._layout()
    assert set(layout) == {0, 1, 2, 3}
    assert max(len(folders) for folders in layout.values()) <= 8
    named = {f.parent.parent.name + f.parent.name for f in kept_files(tmp_path / "s")}
    last_two = [layout, state._layout(19)]
    assert named == {f"state_version={v}state_bucket={b}" for one in last_two
                     for b, folders in one.items() for v, _ in folders}


def test_state_reads_only_buckets_that_a_batch_touches(spark, tmp_path):
    state = KeyedState(spark, f"{tmp_path}/s", "k long", ["k"], buckets=16)
    state.append(spark.range(1000).selectExpr("id as k"), 0)
    near = state.near(spark.range(1).selectExpr("id as k"), 1)
    assert 0 < near.count() < 200
    assert {f.rsplit("/", 2)[-2] for f in near.inputFiles()} == {
        f"state_bucket={spark.range(1).selectExpr('id as k').select(state.bucket()).first()[0]}"}


def test_repeated_version_applies_once(spark, tmp_path):
    state = KeyedState(spark, f"{tmp_path}/s", "k long", ["k"], buckets=2)
    none = spark.createDataFrame([(None,)], "k long")
    state.append(none, 0)
    for rows in (50, 30, 30):  # the second and third are a batch cut short, and its repetition
        state.append(spark.range(rows).selectExpr("id as k"), 1)
    state.append(spark.createDataFrame([], "k long"), 2)
    assert sorted(r.k for r in state.read().na.drop().collect()) == list(range(30))
    assert state.read().count() == 31


def test_expired_firsts_leave_the_state(spark, tmp_path):
    """Three files a day apart, with a memory of an hour: every result is new, one day is kept."""
    for n in range(3):
        spark.createDataFrame([(f"k{i}", i + 10 * n, n * 86_400 + i) for i in range(8)],
                              "k string, seq long, at long").coalesce(1).write.parquet(
            f"{tmp_path}/in/f{n}")
    stream = (spark.readStream.schema("k string, seq long, at long").option(
        "recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    tagged = stream.withColumn("checksum", F.lit(None).cast("string")).withColumn(
        "time", F.timestamp_seconds("at"))
    got = S.replay_status(tagged, ["k"], "time", "seq", f"{tmp_path}/run", "1 hour", buckets=1)
    assert {r.replay_status for r in got.collect()} == {"NEW"}
    kept = KeyedState(spark, f"{tmp_path}/run/firsts",
                      "key string, at timestamp, tie long, checksum string", ["key"], 1).read()
    assert sorted(r.tie for r in kept.collect()) == list(range(20, 28))


def test_following_times_across_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(50) * 400_000_000, i)
            for i in range(300)]
    got = S.following_times(spark.createDataFrame(rows, "k string, at long, tie long"),
                            "k", "at", "tie").collect()
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((at, tie) for k, at, tie in rows if k == key)
        expected |= {t: nxt for (_, t), nxt in zip(mine, [a for a, _ in mine[1:]] + [None])}
    assert {r.tie: r.next_us for r in got} == expected


def test_lapse_state_is_the_last_batch_only(feed, tmp_path):
    rows, stream = feed
    timed = stream.withColumn("time", F.timestamp_millis("at"))
    until = F.col("time") + F.expr("interval 3 seconds")
    S._with_timer(timed, "k", "time", "seq", until, "1 second", f"{tmp_path}/run").collect()
    assert len(list((tmp_path / "run" / "state").glob("batch_id=*"))) == 2
    assert len(list((tmp_path / "run" / "clock").glob("batch_id=*"))) == 2
