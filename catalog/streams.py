"""Streaming queries: each drains the event files and returns the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from contactgrid.plans import views as V
from contactgrid.streaming import jobs as S
from contactgrid.streaming.runtime import drain, read_stream


def event_stream(spark, sf):
    return read_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("str1_progress", """
SELECT user_id, event_type, count(*) AS events FROM events GROUP BY user_id, event_type""")
def _(spark, sf):
    counts = S.progress_counts(event_stream(spark, sf), "user_id", "event_type")
    return S.drain_updates(counts, ["user_id", "event_type"])


@register("str2_replays", """
WITH c AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS checksum FROM events)
SELECT event_id AS tie, CASE WHEN row_number() OVER w = 1 THEN 'NEW'
  WHEN checksum = first_value(checksum) OVER w THEN 'REPLAY' ELSE 'CONFLICT' END AS replay_status
FROM c WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def _(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    rows = event_stream(spark, sf).withColumn("checksum", (k % 3).cast("string"))
    return S.replay_status(rows, ["user_id", "event_type"], "ts", "event_id")


@register("str2_first_results", """
SELECT user_id, event_type, count(*) AS kept FROM (SELECT DISTINCT user_id, event_type FROM events)
GROUP BY ALL""")
def _(spark, sf):
    rows = S.drop_replays(event_stream(spark, sf), "ts", ["user_id", "event_type"], "40 days")
    return drain(rows).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("kept"))


_LAPSES = """
SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) + {ttl} AS expired_at_us FROM (
  SELECT user_id, ts, event_type, event_id, lead(ts) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) AS next_ts FROM events)
WHERE {kind} (epoch_us(next_ts) > epoch_us(ts) + {ttl} OR (next_ts IS NULL
  AND epoch_us(ts) + {ttl} < (SELECT epoch_us(max(ts)) FROM events) - 60000000))"""


@register("str3_presence_expiry", _LAPSES.format(ttl=45_000_000, kind=""))
def _(spark, sf):
    return S.presence_expiry(event_stream(spark, sf), "user_id", "ts", "event_id")


@register("str5_lease_expiry", _LAPSES.format(
    ttl=3_600_000_000, kind="event_type IN ('view', 'click') AND"))
def _(spark, sf):
    until = F.when(F.col("event_type").isin("view", "click"),
                   F.col("ts") + F.expr("interval 1 hour"))
    return S.lease_expiry(event_stream(spark, sf), "user_id", "ts", "event_id", until)


@register("str6_throughput", """
WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) AS slot FROM events),
  spread AS (SELECT slot AS start_us FROM w UNION ALL SELECT slot - 1800000000 FROM w)
SELECT start_us, count(*) AS terminal FROM spread
WHERE start_us + 3600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000
GROUP BY start_us""")
def _(spark, sf):
    counts = S.throughput(event_stream(spark, sf), "ts", "1 hour", "30 minutes")
    return drain(counts).select(F.unix_micros("window_start").alias("start_us"), "terminal")


@register("str8_upsert_stream", """
WITH d AS (SELECT user_id AS job_id, event_type || '@shop.com' AS canonical_email,
    bool_or(ts < TIMESTAMP '2024-01-03') AS in_state FROM events GROUP BY ALL)
SELECT job_id, canonical_email, CASE WHEN in_state THEN 'both' ELSE 'new' END AS origin FROM d""")
def _(spark, sf):
    now = V.clock(V.NOW_EVENTS)

    def rows(df):
        return df.select(
            F.col("user_id").alias("job_id"),
            F.concat("event_type", F.lit("@shop.com")).alias("canonical_email"), "ts")

    # findings of the first two days are stored; the stream brings all events, those again too
    old = rows(V.events(spark, sf)).filter(F.col("ts") < F.lit("2024-01-03")).groupBy(
        "job_id", "canonical_email").agg(
        F.min("ts").alias("first_found_at"), F.min("ts").alias("last_found_at"))
    delta = rows(event_stream(spark, sf)).select("job_id", "canonical_email")
    merged = S.upsert_stream(delta, old, ["job_id", "canonical_email"], now)
    origin = F.when(F.col("first_found_at") == now, F.lit("new")).when(
        F.col("last_found_at") == now, F.lit("both")).otherwise(F.lit("state"))
    return merged.select("job_id", "canonical_email", origin.alias("origin"))
