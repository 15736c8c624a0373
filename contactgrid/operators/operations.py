"""Operational metrics and diagnostics with an explicit clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.functions.text import short_digest
from contactgrid.operators.jobs import with_derived_counters
from contactgrid.operators.keyed import top_per_key, winner_per_key


def _seconds(later: Column, earlier: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000)


def url_metrics(urls: DataFrame, now: Column, window_seconds: int) -> DataFrame:
    """State counts, expired leases, retries, recent throughput: one aggregate over one scan."""
    status = F.col("status")
    start = now - F.expr(f"interval {window_seconds} seconds")
    recent = (status.isin(*ref.TERMINAL_URL_STATUSES)
              & (F.col("completed_at") >= start) & (F.col("completed_at") < now))
    states = ("QUEUED", "LEASED", "SCANNING", "RETRY_WAIT", "COMPLETED", "NO_EMAIL", "FAILED")
    row = urls.agg(
        *[F.count_if(status == s).alias(s.lower()) for s in states],
        F.count_if(status.isin("LEASED", "SCANNING") & (F.col("lease_expires_at") < now)).alias(
            "expired_leases"),
        F.min(F.when(status == "QUEUED", F.col("created_at"))).alias("oldest_queued_at"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).cast("bigint").alias("retry_total"),
        F.count_if(recent).alias("recent_terminal_count"))
    return row.withColumns({
        "oldest_queued_age_seconds": _seconds(now, F.col("oldest_queued_at")),
        "recent_throughput_per_second": F.col("recent_terminal_count") / window_seconds,
    }).drop("oldest_queued_at")


def job_metrics(jobs: DataFrame, now: Column) -> DataFrame:
    status = F.col("status")
    active = status.isin(*ref.ACTIVE_JOB_STATUSES)
    row = jobs.agg(
        F.count_if(active).alias("active"),
        F.count_if(status.isin(*ref.TERMINAL_JOB_STATUSES)).alias("terminal"),
        F.min(F.when(active, F.coalesce("started_at", "created_at"))).alias("oldest"))
    return row.withColumn("oldest_active_age_seconds", _seconds(now, F.col("oldest"))).drop(
        "oldest")


def failure_reasons(urls: DataFrame, now: Column, window_seconds: int, k: int = 20) -> DataFrame:
    """The most frequent failure codes of recently failed URLs."""
    start = now - F.expr(f"interval {window_seconds} seconds")
    failed = urls.filter(
        (F.col("status") == "FAILED") & F.col("last_failure_code").isNotNull()
        & (F.col("completed_at") >= start) & (F.col("completed_at") < now))
    counts = failed.groupBy("last_failure_code").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "last_failure_code").limit(k)


def worker_presence(presence: DataFrame, now: Column, stale_after: int = 45) -> DataFrame:
    """Workers per state of their latest record, with the number of stale ones."""
    latest = winner_per_key(
        presence.select("instance", "state", "last_seen", "seq"), ["instance"],
        [-F.unix_micros("last_seen"), -F.col("seq")])
    stale = F.col("last_seen") < now - F.expr(f"interval {stale_after} seconds")
    return latest.groupBy("state").agg(
        F.count(F.lit(1)).alias("workers"), F.count_if(stale).alias("stale"))


def counter_mismatches(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Jobs whose stored counters differ from the statuses of their URLs."""
    df = with_derived_counters(jobs, urls)
    actual = F.struct(*[F.col(c).cast("bigint").alias(f"c{i}") for i, c in enumerate((
        "queued_actual", "leased_or_scanning", "completed_actual", "failed_actual"))])
    stored = F.struct(*[F.col(c).cast("bigint").alias(f"c{i}") for i, c in enumerate((
        "queued_count", "running_count", "completed_count", "failed_count"))])
    return df.filter(~actual.eqNullSafe(stored)).withColumn(
        "reference_digest", short_digest(F.col("job_id")))


def idle_jobs(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Active jobs without active URLs: ready to finalize, or stalled with missing rows."""
    df = with_derived_counters(
        jobs.filter(F.col("status").isin(*ref.ACTIVE_JOB_STATUSES)), urls)
    idle = df.filter(F.col("active_actual") == 0)
    complete = F.col("terminal_actual") >= F.col("valid_input_count")
    return idle.select(
        "job_id", short_digest(F.col("job_id")).alias("reference_digest"),
        F.when(complete, F.lit("all_work_terminal")).otherwise(
            F.lit("no_active_work")).alias("reason"))


def due_urls(urls: DataFrame, now: Column) -> DataFrame:
    """URLs whose lease ran out or whose retry time has come, with the due time."""
    expired = F.col("status").isin("LEASED", "SCANNING") & (F.col("lease_expires_at") < now)
    due = (F.col("status") == "RETRY_WAIT") & (F.col("next_retry_at") <= now)
    kind = F.when(expired, F.lit("expired_lease")).when(due, F.lit("retry_due"))
    marked = urls.withColumn("reason", kind).filter(F.col("reason").isNotNull())
    return marked.withColumn("due_at", F.when(
        F.col("reason") == "expired_lease", F.col("lease_expires_at")).otherwise(
        F.col("next_retry_at")))


def due_report(urls: DataFrame, now: Column, limit: int) -> DataFrame:
    """The oldest due items per kind (top `limit`), with the total and a truncation flag."""
    due = due_urls(urls, now)
    totals = due.groupBy("reason").agg(F.count(F.lit(1)).alias("total"))
    oldest = top_per_key(due.select("reason", "url_id", "due_at"), ["reason"],
                         [F.col("due_at"), F.col("url_id")], limit, "position")
    return oldest.join(F.broadcast(totals), "reason").select(
        "reason", "position", "url_id", short_digest(F.col("url_id")).alias("reference_digest"),
        "total", (F.col("total") > limit).alias("truncated"))
