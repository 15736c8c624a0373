"""Outcome classification, retries, derived counters and job state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import BackoffPolicy, FetchRetryPolicy
from contactgrid.operators.keyed import null_safe_join, spread, winner_per_key


def url_status(outcome: Column, findings: Column) -> tuple[Column, Column]:
    """URL status and error code of a site outcome."""
    done = outcome.isin("COMPLETED", "COMPLETED_NO_EMAILS")
    status = (
        F.when(done & (findings > 0), F.lit("COMPLETED")).when(done, F.lit("NO_EMAIL"))
        .when(outcome == "PARTIAL", F.lit("COMPLETED"))
        .when(outcome == "CANCELLED", F.lit("CANCELLED")).otherwise(F.lit("FAILED")))
    error = (
        F.when(done, F.lit(None).cast("string"))
        .when(outcome == "PARTIAL", F.lit("PARTIAL_SCAN"))
        .when(outcome == "ROBOTS_BLOCKED", F.lit("ROBOTS_BLOCKED"))
        .when(outcome == "CANCELLED", F.lit("JOB_CANCELLED")).otherwise(F.lit("SCAN_FAILED")))
    return status, error


def batch_item_outcome(outcome: Column) -> Column:
    known = ("COMPLETED", "COMPLETED_NO_EMAILS", "PARTIAL", "ROBOTS_BLOCKED", "CANCELLED")
    return F.when(outcome.isin(*known), outcome).otherwise(F.lit("FAILED"))


def batch_rollup(items: DataFrame, batch: str, outcome: str = "outcome") -> DataFrame:
    """Scan counts and overall outcome per batch of item outcomes."""
    code = F.col(outcome)
    invalid = code == "INVALID_INPUT"
    duplicate = code == "DUPLICATE_COALESCED"
    stats = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_inputs"),
        F.count_if(invalid).alias("invalid_inputs"),
        F.count_if(duplicate).alias("duplicate_coalesced_items"),
        F.count_if(code.isin("COMPLETED", "COMPLETED_NO_EMAILS", "PARTIAL")).alias(
            "completed_scans"),
        F.count_if(code.isin("FAILED", "ROBOTS_BLOCKED")).alias("failed_scans"),
        F.count_if(code == "CANCELLED").alias("cancelled_scans"))
    troubled = (F.col("invalid_inputs") > 0) | (F.col("failed_scans") > 0)
    return stats.withColumn("batch_outcome", F.when(
        F.col("cancelled_scans") > 0, F.lit("CANCELLED")).when(
        F.col("total_inputs") == 0, F.lit("FAILED")).when(
        troubled, F.lit("PARTIAL")).otherwise(F.lit("COMPLETED")))


def _page_code(c_outcome: Column, fetch: Column, status: Column) -> tuple[Column, Column]:
    """Error code and retryability of one page record; null when the record does not decide."""
    code = retry = None
    for name, (error, again) in ref.PAGE_DECISIONS.items():
        test = c_outcome == name
        code = F.when(test, F.lit(error)) if code is None else code.when(test, F.lit(error))
        retry = F.when(test, F.lit(again)) if retry is None else retry.when(test, F.lit(again))
    for name, again in ref.FETCH_RETRYABILITY.items():
        code, retry = code.when(fetch == name, F.lit(name)), retry.when(
            fetch == name, F.lit(again))
    http = fetch == "HTTP_ERROR"
    code = code.when(http & status.isNull(), F.lit("HTTP_ERROR")).when(
        http, F.concat(F.lit("HTTP_"), status.cast("string")))
    retry = retry.when(http, F.coalesce(
        status.isin(*ref.RETRYABLE_HTTP_STATUSES), F.lit(False)))
    return code, retry


def error_classification(
    pages: DataFrame, keys: list[str], order: str = "page_seq", site_outcome: str | None = None
) -> DataFrame:
    """Error code and retryability from the first decisive page record of each scan.

    `pages` has (keys, order, page_outcome, fetch_outcome, status_code[, site_outcome]). Scans
    without a decisive page are SCAN_FAILED and may be retried.
    """
    code, retry = _page_code(
        F.col("page_outcome"), F.col("fetch_outcome"), F.col("status_code"))
    if site_outcome is not None:
        blocked = F.col(site_outcome) == "ROBOTS_BLOCKED"
        code = F.when(blocked, F.lit("ROBOTS_BLOCKED")).otherwise(code)
        retry = F.when(blocked, F.lit(False)).otherwise(retry)
    rated = pages.withColumns({"error_code": code, "retryable": retry})
    best = winner_per_key(
        rated.select(*keys, F.col(order).alias("__order"), "error_code", "retryable"), keys,
        [F.col("error_code").isNull(), F.col("__order")]).drop("__order")
    return best.withColumns({
        "error_code": F.coalesce("error_code", F.lit("SCAN_FAILED")),
        "retryable": F.coalesce("retryable", F.lit(True))})


def worker_outcome(
    outcome: Column, findings: Column, pages_fetched: Column, retryable: Column,
    attempt: Column, max_attempts: Column, exception: Column,
) -> Column:
    """What a worker reports for one scan; `exception` is null, LEASE_LOST or another name."""
    again = F.when(attempt < max_attempts, F.lit("RETRYABLE_FAILURE")).otherwise(
        F.lit("TERMINAL_FAILURE"))
    return (
        F.when(exception == "LEASE_LOST", F.lit("LEASE_LOST"))
        .when(exception.isNotNull() | outcome.isNull(), again)
        .when(outcome == "COMPLETED", F.when(findings > 0, F.lit("TERMINAL_SUCCESS")).otherwise(
            F.lit("TERMINAL_NO_EMAIL")))
        .when(outcome == "COMPLETED_NO_EMAILS", F.lit("TERMINAL_NO_EMAIL"))
        .when(outcome == "ROBOTS_BLOCKED", F.lit("TERMINAL_FAILURE"))
        .when(outcome == "PARTIAL", F.when(
            pages_fetched > 0, F.lit("TERMINAL_PARTIAL")).otherwise(again))
        .when(outcome == "CANCELLED", F.lit("CANCELLED"))
        .when((outcome == "FAILED") & retryable, again)
        .otherwise(F.lit("TERMINAL_FAILURE")))


def fetch_retry(method: Column, outcome: Column, status: Column) -> tuple[Column, Column]:
    """Whether one request may be repeated, and why."""
    reason = None
    for name, why in ref.FETCH_RETRY_REASONS.items():
        test = outcome == name
        reason = F.when(test, F.lit(why)) if reason is None else reason.when(test, F.lit(why))
    http = (outcome == "HTTP_ERROR") & status.isin(*ref.RETRYABLE_HTTP_STATUSES)
    reason = reason.when(http & (status == 429), F.lit("RETRY_AFTER_HEADER")).when(
        http, F.lit("HTTP_STATUS"))
    reason = F.when(F.upper(method).isin("GET", "HEAD"), reason)
    return reason.isNotNull(), reason


def fetch_delay(attempt: Column, policy: FetchRetryPolicy = FetchRetryPolicy()) -> Column:
    """Capped exponential delay with a fixed share of jitter, in seconds."""
    steps = F.greatest(F.lit(0), attempt - 1)
    raw = F.least(F.lit(policy.max_delay_seconds), policy.base_delay_seconds * F.pow(
        F.lit(2.0), steps))
    return F.least(F.lit(policy.max_delay_seconds), raw + raw * policy.jitter_fraction)


def scan_delay(attempt: Column, policy: BackoffPolicy = BackoffPolicy()) -> Column:
    """Capped exponential delay before a scan is repeated, in seconds."""
    raw = policy.base_delay_seconds * F.pow(
        F.lit(policy.factor), F.greatest(F.lit(0), attempt - 1))
    return F.greatest(
        F.lit(policy.base_delay_seconds), F.least(F.lit(policy.max_delay_seconds), raw))


def retry_schedule(df: DataFrame, attempts: str, policy: BackoffPolicy = BackoffPolicy()
                   ) -> DataFrame:
    """One row per attempt 1..n of each row, with its delay and the delay so far."""
    listed = df.filter(F.col(attempts) >= 1).withColumn(
        "attempt", F.explode(F.sequence(F.lit(1), F.col(attempts))))
    total = F.aggregate(
        F.sequence(F.lit(1), F.col("attempt")), F.lit(0.0),
        lambda done, n: done + scan_delay(n, policy))
    return listed.withColumns({
        "delay_seconds": scan_delay(F.col("attempt"), policy), "elapsed_seconds": total})


def retry_after(header: Column, now: Column, limit: float = 60.0) -> Column:
    """Seconds asked for by a Retry-After header (number or HTTP date), clamped; else null."""
    text = F.trim(header)
    seconds = text.try_cast("double")
    # the weekday is not checked: the date decides
    stripped = F.regexp_replace(text, r"^[A-Za-z]+,\s*", "")
    date = F.try_to_timestamp(
        F.regexp_replace(stripped, r"\s+(?:GMT|UTC|\+0000)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, (F.unix_micros(date) - F.unix_micros(now)) / 1_000_000)
    return F.when((text != "") & wait.isNotNull(), F.greatest(
        F.lit(0.0), F.least(F.lit(limit), wait)))


def derived_counters(urls: DataFrame) -> DataFrame:
    """Counters per job from the statuses of its URLs."""
    status = F.col("status")
    return urls.groupBy("job_id").agg(
        F.count_if(status.isin("QUEUED", "RETRY_WAIT")).alias("queued_actual"),
        F.count_if(status == "SCANNING").alias("running_actual"),
        F.count_if(status.isin("COMPLETED", "NO_EMAIL")).alias("completed_actual"),
        F.count_if(status.isin("FAILED", "INVALID")).alias("failed_actual"),
        F.count_if(status.isin(*ref.OPEN_URL_STATUSES)).alias("open_actual"),
        F.count_if(status.isin(*ref.ACTIVE_URL_STATUSES)).alias("active_actual"),
        F.count_if(status.isin(*ref.TERMINAL_URL_STATUSES)).alias("terminal_actual"),
        F.count_if(status.isin("LEASED", "SCANNING")).alias("leased_or_scanning"))


COUNTERS = ("queued_actual", "running_actual", "completed_actual", "failed_actual",
            "open_actual", "active_actual", "terminal_actual", "leased_or_scanning")


def with_derived_counters(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    return jobs.join(derived_counters(urls), "job_id", "left").fillna(0, list(COUNTERS))


def final_status(
    jobs: DataFrame, urls: DataFrame, partial_attempts: DataFrame | None = None
) -> DataFrame:
    """Final status of jobs without open URLs; `partial_attempts` has (job_id, partial_count)."""
    df = with_derived_counters(jobs, urls)
    if partial_attempts is None:
        df = df.withColumn("partial_count", F.lit(0).cast("bigint"))
    else:
        df = df.join(partial_attempts, "job_id", "left").fillna(0, ["partial_count"])
    ready = df.filter((F.col("open_actual") == 0) & ~F.col("status").isin(
        *ref.TERMINAL_JOB_STATUSES))
    failed, done = F.col("failed_actual"), F.col("completed_actual")
    return ready.withColumn("final_status", F.when(
        F.col("status") == "CANCELLING", F.lit("CANCELLED")).when(
        (failed == 0) & (F.col("partial_count") == 0), F.lit("COMPLETED")).when(
        (done == 0) & (failed == F.col("valid_input_count")), F.lit("FAILED")).otherwise(
        F.lit("COMPLETED_WITH_ERRORS")))


def ready_to_finalize(jobs: DataFrame, urls: DataFrame) -> DataFrame:
    """Running or cancelling jobs that have no open URL."""
    open_urls = urls.filter(F.col("status").isin(*ref.OPEN_URL_STATUSES)).select("job_id")
    waiting = jobs.filter(F.col("status").isin("RUNNING", "CANCELLING"))
    return waiting.join(open_urls, "job_id", "left_anti")


def cancel_urls(urls: DataFrame, cancelled_jobs: DataFrame, now: Column) -> DataFrame:
    """New snapshot of URL rows after cancelling jobs: open and expired rows are cancelled."""
    marked = spread(urls, ["job_id"], urls.count()).join(
        cancelled_jobs.select("job_id", F.lit(True).alias("__cancel")), "job_id", "left")
    stopped = F.col("status").isin("PENDING", "QUEUED", "RETRY_WAIT") | (
        (F.col("status") == "SCANNING") & (F.col("lease_expires_at") <= now))
    hit = F.coalesce(F.col("__cancel"), F.lit(False)) & stopped
    return marked.withColumns({
        "new_status": F.when(hit, F.lit("CANCELLED")).otherwise(F.col("status")),
        "new_completed_at": F.when(hit, now).otherwise(F.col("completed_at")),
        "new_error_code": F.when(hit, F.lit("JOB_CANCELLED")),
    }).drop("__cancel")


def cancelled_job_status(cancelled_jobs: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """CANCELLED, or CANCELLING while unexpired scans remain."""
    running = urls.filter(
        (F.col("status") == "SCANNING") & (F.col("lease_expires_at") > now)
    ).groupBy("job_id").agg(F.count(F.lit(1)).alias("running"))
    return cancelled_jobs.join(running, "job_id", "left").fillna(0, ["running"]).withColumn(
        "new_status", F.when(F.col("running") == 0, F.lit("CANCELLED")).otherwise(
            F.lit("CANCELLING")))


def resolve_expired(
    urls: DataFrame, jobs: DataFrame, now: Column, policy: BackoffPolicy = BackoffPolicy()
) -> DataFrame:
    """Next state of scans whose lease ran out, by parent state and attempts.

    `attempt_started` tells whether the claim had begun to consume an attempt.
    """
    expired = urls.filter((F.col("status") == "SCANNING") & (F.col("lease_expires_at") <= now))
    df = expired.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id")
    cancelled = F.col("job_status").isin("CANCELLING", "CANCELLED")
    restored = ~F.col("attempt_started")
    retry = F.col("attempt_count") < F.col("max_attempts")
    status = (
        F.when(cancelled, F.lit("CANCELLED"))
        .when(restored, F.coalesce("claimed_from_status", F.lit("QUEUED")))
        .when(retry, F.lit("RETRY_WAIT")).otherwise(F.lit("FAILED")))
    error = (
        F.when(cancelled, F.lit("JOB_CANCELLED")).when(restored, F.lit(None).cast("string"))
        .when(retry, F.lit("LEASE_EXPIRED")).otherwise(F.lit("LEASE_EXPIRED_MAX_ATTEMPTS")))
    delay = scan_delay(F.col("attempt_count"), policy)
    return df.withColumns({
        "new_status": status, "new_error_code": error,
        "retry_delay_seconds": F.when(~cancelled & ~restored & retry, delay)})


def status_changes(
    events: DataFrame, job: str, time: str, tie: str, slice_unit: str = "day"
) -> DataFrame:
    """Status events with the status before them; a job's log is cut into time slices.

    Inside a slice `lag` gives the previous status; the first event of a slice takes the last
    status of the latest earlier slice, carried over by the small per-slice table.
    """
    df = events.withColumn("__slice", F.date_trunc(slice_unit, time))
    inside = W.partitionBy(job, "__slice").orderBy(time, tie)
    df = df.withColumn("__lag", F.lag("status").over(inside))
    last = df.groupBy(job, "__slice").agg(
        F.max_by("status", F.struct(time, tie)).alias("__last"))
    carried = last.withColumn("__carried", F.lag("__last").over(
        W.partitionBy(job).orderBy("__slice"))).drop("__last")
    joined = null_safe_join(df, carried, [job, "__slice"], "inner")
    return joined.withColumns({
        "previous_status": F.coalesce("__lag", "__carried"), "new_status": F.col("status"),
    }).drop("__slice", "__lag", "__carried")


def illegal_transitions(changes: DataFrame) -> DataFrame:
    """Status changes (previous_status, new_status) outside the legal set."""
    legal = F.lit(False)
    for before, after in ref.LEGAL_TRANSITIONS:
        legal = legal | ((F.col("previous_status") == before) & (F.col("new_status") == after))
    return changes.filter(
        F.col("previous_status").isNotNull()
        & (F.col("previous_status") != F.col("new_status")) & ~legal)


def progress(jobs: DataFrame) -> DataFrame:
    """Invalid count and clamped progress percentage."""
    total, valid = F.col("total_input_count"), F.col("valid_input_count")
    processed = F.col("completed_count") + F.col("failed_count")
    finished = F.col("status").isin("COMPLETED", "COMPLETED_WITH_ERRORS")
    share = F.when(valid <= 0, F.when(finished, F.lit(100.0)).otherwise(F.lit(0.0))).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), processed / valid * 100.0)))
    return jobs.withColumns({
        "invalid_input_count": F.greatest(
            F.lit(0), total - valid - F.col("duplicate_input_count")),
        "progress_percentage": F.round(share, 2)})


def failure_code(fetch_outcome: Column) -> Column:
    """Failure code of a fetch outcome, null for outcomes without one."""
    code = None
    for name, value in ref.FETCH_FAILURE_CODES.items():
        test = fetch_outcome == name
        code = F.when(test, F.lit(value)) if code is None else code.when(test, F.lit(value))
    return code


def site_outcome(stats: DataFrame) -> DataFrame:
    """Site outcome from its page statistics, first rule first."""
    attempted, fetched = F.col("pages_attempted"), F.col("pages_fetched")
    robots = F.col("first_page_outcome").isin("ROBOTS_DISALLOWED", "ROBOTS_TEMPORARY_FAILURE")
    return stats.withColumn("site_outcome", (
        F.when(F.col("stop_reason") == "CANCELLED", F.lit("CANCELLED"))
        .when(attempted == 0, F.lit("FAILED"))
        .when((attempted == 1) & robots, F.lit("ROBOTS_BLOCKED"))
        .when(fetched == 0, F.lit("FAILED"))
        .when((F.col("pages_failed") > 0)
              | (F.col("stop_reason") == "MAX_ELAPSED_TIME_EXCEEDED"), F.lit("PARTIAL"))
        .when(F.col("findings") > 0, F.lit("COMPLETED"))
        .otherwise(F.lit("COMPLETED_NO_EMAILS"))))


def site_statistics(pages: DataFrame, site: str, order: str = "visit") -> DataFrame:
    """Page counts per site from its page records."""
    outcome = F.col("page_outcome")
    visited = outcome != "SKIPPED_BUDGET_REACHED"
    return pages.groupBy(site).agg(
        F.count(F.lit(1)).alias("pages_queued"),
        F.count_if(visited).alias("pages_attempted"),
        F.count_if(outcome == "FETCHED_AND_PROCESSED").alias("pages_fetched"),
        F.count_if(outcome.startswith("ROBOTS")).alias("pages_blocked_by_robots"),
        F.count_if(outcome.isin("FETCH_FAILED", "UNSAFE_HOST")).alias("pages_failed"),
        F.min_by("page_outcome", order).alias("first_page_outcome"),
        F.min_by("fetch_outcome", order).alias("first_fetch_outcome"))


def site_failure_code(stats: DataFrame) -> DataFrame:
    """Failure code of sites that did not complete, from the first page record."""
    first = F.col("first_page_outcome")
    code = (
        F.when(F.col("site_outcome").isin("COMPLETED", "COMPLETED_NO_EMAILS"),
               F.lit(None).cast("string"))
        .when(F.col("site_outcome") == "CANCELLED", F.lit("CANCELLED"))
        .when(F.col("site_outcome") == "ROBOTS_BLOCKED", F.lit("ROBOTS_BLOCKED"))
        .when(first == "ROBOTS_DISALLOWED", F.lit("ROBOTS_BLOCKED"))
        .when(first == "ROBOTS_TEMPORARY_FAILURE", F.lit("ROBOTS_TEMPORARY_FAILURE"))
        .otherwise(failure_code(F.col("first_fetch_outcome"))))
    return stats.withColumn("failure_code", code)
