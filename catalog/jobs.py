"""Outcome classification, retry and job-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.links import _PAGE_RECORDS, _STATS, page_records, site_outcomes
from catalog.sql import quoted, views
from contactgrid import reference_data as ref
from contactgrid.operators import jobs as J
from contactgrid.plans import views as V



@register("map5_url_status", views("urls", **_STATS) + """
SELECT site, CASE WHEN site_outcome IN ('COMPLETED', 'COMPLETED_NO_EMAILS') THEN
    CASE WHEN site % 2 > 0 THEN 'COMPLETED' ELSE 'NO_EMAIL' END
  WHEN site_outcome = 'PARTIAL' THEN 'COMPLETED' WHEN site_outcome = 'CANCELLED' THEN 'CANCELLED'
  ELSE 'FAILED' END AS url_status,
  CASE site_outcome WHEN 'PARTIAL' THEN 'PARTIAL_SCAN' WHEN 'ROBOTS_BLOCKED' THEN 'ROBOTS_BLOCKED'
    WHEN 'CANCELLED' THEN 'JOB_CANCELLED' WHEN 'FAILED' THEN 'SCAN_FAILED' END AS error_code
FROM sites""")
def _(spark, sf):
    status, error = J.url_status(F.col("site_outcome"), F.col("findings"))
    return site_outcomes(spark, sf).select(
        "site", status.alias("url_status"), error.alias("error_code"))


_ITEM = """CASE status WHEN 'COMPLETED' THEN 'COMPLETED' WHEN 'NO_EMAIL' THEN 'COMPLETED_NO_EMAILS'
  WHEN 'RETRY_WAIT' THEN 'PARTIAL' WHEN 'SCANNING' THEN CASE WHEN l_partkey % 50 = 0 THEN 'CANCELLED'
  ELSE 'PARTIAL' END WHEN 'QUEUED' THEN CASE WHEN l_partkey % 3 = 0 THEN 'DUPLICATE_COALESCED'
  ELSE 'INVALID_INPUT' END ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'ROBOTS_BLOCKED'
  ELSE 'FAILED' END END"""


@register("map6_batch_rollup", views("urls", items=f"SELECT job_id, {_ITEM} AS outcome FROM urls") + """
SELECT *, CASE WHEN cancelled_scans > 0 THEN 'CANCELLED' WHEN invalid_inputs > 0 OR failed_scans > 0
  THEN 'PARTIAL' ELSE 'COMPLETED' END AS batch_outcome
FROM (SELECT job_id, count(*) AS total_inputs,
  count(*) FILTER (outcome = 'INVALID_INPUT') AS invalid_inputs,
  count(*) FILTER (outcome = 'DUPLICATE_COALESCED') AS duplicate_coalesced_items,
  count(*) FILTER (outcome IN ('COMPLETED', 'COMPLETED_NO_EMAILS', 'PARTIAL')) AS completed_scans,
  count(*) FILTER (outcome IN ('FAILED', 'ROBOTS_BLOCKED')) AS failed_scans,
  count(*) FILTER (outcome = 'CANCELLED') AS cancelled_scans FROM items GROUP BY job_id)""")
def _(spark, sf):
    items = V.urls(spark, sf).select("job_id", F.expr(_ITEM).alias("outcome"))
    return J.batch_rollup(items, "job_id")


_CODE = """CASE page_outcome WHEN 'ROBOTS_DISALLOWED' THEN 'ROBOTS_BLOCKED'
  WHEN 'ROBOTS_TEMPORARY_FAILURE' THEN 'ROBOTS_FETCH_ERROR' ELSE CASE fetch_outcome
  WHEN 'TIMEOUT' THEN 'TIMEOUT' WHEN 'TRANSPORT_ERROR' THEN 'TRANSPORT_ERROR'
  WHEN 'HTTP_ERROR' THEN 'HTTP_' || status_code END END"""


@register("map7_error_codes", views("urls", **_PAGE_RECORDS, coded=f"""
  SELECT *, {_CODE} AS code FROM records""") + f"""
SELECT site, coalesce(code, 'SCAN_FAILED') AS error_code, coalesce(code IN ('ROBOTS_FETCH_ERROR',
  'TIMEOUT', 'TRANSPORT_ERROR') OR code IN ({quoted(f'HTTP_{s}' for s in ref.RETRYABLE_HTTP_STATUSES)}),
  true) AS retryable
FROM (SELECT site, arg_min(code, visit) FILTER (code IS NOT NULL) AS code FROM coded GROUP BY site)
""")
def _(spark, sf):
    return J.error_classification(page_records(spark, sf), ["site"], "visit")


@register("map8_worker_outcomes", views("urls", **_STATS, w="""
  SELECT *, CASE WHEN site % 41 = 0 THEN 'LEASE_LOST' WHEN site % 43 = 0 THEN 'CRASH' END AS exc,
    CASE WHEN site % 4 < 3 THEN 'RETRYABLE_FAILURE' ELSE 'TERMINAL_FAILURE' END AS again
  FROM sites""") + """
SELECT site, CASE WHEN exc = 'LEASE_LOST' THEN 'LEASE_LOST' WHEN exc IS NOT NULL THEN again
  WHEN site_outcome = 'COMPLETED' THEN 'TERMINAL_SUCCESS'
  WHEN site_outcome = 'COMPLETED_NO_EMAILS' THEN 'TERMINAL_NO_EMAIL'
  WHEN site_outcome = 'ROBOTS_BLOCKED' THEN 'TERMINAL_FAILURE'
  WHEN site_outcome = 'PARTIAL' THEN CASE WHEN pages_fetched > 0 THEN 'TERMINAL_PARTIAL'
    ELSE again END
  WHEN site_outcome = 'CANCELLED' THEN 'CANCELLED'
  WHEN pages_failed > 0 THEN again ELSE 'TERMINAL_FAILURE' END AS worker_outcome FROM w""")
def _(spark, sf):
    site = F.col("site")
    exception = F.when(site % 41 == 0, F.lit("LEASE_LOST")).when(site % 43 == 0, F.lit("CRASH"))
    return site_outcomes(spark, sf).select("site", J.worker_outcome(
        F.col("site_outcome"), F.col("findings"), F.col("pages_fetched"),
        F.col("pages_failed") > 0, site % 4, F.lit(3), exception).alias("worker_outcome"))


@register("map9_fetch_retries", views("urls") + f"""
SELECT url_id, reason IS NOT NULL AS retry, reason FROM (SELECT url_id, CASE
  WHEN url_id % 5 = 0 THEN NULL WHEN fetch_outcome IN ('TIMEOUT', 'TRANSPORT_ERROR')
    THEN fetch_outcome
  WHEN fetch_outcome = 'HTTP_ERROR' AND status_code = 429 THEN 'RETRY_AFTER_HEADER'
  WHEN fetch_outcome = 'HTTP_ERROR'
    AND status_code IN ({', '.join(map(str, ref.RETRYABLE_HTTP_STATUSES))}) THEN 'HTTP_STATUS' END
  AS reason FROM urls)""")
def _(spark, sf):
    method = F.when(F.col("url_id") % 5 == 0, F.lit("POST")).otherwise(F.lit("get"))
    retry, reason = J.fetch_retry(method, F.col("fetch_outcome"), F.col("status_code"))
    return V.urls(spark, sf, numbered=True).select(
        "url_id", retry.alias("retry"), reason.alias("reason"))


@register("map10_retry_schedule", views("urls") + """
SELECT url_id, CAST(a AS INTEGER) AS attempt, 5.0::DOUBLE * (1 << (a - 1)) AS delay_seconds,
  5.0::DOUBLE * ((1 << a) - 1) AS elapsed_seconds,
  least(10.0::DOUBLE, 0.5::DOUBLE * (1 << (a - 1)) * 1.1::DOUBLE) AS request_delay
FROM urls, range(1, 4) t(a) WHERE a <= attempt_count""")
def _(spark, sf):
    rows = V.urls(spark, sf, numbered=True).select("url_id", "attempt_count")
    return J.retry_schedule(rows, "attempt_count").select(
        "url_id", "attempt", "delay_seconds", "elapsed_seconds",
        J.fetch_delay(F.col("attempt")).alias("request_delay"))


@register("map11_retry_after", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN least(60.0::DOUBLE, user_id % 90)
  WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN NULL ELSE 10.0::DOUBLE END AS wait_seconds FROM events""")
def _(spark, sf):
    header = F.when(F.col("event_id") % 4 == 0, (F.col("user_id") % 90).cast("string")).when(
        F.col("event_id") % 4 == 1, F.lit("-5")).when(
        F.col("event_id") % 4 == 2, F.lit("invalid-value")).otherwise(
        F.lit("Wed, 31 Jan 2024 00:00:10 GMT"))
    return V.events(spark, sf).select("event_id", J.retry_after(
        header, V.clock(V.NOW_EVENTS)).alias("wait_seconds"))


@register("map12_derived_counters", views("urls") + """
SELECT job_id, count(*) FILTER (status IN ('QUEUED', 'RETRY_WAIT')) AS queued_actual,
  count(*) FILTER (status = 'SCANNING') AS running_actual,
  count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL')) AS completed_actual,
  count(*) FILTER (status = 'FAILED') AS failed_actual FROM urls GROUP BY job_id""")
def _(spark, sf):
    return J.derived_counters(V.urls(spark, sf)).select(
        "job_id", "queued_actual", "running_actual", "completed_actual", "failed_actual")


# URLs of which all waiting rows are done, so that jobs can end
_DONE = {"done": """SELECT * REPLACE (CASE WHEN status IN ('QUEUED', 'RETRY_WAIT') THEN 'NO_EMAIL'
  WHEN status = 'SCANNING' AND l_suppkey % 4 > 0 THEN 'FAILED' ELSE status END AS status)
  FROM urls"""}


def _done(spark, sf):
    ended = (F.col("status") == "SCANNING") & (F.col("l_suppkey") % 4 > 0)
    return V.urls(spark, sf).withColumn("status", F.when(
        F.col("status").isin("QUEUED", "RETRY_WAIT"), F.lit("NO_EMAIL")).when(
        ended, F.lit("FAILED")).otherwise(F.col("status")))


@register("map13_final_status", views("jobs", **_DONE, c="""
  SELECT job_id, count(*) FILTER (status = 'FAILED') AS failed,
    count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL')) AS done,
    count(*) FILTER (status = 'SCANNING') AS open_rows,
    count(*) FILTER (l_partkey % 9 = 0) AS partial FROM done GROUP BY job_id""") + """
SELECT j.job_id, CASE WHEN j.status = 'CANCELLING' THEN 'CANCELLED'
  WHEN coalesce(failed, 0) = 0 AND coalesce(partial, 0) = 0 THEN 'COMPLETED'
  WHEN coalesce(done, 0) = 0 AND coalesce(failed, 0) = j.valid_input_count THEN 'FAILED'
  ELSE 'COMPLETED_WITH_ERRORS' END AS final_status
FROM jobs j LEFT JOIN c ON c.job_id = j.job_id
WHERE coalesce(open_rows, 0) = 0 AND j.status IN ('QUEUED', 'RUNNING', 'CANCELLING')""")
def _(spark, sf):
    done = _done(spark, sf)
    partial = done.groupBy("job_id").agg(
        F.count_if(F.col("l_partkey") % 9 == 0).alias("partial_count"))
    return J.final_status(V.jobs(spark, sf), done, partial).select("job_id", "final_status")


@register("map14_ready_to_finalize", views("jobs") + """
SELECT job_id, status FROM jobs j WHERE status IN ('RUNNING', 'CANCELLING') AND NOT EXISTS (
  SELECT 1 FROM urls u WHERE u.job_id = j.job_id
  AND u.status IN ('PENDING', 'QUEUED', 'SCANNING', 'RETRY_WAIT'))""")
def _(spark, sf):
    return J.ready_to_finalize(V.job_heads(spark, sf), V.urls(spark, sf)).select(
        "job_id", "status")


_CLOCK = "TIMESTAMP '1998-06-01 00:00:00'"


def middle():
    return V.clock("1998-06-01 00:00:00")


@register("map15_cancellation", views("jobs") + f"""
SELECT u.job_id, new_status, count(*) AS rows, count(DISTINCT new_completed) AS stamps
FROM (SELECT u.job_id, CASE WHEN hit THEN 'CANCELLED' ELSE status END AS new_status,
        CASE WHEN hit THEN {_CLOCK} ELSE completed_at END AS new_completed
      FROM (SELECT u.*, j.job_id IS NOT NULL AND (u.status IN ('QUEUED', 'RETRY_WAIT')
              OR (u.status = 'SCANNING' AND u.lease_expires_at <= {_CLOCK})) AS hit
            FROM urls u LEFT JOIN (SELECT job_id FROM jobs WHERE status = 'RUNNING') j
            ON j.job_id = u.job_id) u) u GROUP BY u.job_id, new_status""")
def _(spark, sf):
    running = V.job_heads(spark, sf).filter(F.col("status") == "RUNNING").select("job_id")
    rows = J.cancel_urls(V.urls(spark, sf), running, middle())
    return rows.groupBy("job_id", "new_status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("new_completed_at").alias("stamps"))


@register("map15_cancelled_jobs", views("jobs") + f"""
SELECT j.job_id, CASE WHEN count(u.job_id) = 0 THEN 'CANCELLED' ELSE 'CANCELLING' END AS new_status
FROM jobs j LEFT JOIN urls u ON u.job_id = j.job_id AND u.status = 'SCANNING'
  AND u.lease_expires_at > {_CLOCK} WHERE j.status = 'RUNNING' GROUP BY j.job_id""")
def _(spark, sf):
    running = V.job_heads(spark, sf).filter(F.col("status") == "RUNNING").select("job_id")
    return J.cancelled_job_status(running, V.urls(spark, sf), middle()).select(
        "job_id", "new_status")


_EXPIRED = {"expired": f"""
  SELECT u.url_id, u.attempt_count, j.status AS parent, u.url_id % 6 <> 0 AS started,
    CASE WHEN u.url_id % 4 = 0 THEN 'RETRY_WAIT' END AS claimed
  FROM urls u JOIN jobs j ON j.job_id = u.job_id
  WHERE u.status = 'SCANNING' AND u.lease_expires_at <= {_CLOCK}"""}


@register("map16_expired_work", views("jobs", **_EXPIRED) + """
SELECT url_id, CASE WHEN parent = 'CANCELLING' THEN 'CANCELLED' WHEN NOT started
  THEN coalesce(claimed, 'QUEUED') WHEN attempt_count < 3 THEN 'RETRY_WAIT' ELSE 'FAILED' END
  AS new_status,
  CASE WHEN parent = 'CANCELLING' THEN 'JOB_CANCELLED' WHEN NOT started THEN NULL
    WHEN attempt_count < 3 THEN 'LEASE_EXPIRED' ELSE 'LEASE_EXPIRED_MAX_ATTEMPTS' END
    AS new_error_code,
  CASE WHEN parent <> 'CANCELLING' AND started AND attempt_count < 3
    THEN 5.0::DOUBLE * (1 << greatest(0, attempt_count - 1)) END AS retry_delay_seconds
FROM expired""")
def _(spark, sf):
    rows = V.urls(spark, sf, numbered=True).withColumns({
        "attempt_started": F.col("url_id") % 6 != 0,
        "claimed_from_status": F.when(F.col("url_id") % 4 == 0, F.lit("RETRY_WAIT"))})
    return J.resolve_expired(rows, V.job_heads(spark, sf), middle()).select(
        "url_id", "new_status", "new_error_code", "retry_delay_seconds")


_CHANGES = """CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING'
  WHEN 'signup' THEN 'CANCELLING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END"""
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in ref.LEGAL_TRANSITIONS)


@register("map17_illegal_transitions", f"""
SELECT event_id, previous_status, new_status FROM (
  SELECT event_id, {_CHANGES} AS new_status, lag({_CHANGES}) OVER (PARTITION BY user_id
    ORDER BY ts, event_id) AS previous_status FROM events)
WHERE previous_status IS NOT NULL AND previous_status <> new_status
  AND (previous_status, new_status) NOT IN ({_LEGAL})""")
def _(spark, sf):
    changes = J.status_changes(
        V.events(spark, sf).withColumn("status", F.expr(_CHANGES)), "user_id", "ts", "event_id")
    return J.illegal_transitions(changes).select("event_id", "previous_status", "new_status")


@register("map18_progress", views("jobs") + """
SELECT job_id, greatest(0, total_input_count - valid_input_count - duplicate_input_count)
  AS invalid_input_count, round(CASE WHEN valid_input_count <= 0 THEN CASE WHEN status IN
  ('COMPLETED', 'COMPLETED_WITH_ERRORS') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE least(100.0::DOUBLE, (completed_count + failed_count)::DOUBLE / valid_input_count * 100)
  END, 2) AS progress_percentage FROM jobs""")
def _(spark, sf):
    return J.progress(V.jobs(spark, sf)).select(
        "job_id", "invalid_input_count", "progress_percentage")


