"""Analytics, operations and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.sql import NOW_EVENTS, NOW_ORDERS, quoted, views
from contactgrid import reference_data as ref
from contactgrid.operators import analytics as A
from contactgrid.operators import operations as O
from contactgrid.operators import quality as Q
from contactgrid.plans import views as V
from contactgrid.sources.tables import read_table


def now():
    return V.clock(V.NOW_ORDERS)


_TOTALS = """
SELECT org_id, count(*) AS total_scans, sum(valid_input_count)::BIGINT AS websites_submitted,
  sum(completed_count)::BIGINT AS websites_completed, sum(failed_count)::BIGINT AS websites_failed,
  sum(email_finding_count)::BIGINT AS emails_discovered FROM jobs GROUP BY org_id"""


@register("agg1_job_totals", views("jobs") + _TOTALS)
def _(spark, sf):
    return A.job_totals(V.jobs(spark, sf)).drop(
        "websites_processed", "successful_processing_rate")


@register("agg2_success_rate", views("jobs") + """
SELECT org_id, CASE WHEN sum(completed_count + failed_count) > 0 THEN round(sum(completed_count)
  / sum(completed_count + failed_count) * 100.0::DOUBLE, 2) ELSE 0.0::DOUBLE END
  AS successful_processing_rate FROM jobs GROUP BY org_id""")
def _(spark, sf):
    return A.job_totals(V.jobs(spark, sf)).select("org_id", "successful_processing_rate")


@register("agg3_active_jobs", views("jobs") + """
SELECT org_id, count(*) FILTER (status IN ('QUEUED', 'RUNNING', 'CANCELLING')) AS active_scans
FROM jobs GROUP BY org_id""")
def _(spark, sf):
    return A.active_jobs(V.job_heads(spark, sf))


def _values(names) -> str:
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ")"


@register("agg4_status_distribution", views("jobs") + f"""
SELECT o.org_id, d.status, count(j.job_id) AS count
FROM (SELECT DISTINCT org_id FROM jobs) o CROSS JOIN {_values(ref.JOB_STATUSES)} d(status)
LEFT JOIN jobs j ON j.org_id = o.org_id AND j.status = d.status GROUP BY o.org_id, d.status""")
def _(spark, sf):
    heads = V.job_heads(spark, sf)
    return A.zero_filled(heads, heads, "status", ref.JOB_STATUSES)


@register("agg5_findings_by_class", views("jobs", "findings") + f"""
SELECT o.org_id, d.classification, count(f.finding_id) AS count
FROM (SELECT DISTINCT org_id FROM jobs) o
CROSS JOIN {_values(ref.CLASSIFICATIONS)} d(classification)
LEFT JOIN (SELECT f.*, org_id FROM findings f JOIN jobs USING (job_id)) f
  ON f.org_id = o.org_id AND f.classification = d.classification GROUP BY ALL""")
def _(spark, sf):
    return A.findings_by(V.findings(spark, sf), V.job_heads(spark, sf), "classification",
                         ref.CLASSIFICATIONS)


@register("agg5_findings_by_validation", views("jobs", "findings") + f"""
SELECT o.org_id, d.validation_status, count(f.finding_id) AS count
FROM (SELECT DISTINCT org_id FROM jobs) o
CROSS JOIN {_values(ref.VALIDATION_STATUSES)} d(validation_status)
LEFT JOIN (SELECT f.*, org_id FROM findings f JOIN jobs USING (job_id)) f
  ON f.org_id = o.org_id AND f.validation_status = d.validation_status GROUP BY ALL""")
def _(spark, sf):
    return A.findings_by(V.findings(spark, sf), V.job_heads(spark, sf), "validation_status",
                         ref.VALIDATION_STATUSES)


def _timeline_sql(start: str, where: str) -> str:
    return views("jobs", "findings").rstrip() + f"""
, picked AS (SELECT * FROM jobs WHERE {where}),
  days AS (SELECT org_id, unnest(range(first_day,
      DATE '2001-08-02' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day
    FROM (SELECT org_id, {start} AS first_day FROM jobs GROUP BY org_id))
SELECT d.org_id, strftime(d.day, '%Y-%m-%d') AS date,
  coalesce(s.n, 0) AS scans_created, coalesce(e.n, 0) AS emails_found
FROM days d LEFT JOIN (SELECT org_id, created_at::DATE AS day, count(*) AS n FROM picked
    GROUP BY ALL) s ON s.org_id = d.org_id AND s.day = d.day::DATE
LEFT JOIN (SELECT org_id, first_found_at::DATE AS day, count(*) AS n FROM findings
    JOIN picked USING (job_id) GROUP BY ALL) e ON e.org_id = d.org_id AND e.day = d.day::DATE"""


@register("agg6_timeline_all", _timeline_sql("min(created_at)::DATE", "true"))
def _(spark, sf):
    return A.timeline(V.job_heads(spark, sf), V.findings(spark, sf), now(), "all")


@register("agg6_timeline_90d", _timeline_sql(
    "DATE '2001-05-05'",
    f"created_at >= TIMESTAMP '2001-05-05' AND created_at < {NOW_ORDERS}"))
def _(spark, sf):
    return A.timeline(V.job_heads(spark, sf), V.findings(spark, sf), now(), "90d")


@register("agg7_shares", views("findings") + """
SELECT classification, count(*) AS count, CAST(floor(count(*) / (SELECT count(*) FROM findings)
  * 100 + 0.5) AS BIGINT) AS percent FROM findings GROUP BY classification""")
def _(spark, sf):
    return A.shares(V.findings(spark, sf), "classification")


_WINDOW = 30 * 86_400
_RECENT = f"completed_at >= {NOW_ORDERS} - INTERVAL {_WINDOW} SECOND AND completed_at < {NOW_ORDERS}"


@register("agg8_url_metrics", views("urls") + f"""
SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in (
    'QUEUED', 'LEASED', 'SCANNING', 'RETRY_WAIT', 'COMPLETED', 'NO_EMAIL', 'FAILED'))},
  count(*) FILTER (status IN ('LEASED', 'SCANNING') AND lease_expires_at < {NOW_ORDERS})
    AS expired_leases, coalesce(sum(retry_count), 0)::BIGINT AS retry_total,
  count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL', 'FAILED', 'CANCELLED') AND {_RECENT})
    AS recent_terminal_count FROM urls""")
def _(spark, sf):
    return O.url_metrics(V.urls(spark, sf, numbered=True), now(), _WINDOW).drop(
        "oldest_queued_age_seconds", "recent_throughput_per_second")


@register("agg9_throughput", views("urls") + f"""
SELECT count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL', 'FAILED') AND {_RECENT})
  / {_WINDOW}::DOUBLE AS recent_throughput_per_second,
  greatest(0.0::DOUBLE, (epoch_us({NOW_ORDERS}) - epoch_us(min(created_at)
    FILTER (status = 'QUEUED'))) / 1000000) AS oldest_queued_age_seconds FROM urls""")
def _(spark, sf):
    rows = V.urls(spark, sf).withColumn("retry_count", F.lit(0))
    return O.url_metrics(rows, now(), _WINDOW).select(
        "recent_throughput_per_second", "oldest_queued_age_seconds")


@register("agg10_job_metrics", views("jobs") + f"""
SELECT count(*) FILTER (status IN ({quoted(ref.ACTIVE_JOB_STATUSES)})) AS active,
  count(*) FILTER (status IN ({quoted(ref.TERMINAL_JOB_STATUSES)})) AS terminal,
  (epoch_us({NOW_ORDERS}) - epoch_us(min(coalesce(last_claimed_at, created_at))
    FILTER (status IN ({quoted(ref.ACTIVE_JOB_STATUSES)})))) / 1000000
    AS oldest_active_age_seconds FROM jobs""")
def _(spark, sf):
    heads = V.job_heads(spark, sf).withColumn("started_at", F.col("last_claimed_at"))
    return O.job_metrics(heads, now())


@register("agg11_worker_presence", f"""
SELECT event_type AS state, count(*) AS workers,
  count(*) FILTER (ts < {NOW_EVENTS} - INTERVAL 45 SECOND) AS stale
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) = 1) GROUP BY event_type""")
def _(spark, sf):
    return O.worker_presence(V.presence(spark, sf), V.clock(V.NOW_EVENTS))


@register("agg12_counter_mismatches", views("jobs") + """
SELECT j.job_id, left(sha256(CAST(j.job_id AS VARCHAR)), 16) AS reference_digest
FROM jobs j LEFT JOIN counters c USING (job_id)
WHERE (j.queued_count, j.running_count, j.completed_count, j.failed_count) IS DISTINCT FROM
  (coalesce(c.derived_queued, 0), coalesce(c.running_count, 0), coalesce(c.completed_count, 0),
   coalesce(c.failed_count, 0))""")
def _(spark, sf):
    return O.counter_mismatches(V.jobs(spark, sf), V.urls(spark, sf)).select(
        "job_id", "reference_digest")


@register("agg13_idle_jobs", views("jobs") + f"""
SELECT job_id, CASE WHEN terminal >= valid_input_count THEN 'all_work_terminal'
  ELSE 'no_active_work' END AS reason FROM (
  SELECT j.job_id, j.total_input_count AS valid_input_count,
    count(*) FILTER (u.status IN ('QUEUED', 'SCANNING', 'RETRY_WAIT')) AS active,
    count(*) FILTER (u.status IN ('COMPLETED', 'NO_EMAIL', 'FAILED')) AS terminal
  FROM jobs j LEFT JOIN urls u USING (job_id)
  WHERE j.status IN ({quoted(ref.ACTIVE_JOB_STATUSES)}) GROUP BY ALL) WHERE active = 0""")
def _(spark, sf):
    rows = V.jobs(spark, sf).withColumn("valid_input_count", F.col("total_input_count"))
    return O.idle_jobs(rows, V.urls(spark, sf)).select("job_id", "reason")


@register("agg14_due_items", views("urls").rstrip() + f"""
, due AS (SELECT url_id, CASE WHEN status = 'SCANNING' THEN 'expired_lease' ELSE 'retry_due' END
    AS reason, coalesce(lease_expires_at, next_retry_at) AS due_at FROM urls
  WHERE (status = 'SCANNING' AND lease_expires_at < {NOW_ORDERS})
    OR (status = 'RETRY_WAIT' AND next_retry_at <= {NOW_ORDERS}))
SELECT reason, url_id, CAST(row_number() OVER (PARTITION BY reason ORDER BY due_at, url_id)
  AS INTEGER) AS position, count(*) OVER (PARTITION BY reason) AS total,
  count(*) OVER (PARTITION BY reason) > 50 AS truncated FROM due QUALIFY position <= 50""")
def _(spark, sf):
    return O.due_report(V.urls(spark, sf, numbered=True), now(), 50).drop("reference_digest")


@register("agg16_percentiles", views("urls") + """
SELECT status, quantile_cont(total_duration_seconds, 0.5) AS p50,
  quantile_cont(total_duration_seconds, 0.95) AS p95,
  quantile_cont(total_duration_seconds, 0.99) AS p99 FROM urls GROUP BY status""")
def _(spark, sf):
    return Q.latency_percentiles(V.urls(spark, sf), "total_duration_seconds", ["status"])


@register("agg17_upper_median", views("urls") + """
SELECT job_id, total_duration_seconds AS median, n FROM (SELECT job_id, total_duration_seconds,
  row_number() OVER (PARTITION BY job_id ORDER BY total_duration_seconds) AS r,
  count(*) OVER (PARTITION BY job_id) AS n FROM urls) WHERE r = n // 2 + 1""")
def _(spark, sf):
    return Q.upper_median(V.urls(spark, sf), "total_duration_seconds", ["job_id"])


@register("agg18_run_metrics", views("urls") + """
SELECT job_id, count(*) AS size, count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL'))
  AS success_count, count(*) FILTER (status = 'FAILED') AS failure_count,
  sum(retry_count)::BIGINT AS retry_total, round(sum(total_duration_seconds), 6) AS elapsed_seconds,
  round(count(*) / sum(total_duration_seconds), 6) AS urls_per_second FROM urls GROUP BY job_id""")
def _(spark, sf):
    return Q.run_metrics(V.urls(spark, sf, numbered=True), ["job_id"], "total_duration_seconds"
                         ).withColumns({
        "elapsed_seconds": F.round("elapsed_seconds", 6),
        "urls_per_second": F.round("urls_per_second", 6)})


_METRICS = ("median_elapsed_seconds", "urls_per_second", "peak_memory_bytes")
_SCENARIO = """SELECT l_suppkey AS scenario, round(avg(l_quantity), 6) AS median_elapsed_seconds,
  round(count(*) / sum(l_quantity), 9) AS urls_per_second, max(l_partkey)::DOUBLE AS peak_memory_bytes
  FROM lineitem WHERE l_linestatus = '{}' GROUP BY l_suppkey"""


@register("agg19_baseline_comparison", f"""
WITH c AS (UNPIVOT ({_SCENARIO.format('O')}) ON {', '.join(_METRICS)} INTO NAME metric VALUE current_value),
  b AS (UNPIVOT ({_SCENARIO.format('F')}) ON {', '.join(_METRICS)} INTO NAME metric VALUE baseline)
SELECT c.scenario, c.metric, round(current_value - baseline, 6) AS diff,
  round((current_value - baseline) / baseline * 100.0, 2) AS pct_change
FROM c JOIN b ON b.scenario = c.scenario AND b.metric = c.metric WHERE baseline > 0""")
def _(spark, sf):
    def scenario(flag):
        rows = read_table(spark, sf, "lineitem").filter(F.col("l_linestatus") == flag)
        return rows.groupBy(F.col("l_suppkey").alias("scenario")).agg(
            F.round(F.avg("l_quantity"), 6).alias("median_elapsed_seconds"),
            F.round(F.count(F.lit(1)) / F.sum("l_quantity"), 9).alias("urls_per_second"),
            F.max("l_partkey").alias("peak_memory_bytes"))

    return Q.compare_baseline(scenario("O"), scenario("F"), "scenario", _METRICS).select(
        "scenario", "metric", F.round("diff", 6).alias("diff"), "pct_change")


@register("agg20_duplicate_groups", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(spark, sf):
    return Q.duplicate_groups(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_CHECKS = """
SELECT j.job_id, coalesce(u.success, 0) = size AS success_total, coalesce(u.failure, 0) = 0
  AS failure_total, coalesce(u.n, 0) = size AS attempt_rows, coalesce(f.n, 0) = size AS finding_rows,
  coalesce(d.n, 0) = 0 AS duplicate_attempts, true AS duplicate_findings,
  coalesce(u.others, 0) = 0 AS sequential_attempts, coalesce(u.open_rows, 0) = 0 AS nonterminal_rows,
  coalesce(u.leased, 0) = 0 AS uncleared_claims,
  queued_count = 0 AND running_count = 0 AND completed_count = size AND failed_count = 0
    AND email_finding_count = size AS job_counters
FROM (SELECT *, valid_input_count AS size FROM jobs) j
LEFT JOIN (SELECT job_id, count(*) AS n, count(*) FILTER (status IN ('COMPLETED', 'NO_EMAIL'))
    AS success, count(*) FILTER (status = 'FAILED') AS failure,
    count(*) FILTER (l_suppkey % 3 <> 1) AS others,
    count(*) FILTER (status NOT IN ('COMPLETED', 'NO_EMAIL', 'FAILED', 'CANCELLED')) AS open_rows,
    count(lease_expires_at) AS leased FROM urls GROUP BY job_id) u USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM findings GROUP BY job_id) f USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM (SELECT job_id, l_partkey % 40 AS k FROM urls
    GROUP BY job_id, k, l_suppkey % 3 HAVING count(*) > 1) GROUP BY job_id) d USING (job_id)"""


@register("agg21_load_invariants", views("jobs", "findings") + _CHECKS)
def _(spark, sf):
    rows = V.urls(spark, sf)
    attempts = rows.select("job_id", (F.col("l_partkey") % 40).alias("url_id"),
                           (F.col("l_suppkey") % 3).alias("attempt_number"))
    return Q.load_invariants(
        V.jobs(spark, sf), rows, attempts, V.findings(spark, sf)).drop("violations", "violated")


@register("agg22_constraint_audit", views("jobs").rstrip() + """
, broken AS (SELECT count(*) FILTER (queued_count + running_count + completed_count + failed_count
    > valid_input_count) AS processed, count(*) FILTER (valid_input_count + duplicate_input_count
    > total_input_count) AS dup FROM jobs)
SELECT rule, CASE rule WHEN 'processed_le_valid' THEN processed WHEN 'valid_dup_le_total' THEN dup
  ELSE 0 END AS violations FROM broken, (VALUES ('status_allowed'), ('total_input_count_nonnegative'),
  ('valid_input_count_nonnegative'), ('duplicate_input_count_nonnegative'),
  ('queued_count_nonnegative'), ('running_count_nonnegative'), ('completed_count_nonnegative'),
  ('failed_count_nonnegative'), ('email_finding_count_nonnegative'), ('valid_le_total'),
  ('duplicate_le_total'), ('valid_dup_le_total'), ('processed_le_valid')) r(rule)""")
def _(spark, sf):
    return Q.constraint_audit(V.jobs(spark, sf), Q.constraint_rules())


@register("agg22_uniqueness_audit", """
SELECT 'order_line' AS rule, count(*) AS violations FROM (SELECT 1 FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'order_part', count(*) FROM (SELECT 1 FROM lineitem
  GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)""")
def _(spark, sf):
    return Q.uniqueness_audit(read_table(spark, sf, "lineitem"), {
        "order_line": ["l_orderkey", "l_linenumber"], "order_part": ["l_orderkey", "l_partkey"]})


@register("agg23_phase_timings", """
SELECT phase, count(*) AS samples, round(avg(seconds), 6) AS mean_seconds,
  max(seconds) AS max_seconds, quantile_cont(seconds, 0.95) AS p95_seconds
FROM (SELECT 'dns' AS phase, l_discount AS seconds FROM lineitem UNION ALL
  SELECT 'robots', l_tax FROM lineitem UNION ALL SELECT 'total', l_quantity FROM lineitem)
GROUP BY phase""")
def _(spark, sf):
    return Q.phase_summary(read_table(spark, sf, "lineitem"), {
        "dns": F.col("l_discount"), "robots": F.col("l_tax"), "total": F.col("l_quantity")}
    ).withColumn("mean_seconds", F.round("mean_seconds", 6))


@register("win8_failure_reasons", views("urls") + f"""
SELECT last_failure_code, count(*) AS count FROM urls WHERE status = 'FAILED' AND {_RECENT}
GROUP BY last_failure_code ORDER BY count(*) DESC, last_failure_code LIMIT 20""")
def _(spark, sf):
    return O.failure_reasons(V.urls(spark, sf), now(), _WINDOW)


