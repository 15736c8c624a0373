"""Window, fair-pick and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.sql import NOW_ORDERS, views
from contactgrid.operators import analytics, quality
from contactgrid.operators import scheduling as S
from contactgrid.operators.addresses import coalesce_batch, interleave_by_domain
from contactgrid.operators.keyed import top_per_key
from contactgrid.plans import views as V
from contactgrid.sources.tables import read_table


@register("win1_top_evidence", views("evidence") + """
SELECT finding_id, evidence_id, CAST(row_number() OVER (PARTITION BY finding_id
  ORDER BY created_at, evidence_id) AS INTEGER) AS rank FROM evidence QUALIFY rank <= 3""")
def _(spark, sf):
    return top_per_key(
        V.evidence(spark, sf), ["finding_id"], [F.col("created_at"), F.col("evidence_id")], 3,
        "rank").select("finding_id", "evidence_id", "rank")


_PICK = {"ranked": """
  SELECT *, row_number() OVER (PARTITION BY org_id ORDER BY last_claimed_at NULLS FIRST,
    created_at, job_id) AS tenant_rank FROM jobs
  WHERE status IN ('QUEUED', 'RUNNING') AND completed_count + failed_count < valid_input_count""",
         "picked": """
  SELECT * FROM ranked WHERE tenant_rank <= 2
  ORDER BY last_claimed_at NULLS FIRST, created_at, job_id LIMIT 10"""}


@register("win2_fair_jobs", views("jobs", **_PICK) + """
SELECT job_id, org_id, CAST(tenant_rank AS INTEGER) AS tenant_rank FROM picked""")
def _(spark, sf):
    return S.fair_jobs(V.jobs(spark, sf)).select("job_id", "org_id", "tenant_rank")


def _fair_sql(first: str, second: str) -> str:
    return views("jobs", **_PICK, classed=f"""
  SELECT u.*, p.last_claimed_at, CASE WHEN {first} THEN 0 ELSE 1 END AS class_rank
  FROM urls u JOIN picked p ON p.job_id = u.job_id
  WHERE (({first}) OR ({second})) AND attempt_count < max_attempts""", placed="""
  SELECT *, row_number() OVER (PARTITION BY class_rank, job_id ORDER BY created_at, url_id)
    AS job_rank FROM classed QUALIFY job_rank <= 5""") + """
SELECT url_id, CAST(job_rank AS INTEGER) AS job_rank, CAST(row_number() OVER (
  ORDER BY last_claimed_at NULLS FIRST, job_rank, created_at, url_id) AS INTEGER) AS position
FROM placed WHERE class_rank = (SELECT min(class_rank) FROM placed)
ORDER BY last_claimed_at NULLS FIRST, job_rank, created_at, url_id LIMIT 50"""


_QUEUED = "u.status = 'QUEUED'"
_DUE = f"u.status = 'RETRY_WAIT' AND u.next_retry_at <= {NOW_ORDERS}"


@register("win3_fair_urls", _fair_sql(_QUEUED, _DUE))
def _(spark, sf):
    picked = S.fair_jobs(V.jobs(spark, sf))
    return S.fair_urls(V.urls(spark, sf, numbered=True), picked, V.clock(V.NOW_ORDERS)).select(
        "url_id", "job_rank", "position")


@register("win3_fair_urls_retry_first", _fair_sql(_DUE, _QUEUED))
def _(spark, sf):
    picked = S.fair_jobs(V.jobs(spark, sf))
    return S.fair_urls(V.urls(spark, sf, numbered=True), picked, V.clock(V.NOW_ORDERS),
                       prefer_retry=True).select("url_id", "job_rank", "position")


_WIN4 = """, sums AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY domain ORDER BY arrival, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM stepped)
SELECT domain, seq, CAST(s + max(arrival - s) OVER (PARTITION BY domain ORDER BY arrival, seq)
  AS BIGINT) AS scheduled FROM sums"""


@register("win4_politeness_schedule", views("requests", stepped="""
  SELECT *, interval_us * 3600 AS step FROM requests""").rstrip() + _WIN4)
def _(spark, sf):
    rows = V.requests(spark, sf).withColumn("step", F.col("interval") * 3600)
    return S.politeness_schedule(rows, interval="step").select("domain", "seq", "scheduled")


@register("win5_effective_intervals", views("requests") + """
SELECT domain, seq, max(greatest(coalesce(learned, 1000000), 1000000)) OVER (PARTITION BY domain
  ORDER BY arrival, seq) AS effective_interval FROM requests""")
def _(spark, sf):
    return S.effective_intervals(V.requests(spark, sf)).select(
        "domain", "seq", "effective_interval")


_HALF_HOUR = 1_800_000_000


@register("win6_burst_audit", f"""
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
  RANGE BETWEEN {_HALF_HOUR - 1} PRECEDING AND CURRENT ROW) AS attempts_in_window,
  count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
  RANGE BETWEEN {_HALF_HOUR - 1} PRECEDING AND CURRENT ROW) > 2 AS over_limit FROM events""")
def _(spark, sf):
    rows = V.events(spark, sf).select("event_id", "event_type", F.unix_micros("ts").alias("at"))
    return S.burst_audit(rows, "event_type", "at", limit=2, window=_HALF_HOUR).select(
        "event_id", "attempts_in_window", "over_limit")


@register("win7_recent_completed", views("jobs") + """
SELECT org_id, job_id, CAST(row_number() OVER (PARTITION BY org_id
  ORDER BY completed_at DESC NULLS LAST, job_id DESC) AS INTEGER) AS position FROM jobs
WHERE status IN ('COMPLETED', 'COMPLETED_WITH_ERRORS') QUALIFY position <= 5""")
def _(spark, sf):
    return analytics.recent_completed(V.job_heads(spark, sf)).select(
        "org_id", "job_id", "position")


@register("win9_pages_in_order", r"""
SELECT page_id, CAST(length(regexp_replace(path, '[^/]', '', 'g')) AS INTEGER) AS depth, url
FROM (SELECT page_id, url, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages)
ORDER BY depth, url""")
def _(spark, sf):
    path = F.regexp_extract("url", "://[^/?#]+([^?#]*)", 1)
    return read_table(spark, sf, "pages").select(
        "page_id", F.length(F.regexp_replace(path, "[^/]", "")).alias("depth"), "url").orderBy(
        "depth", "url")


@register("win10_attempt_numbering", views("urls") + """
SELECT job_id AS url_id, attempt_number, expected_number FROM (
  SELECT job_id, CASE WHEN l_suppkey % 25 = 0 THEN rn + 1 ELSE rn END AS attempt_number,
    row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN l_suppkey % 25 = 0 THEN rn + 1
      ELSE rn END) AS expected_number FROM urls) WHERE attempt_number <> expected_number""")
def _(spark, sf):
    number = F.when(F.col("l_suppkey") % 25 == 0, F.col("rn") + 1).otherwise(F.col("rn"))
    rows = V.urls(spark, sf, numbered=True).select(
        F.col("job_id").alias("url_id"), number.alias("attempt_number"))
    return quality.attempt_numbering(
        rows, "attempt_number", F.floor(F.col("attempt_number") / 1000))


@register("win11_domain_round_robin", """
WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages)
SELECT *, row_number() OVER (ORDER BY domain_rank, domain_key) AS position FROM (
  SELECT original_index, domain_key, row_number() OVER (PARTITION BY domain_key
  ORDER BY original_index) AS domain_rank FROM (
  SELECT min(page_id) AS original_index, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain_key
  FROM p GROUP BY host))""")
def _(spark, sf):
    rows = read_table(spark, sf, "pages").select(
        F.col("page_id").alias("original_index"),
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("original_input"))
    work = coalesce_batch(rows).filter(F.col("item_role") == "OWNER").select(
        "original_index", "domain_key")
    return interleave_by_domain(work).select(
        "original_index", "domain_key", "domain_rank", "position")
