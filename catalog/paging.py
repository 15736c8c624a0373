"""Tenant scope, filters, paging and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.sql import NOW_ORDERS, views
from contactgrid.operators import paging as P
from contactgrid.operators.addresses import coalesce_batch, inherit_results
from contactgrid.operators.hostpolicy import classify_addresses, with_block
from contactgrid.operators.keyed import sequence_within
from contactgrid.plans import views as V
from contactgrid.sources.tables import read_table


@register("fil1_tenant_scope", views("jobs", "findings") + """
SELECT org_id, count(*) AS findings, count(DISTINCT f.job_id) AS jobs
FROM findings f JOIN jobs j ON j.job_id = f.job_id GROUP BY org_id""")
def _(spark, sf):
    scoped = P.tenant_scope(V.findings(spark, sf), V.job_heads(spark, sf))
    return scoped.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("job_id").alias("jobs"))


@register("fil2_optional_filters", views("findings") + """
SELECT finding_id, canonical_email FROM findings
WHERE classification = 'ROLE_BASED' AND validation_status = 'VALID'""")
def _(spark, sf):
    return P.optional_filters(
        V.findings(spark, sf), classification="ROLE_BASED", validation_status="VALID",
        email_domain=None).select("finding_id", "canonical_email")


@register("fil3_prefix_search", views("findings") + """
SELECT finding_id, canonical_email FROM findings WHERE starts_with(canonical_email, 'c1')""")
def _(spark, sf):
    return P.prefix_search(V.findings(spark, sf), "canonical_email", "c1").select(
        "finding_id", "canonical_email")


@register("fil4_keyset_ascending", views("findings") + """
SELECT canonical_email, finding_id, CAST(row_number() OVER (ORDER BY canonical_email, finding_id)
  AS INTEGER) AS position, true AS has_more FROM findings
WHERE (canonical_email, finding_id) > ('c10@', 0) ORDER BY canonical_email, finding_id LIMIT 100""")
def _(spark, sf):
    page = P.keyset_page(V.findings(spark, sf), ["canonical_email", "finding_id"], 100,
                         after=["c10@", 0])
    return page.select("canonical_email", "finding_id", "position", "has_more")


@register("fil5_keyset_descending", views("jobs") + """
SELECT job_id, CAST(created_at AS VARCHAR) AS created_at, CAST(row_number() OVER (
  ORDER BY created_at DESC, job_id DESC) AS INTEGER) AS position, true AS has_more
FROM jobs WHERE (created_at, job_id) < (TIMESTAMP '2000-01-01', 50)
ORDER BY jobs.created_at DESC, job_id DESC LIMIT 100""")
def _(spark, sf):
    page = P.keyset_page(
        V.job_heads(spark, sf).select("job_id", "created_at"), ["created_at", "job_id"], 100,
        after=[V.clock("2000-01-01 00:00:00"), 50], descending=True)
    return page.select("job_id", F.col("created_at").cast("string"), "position", "has_more")


@register("fil6_page_numbers", views("urls") + """
SELECT url_id, (row_number() OVER (PARTITION BY job_id ORDER BY original_index, url_id) - 1) // 3
  AS page_no FROM urls""")
def _(spark, sf):
    rows = V.urls(spark, sf, numbered=True).select("job_id", "original_index", "url_id")
    placed = sequence_within(rows, ["job_id"], [F.col("original_index"), F.col("url_id")],
                             F.floor(F.col("original_index") / 100_000), "n")
    return placed.select("url_id", F.floor((F.col("n") - 1) / 3).alias("page_no"))


@register("fil6_event_page", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS position,
  true AS has_more FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', -1)
ORDER BY ts, event_id LIMIT 50""")
def _(spark, sf):
    page = P.keyset_page(
        V.events(spark, sf).select("ts", "event_id"), ["ts", "event_id"], 50,
        after=[V.clock("2024-01-10 00:00:00"), -1])
    return page.select("event_id", "position", "has_more")


@register("fil7_cursor_round_trip", """
SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS priority,
  CAST(NULL AS VARCHAR) AS other FROM orders""")
def _(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    token = P.encode_cursor("jobs", [F.col("o_orderpriority"), F.col("o_orderkey")])
    back = P.decode_cursor(F.col("token"), "jobs", 2)
    return rows.withColumn("token", token).select(
        "o_orderkey", F.get(back, F.lit(1)).alias("key"), F.get(back, F.lit(0)).alias("priority"),
        F.get(P.decode_cursor(F.col("token"), "events", 2), F.lit(0)).alias("other"))


@register("fil8_periods", views("jobs") + f"""
SELECT period, count(*) AS jobs, CAST(min(created_at) AS VARCHAR) AS first_job
FROM jobs JOIN (VALUES ('7d', TIMESTAMP '2001-07-27'), ('30d', TIMESTAMP '2001-07-04'),
  ('90d', TIMESTAMP '2001-05-05'), ('all', TIMESTAMP '1900-01-01')) p(period, start_at)
  ON created_at >= start_at AND (period = 'all' OR created_at < {NOW_ORDERS})
GROUP BY period""")
def _(spark, sf):
    rows = V.job_heads(spark, sf).select("job_id", "created_at")
    held = []
    for period in ("7d", "30d", "90d", "all"):
        start, end = P.period_bounds(V.clock(V.NOW_ORDERS), period)
        inside = F.lit(True) if start is None else (
            (F.col("created_at") >= start) & (F.col("created_at") < end))
        held.append(F.when(inside, F.lit(period)))
    listed = rows.withColumn("period", F.explode(F.array_compact(F.array(*held))))
    return listed.groupBy("period").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("created_at").cast("string").alias("first_job"))


# --- joins -----------------------------------------------------------------------------------
@register("joi1_child_to_parent", views("jobs") + """
SELECT org_id, u.status, count(*) AS rows FROM urls u JOIN jobs j ON j.job_id = u.job_id
GROUP BY org_id, u.status""")
def _(spark, sf):
    return P.tenant_scope(V.urls(spark, sf), V.job_heads(spark, sf)).groupBy(
        "org_id", "status").agg(F.count(F.lit(1)).alias("rows"))


@register("joi2_attached_parent", views("findings", "urls") + """
SELECT url_id, u.status, canonical_email FROM urls u LEFT JOIN findings f ON f.job_id = u.job_id""")
def _(spark, sf):
    found = V.findings(spark, sf).select("job_id", "canonical_email")
    return V.urls(spark, sf, numbered=True).join(found, "job_id", "left").select(
        "url_id", "status", "canonical_email")


@register("joi3_anti_join", views("jobs") + """
SELECT job_id FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM urls u WHERE u.job_id = j.job_id
  AND u.status = 'FAILED')""")
def _(spark, sf):
    failed = V.urls(spark, sf).filter(F.col("status") == "FAILED").select("job_id")
    return V.job_heads(spark, sf).join(failed, "job_id", "left_anti").select("job_id")


@register("joi4_semi_join", views("jobs") + """
SELECT status, count(*) AS rows FROM urls WHERE job_id IN (SELECT job_id FROM jobs
  WHERE status IN ('QUEUED', 'RUNNING')) GROUP BY status""")
def _(spark, sf):
    active = V.job_heads(spark, sf).filter(F.col("status").isin("QUEUED", "RUNNING"))
    return V.urls(spark, sf).join(active.select("job_id"), "job_id", "left_semi").groupBy(
        "status").agg(F.count(F.lit(1)).alias("rows"))


@register("joi5_duplicate_to_owner", """
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages),
  o AS (SELECT *, min(page_id) OVER (PARTITION BY host) AS owner FROM p)
SELECT page_id AS original_index, owner <> page_id AS is_duplicate, 'result-' || owner AS result
FROM o""")
def _(spark, sf):
    rows = read_table(spark, sf, "pages").select(
        F.col("page_id").alias("original_index"),
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("original_input"))
    batch = coalesce_batch(rows)
    owners = batch.filter(F.col("item_role") == "OWNER").select(
        "original_index", F.concat(F.lit("result-"), F.col("original_index").cast("string")
                                   ).alias("result"))
    return inherit_results(batch, owners).select("original_index", "is_duplicate", "result")


_BLOCK = """CASE o_custkey % 4 WHEN 0 THEN '10.' || (o_orderkey % 256) || '.0.1' WHEN 1 THEN
  '192.168.' || (o_orderkey % 256) || '.9' WHEN 2 THEN '100.64.' || (o_orderkey % 256) || '.9'
  ELSE '9.9.' || (o_orderkey % 256) || '.9' END"""


@register("joi7_address_blocks", f"""
SELECT o_custkey % 4 = 0 OR o_custkey % 4 = 1 AS unsafe, o_custkey % 4 = 3 AS is_global,
  count(*) AS rows, count(DISTINCT {_BLOCK}) AS addresses FROM orders GROUP BY ALL""")
def _(spark, sf):
    rows = read_table(spark, sf, "orders").select(F.expr(_BLOCK).alias("text"))
    return classify_addresses(rows, "text").groupBy("unsafe", "is_global").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("text").alias("addresses"))


@register("joi7_block_table", """
WITH b AS (SELECT (10 + c_custkey % 3) || '.' || (c_custkey % 256) || '.' || (c_custkey * 7 % 256)
      || '.0/' || (8 + c_custkey % 17) AS block, 8 + c_custkey % 17 AS size,
    (10 + c_custkey % 3) * 16777216 + c_custkey % 256 * 65536 + c_custkey * 7 % 256 * 256 AS n
    FROM customer),
  c AS (SELECT size, n // (1 << (32 - size))::BIGINT AS net, min(block) AS block
    FROM b GROUP BY ALL),
  a AS (SELECT o_orderkey, (9 + o_orderkey % 5) * 16777216 + o_custkey % 256 * 65536
    + o_orderkey * 7 % 256 * 256 + o_orderkey % 256 AS n FROM orders),
  s AS (SELECT DISTINCT size FROM c),
  m AS (SELECT o_orderkey, s.size, n // (1 << (32 - s.size))::BIGINT AS net FROM a, s)
SELECT a.o_orderkey, arg_max(c.block, c.size) AS matched_block
FROM a LEFT JOIN m ON a.o_orderkey = m.o_orderkey
  LEFT JOIN c ON c.size = m.size AND c.net = m.net GROUP BY a.o_orderkey""")
def _(spark, sf):
    def dotted(*parts):
        return F.concat_ws(".", *[part.cast("string") for part in parts])

    key, order = F.col("c_custkey"), F.col("o_orderkey")
    network = dotted(key % 3 + 10, key % 256, key * 7 % 256, F.lit(0))
    blocks = read_table(spark, sf, "customer").select(
        F.concat_ws("/", network, (key % 17 + 8).cast("string")).alias("block"))
    rows = read_table(spark, sf, "orders").select("o_orderkey", dotted(
        order % 5 + 9, F.col("o_custkey") % 256, order * 7 % 256, order % 256).alias("address"))
    return with_block(rows, blocks).select("o_orderkey", "matched_block")
