"""Link discovery, ranking, frontier and robots queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.sql import page_score, page_signals, parsed, registrable, views
from contactgrid import reference_data as ref
from contactgrid.config import SiteScanConfig
from contactgrid.functions import scoring
from contactgrid.operators import frontier, jobs, robots
from contactgrid.operators import links as L
from contactgrid.plans import views as V
from contactgrid.session import materialize
from contactgrid.sources.tables import read_table

TOKEN = "ContactBot"
_CLEAN = r"""regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script>|\z)|<style\b[^>]*>.*?(?:</style>|\z)', '', 'g')"""
_A = r"""(?is)<a\s[^>]*?href="([^"]+)"[^>]*>(.*?)</a\s*>"""
_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""
ANCHORS = {
    **parsed("src", "pages", "page_id", "url"),
    "raw_anchors": f"""
      SELECT page_id, normalized_url AS source_url, scheme, hostname, port, registrable_domain,
        unnest(regexp_extract_all(clean, '{_A}', 1)) AS href,
        unnest(regexp_extract_all(clean, '{_A}', 2)) AS inner_html,
        generate_subscripts(regexp_extract_all(clean, '{_A}', 1), 1) - 1 AS position
      FROM (SELECT *, {_CLEAN} AS clean FROM src)""",
    "anchors": f"SELECT *, {_TEXT} AS link_text FROM raw_anchors",
    "targets": f"""
      SELECT *, {page_score('low_path', 'score_text')} AS score,
        {page_signals('low_path', 'score_text')} AS signals
      FROM (SELECT *, lower(path) AS low_path, lower(path) || ' ' || lower(link_text) AS score_text
        FROM (SELECT *, scheme || '://' || hostname || coalesce(':' || port, '')
                || regexp_replace(href, '#.*$', '') AS url,
                regexp_extract(href, '^([^?#]*)', 1) AS path
              FROM anchors WHERE starts_with(href, '/') AND NOT starts_with(href, '//')))""",
    "kept": rf"""
      SELECT * FROM targets WHERE NOT regexp_matches(low_path,
        '\.(?:{'|'.join(e[1:] for e in ref.ASSET_EXTENSIONS)})$')""",
    "best": """
      SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY page_id, url
        ORDER BY score DESC, length(link_text) DESC, position) = 1""",
    "top": """
      SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER)
        AS rank FROM best""",
    "ranked": f"""
      SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER)
        AS rank FROM (
        SELECT page_id, source_url, url, score, signals FROM top t WHERE url <> source_url OR
          score > (SELECT own FROM home h WHERE h.page_id = t.page_id)
        UNION ALL SELECT h.page_id, source_url, source_url, own, own_signals FROM home h
        WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.page_id = h.page_id
          AND t.url = h.source_url AND t.score > own))""",
}
_HOME = f"""SELECT page_id, normalized_url AS source_url,
  {page_score('lower(path)', "lower(path) || ' home'")} AS own,
  {page_signals('lower(path)', "lower(path) || ' home'")} AS own_signals
  FROM src WHERE error_code IS NULL"""


def _links(*upto: str) -> str:
    ordered = {}
    for name, body in ANCHORS.items():
        if name == "ranked":
            ordered["home"] = _HOME
        ordered[name] = body
        if name in upto:
            break
    return views(**ordered)


def _pages(spark, sf):
    return read_table(spark, sf, "pages")


@register("lnk1_anchors", _links("anchors") + """
SELECT page_id, CAST(position AS INTEGER) AS position, href, link_text FROM anchors""")
def _(spark, sf):
    found = L.raw_anchors(_pages(spark, sf))
    return found.select("page_id", F.explode_outer("found").alias("a")).filter(
        "a is not null").select("page_id", "a.position", "a.href", "a.link_text")


@register("lnk2_resolved_links", _links("targets") + """
SELECT page_id, url, count(*) AS anchors FROM targets GROUP BY page_id, url""")
def _(spark, sf):
    rows = L.resolved_anchors(_pages(spark, sf)).filter(F.col("url").isNotNull())
    return rows.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("anchors"))


@register("lnk3_scope", views(**parsed("src", "pages", "page_id", "url")) + f"""
SELECT page_id, hostname = 'www.' || registrable_domain AS same_origin,
  registrable_domain = {registrable("'www.' || registrable_domain")} AS same_domain,
  hostname = 'shop.example.org' OR registrable_domain = 'example.org' AS in_shop
FROM src""")
def _(spark, sf):
    one = L.with_source(_pages(spark, sf).select("page_id", "url"))
    other = one.select("*", F.concat(
        F.col("source_scheme"), F.lit("://www."), F.col("source_registrable_domain"),
        F.when(F.col("source_port").isNull(), F.lit("")).otherwise(
            F.concat(F.lit(":"), F.col("source_port").cast("string")))).alias("home"))
    home = L.with_source(other.withColumnsRenamed(
        {c: c.replace("source_", "page_") for c in one.columns if c.startswith("source_")}),
        "home")
    home = home.withColumnsRenamed(
        {c: c.replace("source_", "home_") for c in home.columns if c.startswith("source_")})
    shop = L.with_source(home.withColumn("shop", F.lit("https://shop.example.org/")), "shop")
    return shop.select(
        "page_id", L.in_scope(shop, "page_", "home_", "SAME_ORIGIN").alias("same_origin"),
        L.in_scope(shop, "page_", "home_", "SAME_REGISTRABLE_DOMAIN").alias("same_domain"),
        L.in_scope(shop, "page_", "source_", "SAME_REGISTRABLE_DOMAIN").alias("in_shop"))


_EXT = "|".join(e[1:] for e in ref.ASSET_EXTENSIONS)


@register("lnk4_asset_paths", views(**parsed("src", "pages", "page_id", "url")) + rf"""
SELECT page_id, regexp_matches(lower(path || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN
  '.png/x' ELSE '.docx' END), '\.(?:{_EXT})$') AS is_asset FROM src""")
def _(spark, sf):
    df = L.with_source(_pages(spark, sf).select("page_id", "url"))
    tail = F.element_at(F.array(*map(F.lit, (".PNG", ".png/x", ".docx"))),
                        (F.col("page_id") % 3 + 1).cast("int"))
    return df.select("page_id", L.is_asset_path(
        F.concat("source_path", tail), ref.ASSET_EXTENSIONS).alias("is_asset"))


@register("lnk5_page_scores", _links("targets") + """
SELECT page_id, CAST(position AS INTEGER) AS position, score, signals FROM targets""")
def _(spark, sf):
    rows = L.resolved_anchors(_pages(spark, sf)).filter(F.col("url").isNotNull())
    path, text = scoring.scoring_path(F.col("path")), scoring.scoring_text(
        F.col("path"), F.col("link_text"))
    return rows.select("page_id", "position", scoring.page_score(path, text).alias("score"),
                       F.array_join(scoring.page_signals(path, text), ",").alias("signals"))


@register("lnk6_best_links", _links("best") + """
SELECT page_id, url, score, link_text, href AS raw_href FROM best""")
def _(spark, sf):
    return L.link_rows(L.discover_links(_pages(spark, sf))).select(
        "page_id", "url", "score", "link_text", "raw_href")


@register("lnk7_top_links", _links("top") + "SELECT page_id, rank, url, score FROM top")
def _(spark, sf):
    return L.link_rows(L.discover_links(_pages(spark, sf))).select(
        "page_id", "rank", "url", "score")


@register("lnk8_ranked_pages", _links("ranked") + f"""
SELECT page_id, rank, url, score, signals, '{ref.RANKING_VERSION}' AS ranking_version
FROM ranked""")
def _(spark, sf):
    ranked = L.rank_pages(L.discover_links(_pages(spark, sf)))
    return ranked.select("page_id", "rank", "url", "score", F.array_join("signals", ",").alias(
        "signals"), "ranking_version")


@register("lnk9_page_outcomes", _links("top") + """
SELECT p.page_id, CASE WHEN p.error_code IS NOT NULL THEN 'INVALID_SOURCE_URL'
  WHEN count(t.url) > 0 THEN 'SUCCESS' ELSE 'NO_LINKS_DISCOVERED' END AS outcome,
  CAST(count(t.url) AS INTEGER) AS links
FROM src p LEFT JOIN top t ON t.page_id = p.page_id GROUP BY p.page_id, p.error_code""")
def _(spark, sf):
    return L.discover_links(_pages(spark, sf)).select(
        "page_id", "outcome", F.size("links").alias("links"))


# no link of the test corpus leads to another stored page, so depth 1 is as far as a visit gets
BUDGET = SiteScanConfig(max_pages=10, max_depth=2, max_total_discovered_urls=100)
_VISITS = _links("ranked").rstrip() + f"""
, start AS (SELECT page_id, normalized_url, {page_score('lower(path)', "lower(path) || ' '")}
    AS score FROM src WHERE error_code IS NULL),
  stored AS (SELECT page_id, min(page_id) OVER (PARTITION BY normalized_url) AS kept FROM src),
  queue AS (SELECT s.page_id, url, score, 1 AS depth, row_number() OVER (PARTITION BY s.page_id
      ORDER BY score DESC, url) AS n FROM top t JOIN stored s ON s.kept = t.page_id
    WHERE url <> source_url AND rank <= {BUDGET.max_total_discovered_urls}),
  visits AS (SELECT page_id AS site, 1 AS visit, normalized_url AS url, 0 AS depth, score,
      'FETCHED_AND_PROCESSED' AS page_outcome FROM start
    UNION ALL SELECT page_id, CAST(n + 1 AS INTEGER), url, 1, score,
      CASE WHEN n < {BUDGET.max_pages} THEN 'FETCH_FAILED' ELSE 'SKIPPED_BUDGET_REACHED' END
    FROM queue WHERE n < {BUDGET.max_total_discovered_urls})"""


def corpus_visits(spark, sf):
    """Every stored page as a site of its own, visited within `BUDGET` over the stored pages."""
    pages = _pages(spark, sf)
    corpus = materialize(frontier.page_links(L.discover_links(pages)))
    seeds = pages.select(F.col("page_id").alias("site"), "url")
    return frontier.visit_sites(seeds, corpus, BUDGET).select(
        "site", "visit", "url", "depth", "score", "page_outcome")


@register("lnk10_corpus_visits", _VISITS + "SELECT * FROM visits")
def _(spark, sf):
    return corpus_visits(spark, sf)


@register("lnk11_leftovers", _VISITS + """
SELECT site, url, score FROM visits WHERE page_outcome = 'SKIPPED_BUDGET_REACHED'""")
def _(spark, sf):
    return corpus_visits(spark, sf).filter("page_outcome = 'SKIPPED_BUDGET_REACHED'").select(
        "site", "url", "score")


# URL rows as the page records of their job: visiting order is the position in the job
_PAGE_RECORDS = {"records": """
  SELECT job_id AS site, rn AS visit, fetch_outcome, status_code,
    CASE WHEN status = 'QUEUED' THEN 'SKIPPED_BUDGET_REACHED'
      WHEN l_suppkey % 11 = 0 THEN 'ROBOTS_DISALLOWED'
      WHEN l_suppkey % 13 = 0 THEN 'ROBOTS_TEMPORARY_FAILURE'
      WHEN fetch_outcome = 'SUCCESS' THEN 'FETCHED_AND_PROCESSED' ELSE 'FETCH_FAILED' END
      AS page_outcome FROM urls"""}
_STATS = {**_PAGE_RECORDS, "stats": """
  SELECT site, count(*) AS pages_queued,
    count(*) FILTER (page_outcome <> 'SKIPPED_BUDGET_REACHED') AS pages_attempted,
    count(*) FILTER (page_outcome = 'FETCHED_AND_PROCESSED') AS pages_fetched,
    count(*) FILTER (starts_with(page_outcome, 'ROBOTS')) AS pages_blocked_by_robots,
    count(*) FILTER (page_outcome IN ('FETCH_FAILED', 'UNSAFE_HOST')) AS pages_failed,
    arg_min(page_outcome, visit) AS first_page, arg_min(fetch_outcome, visit) AS first_fetch
  FROM records GROUP BY site""", "sites": """
  SELECT *, CASE WHEN site % 97 = 0 THEN 'CANCELLED' WHEN pages_attempted = 0 THEN 'FAILED'
    WHEN pages_attempted = 1 AND first_page IN ('ROBOTS_DISALLOWED', 'ROBOTS_TEMPORARY_FAILURE')
      THEN 'ROBOTS_BLOCKED' WHEN pages_fetched = 0 THEN 'FAILED'
    WHEN pages_failed > 0 THEN 'PARTIAL' WHEN site % 2 > 0 THEN 'COMPLETED'
    ELSE 'COMPLETED_NO_EMAILS' END AS site_outcome FROM stats"""}


def page_records(spark, sf):
    rows = V.urls(spark, sf, numbered=True)
    outcome = (
        F.when(F.col("status") == "QUEUED", F.lit("SKIPPED_BUDGET_REACHED"))
        .when(F.col("l_suppkey") % 11 == 0, F.lit("ROBOTS_DISALLOWED"))
        .when(F.col("l_suppkey") % 13 == 0, F.lit("ROBOTS_TEMPORARY_FAILURE"))
        .when(F.col("fetch_outcome") == "SUCCESS", F.lit("FETCHED_AND_PROCESSED"))
        .otherwise(F.lit("FETCH_FAILED")))
    return rows.select(F.col("job_id").alias("site"), F.col("rn").alias("visit"),
                       "fetch_outcome", "status_code", outcome.alias("page_outcome"))


def site_outcomes(spark, sf):
    stats = jobs.site_statistics(page_records(spark, sf), "site").withColumns({
        "stop_reason": F.when(F.col("site") % 97 == 0, F.lit("CANCELLED")).otherwise(
            F.lit("QUEUE_EXHAUSTED")),
        "findings": F.col("site") % 2})
    return jobs.site_outcome(stats)


@register("lnk12_site_outcomes", views("urls", **_STATS) + """
SELECT site, pages_queued, pages_attempted, pages_fetched, pages_blocked_by_robots, pages_failed,
  site_outcome FROM sites""")
def _(spark, sf):
    return site_outcomes(spark, sf).select(
        "site", "pages_queued", "pages_attempted", "pages_fetched", "pages_blocked_by_robots",
        "pages_failed", "site_outcome")


_FAILURES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ref.FETCH_FAILURE_CODES.items())


@register("lnk13_failure_codes", views("urls", **_STATS) + f"""
SELECT site, site_outcome, CASE
  WHEN site_outcome IN ('COMPLETED', 'COMPLETED_NO_EMAILS') THEN NULL
  WHEN site_outcome = 'CANCELLED' THEN 'CANCELLED'
  WHEN site_outcome = 'ROBOTS_BLOCKED' OR first_page = 'ROBOTS_DISALLOWED' THEN 'ROBOTS_BLOCKED'
  WHEN first_page = 'ROBOTS_TEMPORARY_FAILURE' THEN first_page
  ELSE CASE first_fetch {_FAILURES} END END AS failure_code FROM sites""")
def _(spark, sf):
    return jobs.site_failure_code(site_outcomes(spark, sf)).select(
        "site", "site_outcome", "failure_code")


def robots_files(spark, sf):
    key = F.col("c_custkey")
    body = F.when(key % 5 == 3, F.concat(
        F.lit("# rules\nUser-agent: Other\nDisallow: /\n\nUser-agent: " + TOKEN
              + "\nDisallow: /private\nAllow: /\nCrawl-delay: "), (key % 7).cast("string"),
        F.lit("\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 99\n"))).otherwise(
        F.lit("User-agent: *\nDisallow: /p # all of p\nDisallow:\nCrawl-delay: x\n"
              "Crawl-delay: 2.5\n"))
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("https://s"), key.cast("string"), F.lit(".com")).alias("origin"),
        F.element_at(F.array(*map(F.lit, (403, 503, 404, 200, 200))),
                     (key % 5 + 1).cast("int")).alias("status"), body.alias("body"))


_ROBOTS = """
WITH d AS (SELECT o_orderkey, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '/private/x'
  WHEN 1 THEN '/public' ELSE '/about' END AS path FROM orders JOIN customer ON o_custkey = c_custkey)
"""


@register("lnk14_robots_decisions", _ROBOTS + """
SELECT o_orderkey, CASE k % 5 WHEN 0 THEN 'DISALLOWED' WHEN 1 THEN 'TEMPORARY_FAILURE'
  WHEN 2 THEN 'ALLOWED'
  WHEN 3 THEN CASE WHEN starts_with(path, '/private') THEN 'DISALLOWED' ELSE 'ALLOWED' END
  ELSE CASE WHEN starts_with(path, '/p') THEN 'DISALLOWED' ELSE 'ALLOWED' END END AS decision
FROM d""")
def _(spark, sf):
    return robots.robots_decisions(robot_requests(spark, sf), robots_files(spark, sf), TOKEN
                                   ).select("o_orderkey", "decision")


def robot_requests(spark, sf):
    customers = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        customers, "o_custkey", "left_semi")
    return orders.select(
        "o_orderkey", F.concat(F.lit("https://s"), F.col("o_custkey").cast("string"),
                               F.lit(".com")).alias("origin"),
        F.element_at(F.array(*map(F.lit, ("/private/x", "/public", "/about"))),
                     (F.col("o_orderkey") % 3 + 1).cast("int")).alias("path_query"))


@register("lnk14_rules_by_prefix", """
WITH r AS (SELECT 'https://n' || c_nationkey AS origin, c_custkey, c_custkey % 3 = 0 AS allow,
    CASE WHEN c_custkey % 400 = 399 THEN '*'
      ELSE '/' || left((c_custkey * 7 % 1000)::VARCHAR, CAST(1 + c_custkey % 3 AS INT)) END
      AS prefix FROM customer),
  a AS (SELECT o_orderkey, 'https://n' || (o_orderkey % 25) AS origin,
    '/' || o_custkey || '/' || o_orderkey AS path FROM orders)
SELECT o_orderkey, coalesce(arg_min(allow, c_custkey), true) AS allowed
FROM a LEFT JOIN r ON a.origin = r.origin AND (prefix = '*' OR starts_with(path, prefix))
GROUP BY o_orderkey""")
def _(spark, sf):
    key, order = F.col("c_custkey"), F.col("o_orderkey").cast("string")
    digits = F.substr((key * 7 % 1000).cast("string"), F.lit(1), (key % 3 + 1).cast("int"))
    rules = read_table(spark, sf, "customer").select(
        F.concat(F.lit("https://n"), F.col("c_nationkey").cast("string")).alias("origin"),
        key.alias("ordinal"), (key % 3 == 0).alias("allow"),
        F.when(key % 400 == 399, F.lit("*")).otherwise(F.concat(F.lit("/"), digits)
                                                       ).alias("prefix"))
    asked = read_table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("https://n"), (F.col("o_orderkey") % 25).cast("string")).alias("origin"),
        F.concat_ws("/", F.lit(""), F.col("o_custkey").cast("string"), order).alias("path"))
    decided = robots.allowed_paths(asked, rules)
    return asked.join(decided, ["origin", "path"], "left").select(
        "o_orderkey", F.coalesce("allowed", F.lit(True)).alias("allowed"))


@register("lnk15_crawl_delays", """
SELECT 'https://s' || c_custkey || '.com' AS origin,
  CASE WHEN c_custkey % 5 = 3 THEN CAST(c_custkey % 7 AS DOUBLE) ELSE 2.5::DOUBLE END
  AS crawl_delay FROM customer""")
def _(spark, sf):
    return robots.crawl_delays(robots.rule_lines(robots_files(spark, sf)), TOKEN)


@register("set3_source_and_links", _links("ranked") + """
SELECT page_id, count(*) AS candidates, count(*) FILTER (url = source_url) AS own
FROM ranked GROUP BY page_id""")
def _(spark, sf):
    ranked = L.rank_pages(L.discover_links(_pages(spark, sf)))
    return ranked.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("url") == F.col("source_url")).alias("own"))


