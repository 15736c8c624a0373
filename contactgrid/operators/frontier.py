"""Best-first visit of sites over a stored corpus, exact and with bounded groups.

The budgets bound what can matter for a site. Its start page alone fixes the candidates of the
next depth (at most `max_total_discovered_urls`), and of any page only the first
`max_total_discovered_urls` ranked links can ever be taken: at most that many are known already,
and no more than that many free places exist. So one join per depth fetches the pages a site could
visit, whatever the size of the site, and the visit order is then decided on that bounded set.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.config import SiteScanConfig
from contactgrid.functions import scoring
from contactgrid.operators.keyed import winner_per_key
from contactgrid.operators.links import with_source
from contactgrid.session import materialize, ship_package

_VISIT_SCHEMA = (
    "{name} {kind}, visit int, url string, depth int, score int, page_outcome string,"
    " fetch_outcome string, links_discovered int, stop_reason string, urls_discovered int")


def page_links(discovered: DataFrame) -> DataFrame:
    """Link lists keyed by page address: (url, links of (url, score)).

    Pages stored twice under one normalized address count once: the smallest page id is kept.
    """
    links = F.transform("links", lambda k: F.struct(
        k["url"].alias("url"), k["score"].alias("score")))
    listed = discovered.filter(F.col("source_error_code").isNull()).select(
        F.col("source_normalized_url").alias("url"), "page_id", links.alias("links"),
        F.size("links").alias("links_discovered"))
    return winner_per_key(listed, ["url"], [F.col("page_id")]).drop("page_id")


def reachable_pages(
    seeds: DataFrame, corpus: DataFrame, site: str, config: SiteScanConfig
) -> DataFrame:
    """Pages each site could visit: (site, url, depth, score at first sight, page content).

    `seeds` has (site, url); `corpus` is the output of `page_links`, optionally with
    `robots_decision` and `fetch_outcome`. Addresses outside the corpus stay without links.
    """
    level = seeds.select(site, "url").distinct()
    found = None
    for depth in range(config.max_depth + 1):
        # written once: the next level and the result both read it
        fetched = materialize(level.join(corpus, "url", "left").withColumn("level", F.lit(depth)))
        found = fetched if found is None else found.unionByName(fetched)
        if depth < config.max_depth:
            level = fetched.select(site, F.explode(F.slice(
                "links", 1, config.max_total_discovered_urls)).alias("link")).select(
                site, F.col("link.url").alias("url")).distinct()
    return found


def visit_sites(
    seeds: DataFrame, corpus: DataFrame, config: SiteScanConfig, site: str = "site",
) -> DataFrame:
    """Page records per site in visiting order, then the leftover pages of the frontier.

    `seeds` has (site, url) with one normalized start address per site. Order: score, depth,
    address, sequence. Leftovers are SKIPPED_BUDGET_REACHED.
    """
    for name, default in (("robots_decision", "ALLOWED"), ("fetch_outcome", None)):
        if name not in corpus.columns:
            corpus = corpus.withColumn(name, F.lit(default).cast("string"))
    start = with_source(seeds.select(site, "url"))
    path = F.col("source_path")
    start = start.select(
        site, F.col("source_normalized_url").alias("url"),
        scoring.page_score(scoring.scoring_path(path), scoring.scoring_text(path, F.lit(""))
                           ).alias("start_score"))
    pages = reachable_pages(start, corpus, site, config)
    known = F.col("links").isNotNull()
    listed = F.slice("links", 1, config.max_total_discovered_urls)
    outcome = F.coalesce(F.col("fetch_outcome"), F.when(known, F.lit("SUCCESS")).otherwise(
        F.lit("HTTP_ERROR")))
    rows = pages.join(start.withColumnRenamed("url", "start_url"), site).select(
        site, "url", "start_url", "start_score", outcome.alias("fetch_outcome"),
        F.coalesce("robots_decision", F.lit("ALLOWED")).alias("robots_decision"),
        F.coalesce("links_discovered", F.lit(0)).alias("links_discovered"),
        F.coalesce(F.transform(listed, lambda k: k["url"]), F.array().cast(
            "array<string>")).alias("link_urls"),
        F.coalesce(F.transform(listed, lambda k: k["score"]), F.array().cast(
            "array<int>")).alias("link_scores")).dropDuplicates([site, "url"])
    schema = _VISIT_SCHEMA.format(name=site, kind=seeds.schema[site].dataType.simpleString())
    # sites stream through a task one after the other; the state is one site's bounded page set
    ordered = rows.repartition(site).sortWithinPartitions(site)
    ship_package(ordered.sparkSession)
    return ordered.mapInPandas(_visitor(site, config), schema)


def _visitor(site: str, config: SiteScanConfig):
    """Best-first walk over the bounded page set of each site.

    The closure holds plain values only, so executors need no copy of this package.
    """
    max_pages, max_depth = config.max_pages, config.max_depth
    max_discovered = config.max_total_discovered_urls
    inputs = [site, "url", "start_url", "start_score", "robots_decision", "fetch_outcome",
              "links_discovered", "link_urls", "link_scores"]
    outputs = [site, "visit", "url", "depth", "score", "page_outcome", "fetch_outcome",
               "links_discovered", "stop_reason", "urls_discovered"]
    unfetched = {"DISALLOWED": "ROBOTS_DISALLOWED",
                 "TEMPORARY_FAILURE": "ROBOTS_TEMPORARY_FAILURE"}
    fetched = {"SUCCESS": "FETCHED_AND_PROCESSED", "UNSAFE_HOST": "UNSAFE_HOST"}

    def walk(key, start, start_score, pages):
        queue, seen, visited, records = [(-start_score, 0, start, 0)], {start}, set(), []
        sequence, stop = 1, "QUEUE_EXHAUSTED"
        while queue:
            if len(visited) >= max_pages:
                stop = "MAX_PAGES_REACHED"
                break
            low, depth, url, _ = heapq.heappop(queue)
            if url in visited:
                continue
            visited.add(url)
            decision, fetch, on_page, targets, scores = pages[url]
            outcome, links = unfetched.get(decision), 0
            if outcome is not None:
                fetch = None
            else:
                outcome = fetched.get(fetch, "FETCH_FAILED")
            if outcome == "FETCHED_AND_PROCESSED":
                links = int(on_page)
                for target, score in zip(targets, scores, strict=True):
                    if depth >= max_depth or len(seen) >= max_discovered:
                        break
                    if target not in seen:
                        seen.add(target)
                        heapq.heappush(queue, (-int(score), depth + 1, target, sequence))
                        sequence += 1
            records.append((url, depth, -low, outcome, fetch, links))
        for low, depth, url, _ in sorted(queue):
            if url not in visited:
                records.append((url, depth, -low, "SKIPPED_BUDGET_REACHED", None, 0))
        return [(key, n, *r, stop, len(seen)) for n, r in enumerate(records, 1)]

    def visit(batches):
        current, start, score, pages = None, None, 0, {}
        for batch in batches:
            done = []
            for key, url, start_url, start_score, *page in zip(
                    *(batch[c] for c in inputs), strict=True):
                if key != current:
                    if pages:
                        done += walk(current, start, score, pages)
                    current, start, score, pages = key, start_url, int(start_score), {}
                pages[url] = page
            if done:
                yield pd.DataFrame(done, columns=outputs)
        if pages:
            yield pd.DataFrame(walk(current, start, score, pages), columns=outputs)

    return visit
