import random
import urllib.robotparser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from contactgrid.config import DiscoveryConfig, SiteScanConfig
from contactgrid.functions import scoring
from contactgrid.operators import frontier, robots
from contactgrid.operators import links as L


def pages(spark, *rows):
    return spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def discovered(spark, url, html, config=DiscoveryConfig()):
    row = L.discover_links(pages(spark, (url, html)), config).first()
    return row.outcome, [(k.url, k.link_text) for k in row.links]


def test_limits_are_checked():
    for bad in ({"max_raw_anchors": 0}, {"max_html_chars": 0},
                {"max_ranked_pages": 100, "max_discovered_links": 50}):
        with pytest.raises(ValueError, match="INVALID_LIMIT"):
            DiscoveryConfig(**bad)


def test_anchors_outside_ignored_elements(spark):
    html = """<html><head><style> a { color: red; } </style>
      <script> console.log("<a href='/script_link'>Script</a>"); </script></head><body>
      <!-- <a href="/comment">c</a> -->
      <a href="/nested"><span>About <b>Our <i>Team</i></b></span></a>
      <a href="mailto:info@example.com">Email Us</a><a href="tel:+123">Call</a>
      <a href="javascript:void(0)">Click</a><a href="">blank</a><a href="/open">never closed"""
    found = L.raw_anchors(pages(spark, ("https://example.com/", html))).first().found
    assert [(a.href, a.link_text) for a in found] == [
        ("/nested", "About Our Team"), ("mailto:info@example.com", "Email Us"),
        ("tel:+123", "Call"), ("javascript:void(0)", "Click")]
    assert discovered(spark, "https://example.com/", html)[1] == [
        ("https://example.com/nested", "About Our Team")]


def test_base_address(spark):
    inside = '<head><base href="/subfolder/"></head><a href="page.html">Page</a>'
    poison = '<head><base href="https://evil.com/p/"></head><a href="contact.html">C</a>'
    assert discovered(spark, "https://example.com/root/", inside)[1] == [
        ("https://example.com/subfolder/page.html", "Page")]
    assert discovered(spark, "https://example.com/root/", poison)[1] == [
        ("https://example.com/root/contact.html", "C")]


def test_best_text_per_target_and_scope(spark):
    html = ('<a href="/about">Link 1</a><a href="/about#team">About Our Leadership Team</a>'
            '<a href="//example.com/p">P</a><a href="https://external.com/out">E</a>'
            '<a href="https://blog.example.com/x">B</a><a href="/hero.PNG?v=1">H</a>')
    outcome, links = discovered(spark, "https://example.com/", html)
    assert outcome == "SUCCESS"
    assert links == [("https://example.com/about", "About Our Leadership Team"),
                     ("https://blog.example.com/x", "B"), ("https://example.com/p", "P")]
    same = discovered(spark, "https://example.com/", html, DiscoveryConfig(scope="SAME_ORIGIN"))
    assert ("https://blog.example.com/x", "B") not in same[1]


def test_nothing_is_cut_unless_asked(spark):
    many = "".join(f'<a href="/p{i}">P{i}</a>' for i in range(2001))
    long = "x" * 1_000_001 + '<a href="/last">Last</a>'
    assert len(discovered(spark, "https://e.com/", many)[1]) == 2001
    assert discovered(spark, "https://e.com/", long)[1] == [("https://e.com/last", "Last")]
    ranked = L.rank_pages(L.discover_links(pages(spark, ("https://e.com/", many))))
    assert ranked.count() == 2002


def test_limits_and_empty_pages(spark):
    many = "".join(f'<a href="/p{i}">P{i}</a>' for i in range(10))
    assert len(discovered(spark, "https://e.com/", many, DiscoveryConfig(max_raw_anchors=3))[1]) == 3
    cut = DiscoveryConfig(max_discovered_links=2, max_ranked_pages=2)
    assert len(discovered(spark, "https://e.com/", many, cut)[1]) == 2
    assert discovered(spark, "https://e.com/", "<p>none</p>") == ("NO_LINKS_DISCOVERED", [])
    bad = L.discover_links(pages(spark, ("ftp://x", many))).first()
    assert bad.outcome == "INVALID_SOURCE_URL"
    ranked = L.rank_pages(L.discover_links(pages(spark, ("https://e.com/", "")))).collect()
    assert [(r.url, r.signals) for r in ranked] == [("https://e.com/", ["HOME_PAGE"])]


def test_relative_references_resolve_like_the_standard_library(spark):
    base = "https://example.com/a/b/page.html?k=1"
    hrefs = ["x", "./x", "../x", "../../x", "../../../x", "/x/./y/../z", "?q=2", "", "#f", "x//y",
             "x/..", ".", "..", "//example.com/p//q", "https://example.com/k/../m", "https:y",
             "x?y=/../z", "/a;b/c;d", " spaced ", "dir/", "../b/.hidden"]
    html = "".join(f'<a href="{h}">t</a>' for h in hrefs if h)
    rows = L.resolved_anchors(pages(spark, (base, html))).collect()
    for row in rows:
        expected = urljoin(base, row.href.strip()).split("#")[0]
        assert row.url == expected, row.href


def test_scores_and_signals(spark):
    cases = [("/contact-us/contact-form", "Contact Contact Us", 100, ["KEYWORD_CONTACT"]),
             ("/restore", "", -100, ["NEGATIVE_ECOMMERCE"]), ("/", "", 50, ["HOME_PAGE"]),
             ("/team", "Our Leadership Team", 90, ["KEYWORD_TEAM"]),
             ("/login", "Sign In / Login", -100, ["NEGATIVE_LOGIN"]),
             ("/x;page=about", "", 0, []), ("/page/2", "help", 0, ["KEYWORD_SUPPORT", "NEGATIVE_ARCHIVE"])]
    df = spark.createDataFrame([c[:2] for c in cases], "path string, text string")
    p, t = scoring.scoring_path(F.col("path")), scoring.scoring_text(F.col("path"), F.col("text"))
    rows = df.select(scoring.page_score(p, t).alias("s"), scoring.page_signals(p, t).alias("g"))
    assert [(r.s, r.g) for r in rows.collect()] == [c[2:] for c in cases]


def test_lexical_ties(spark):
    html = '<a href="/b-contact">Contact</a><a href="/a-contact">Contact</a>'
    ranked = L.rank_pages(L.discover_links(pages(spark, ("https://e.com/", html)))).orderBy("rank")
    assert [r.url for r in ranked.collect()][:2] == [
        "https://e.com/a-contact", "https://e.com/b-contact"]


# --- frontier --------------------------------------------------------------------------------
def brute_visit(start, score, graph, state, config):
    """Independent walk: re-sorts the whole frontier before every step."""
    waiting, known, done, out, order = [(score, 0, start, 0)], {start}, set(), [], 1
    while waiting and len(done) < config.max_pages:
        waiting.sort(key=lambda w: (-w[0], w[1], w[2], w[3]))
        points, depth, url, _ = waiting.pop(0)
        if url in done:
            continue
        done.add(url)
        outcome = {"DISALLOWED": "ROBOTS_DISALLOWED"}.get(state.get(url))
        if outcome is None:
            outcome = "FETCHED_AND_PROCESSED" if url in graph else "FETCH_FAILED"
        out.append((url, depth, points, outcome))
        if outcome == "FETCHED_AND_PROCESSED" and depth + 1 <= config.max_depth:
            for target, value in graph[url]:
                if target not in known and len(known) < config.max_total_discovered_urls:
                    known.add(target)
                    waiting.append((value, depth + 1, target, order))
                    order += 1
    rest = [w for w in waiting if w[2] not in done]
    rest.sort(key=lambda w: (-w[0], w[1], w[2], w[3]))
    return out + [(w[2], w[1], w[0], "SKIPPED_BUDGET_REACHED") for w in rest]


@pytest.mark.parametrize("config", [
    SiteScanConfig(10, 2, 100), SiteScanConfig(4, 2, 7), SiteScanConfig(10, 1, 5),
    SiteScanConfig(10, 0, 100)])
def test_frontier_matches_a_direct_walk(spark, config):
    rng = random.Random(11)
    seeds, corpus, expected = [], [], []
    for site in range(6):
        names = [f"https://s{site}.com/"] + [f"https://s{site}.com/p{i}" for i in range(25)]
        graph, state = {}, {}
        for name in names:
            if name == names[0] or rng.random() < 0.8:
                picks = rng.sample(names + [f"https://s{site}.com/gone{i}" for i in range(5)], 12)
                links = sorted({t: rng.choice([100, 90, 50, 0, -40]) for t in picks}.items(),
                               key=lambda k: (-k[1], k[0]))
                graph[name] = links
                if rng.random() < 0.15:
                    state[name] = "DISALLOWED"
                corpus.append((name, links, len(links), state.get(name)))
        seeds.append((site, names[0]))
        for n, r in enumerate(brute_visit(names[0], 50, graph, state, config), 1):
            expected.append((site, n, *r))
    rows = spark.createDataFrame(
        corpus, "url string, links array<struct<url:string,score:int>>, links_discovered int,"
                " robots_decision string")
    visits = frontier.visit_sites(
        spark.createDataFrame(seeds, "site int, url string"), rows, config=config)
    got = visits.select("site", "visit", "url", "depth", "score", "page_outcome").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


# --- robots ----------------------------------------------------------------------------------
FILES = {
    "https://a.com": (200, "User-agent: ContactBot\nDisallow: /private/\nAllow: /public/\n"
                           "Crawl-delay: 2.5\n"),
    "https://b.com": (200, "User-agent: *\nDisallow: /\n\nUser-agent: contactbot\n"
                           "Disallow: /x%20y\nDisallow:\n"),
    "https://c.com": (200, "# none\n\nUser-agent: other\nUser-agent: *\nAllow: /a/ok\n"
                           "Disallow: /a # all\nCrawl-delay: 7\n\nUser-agent: *\nDisallow: /\n"),
    "https://d.com": (403, ""), "https://e.com": (404, ""), "https://f.com": (503, ""),
    "https://g.com": (429, ""), "https://h.com": (None, ""),
}
PATHS = ["/", "/private/x", "/public/p", "/x y", "/a/ok/1", "/a/no", "/q?z=1"]


def test_robots_decisions(spark):
    files = spark.createDataFrame(
        [(o, s, b) for o, (s, b) in FILES.items()], "origin string, status int, body string")
    wanted = [(o, p) for o in FILES for p in PATHS] + [("https://unknown.com", "/")]
    asked = spark.createDataFrame(wanted, "origin string, path_query string")
    rows = robots.robots_decisions(asked, files, "ContactBot").collect()
    assert len(rows) == len(wanted)
    fixed = {403: "DISALLOWED", 404: "ALLOWED", 503: "TEMPORARY_FAILURE",
             429: "TEMPORARY_FAILURE", None: "TEMPORARY_FAILURE"}
    for row in rows:
        status, body = FILES.get(row.origin, (None, ""))
        if status == 200:
            parser = urllib.robotparser.RobotFileParser()
            parser.parse(body.splitlines())
            allowed = parser.can_fetch("ContactBot", row.origin + row.path_query)
            assert row.decision == ("ALLOWED" if allowed else "DISALLOWED"), row
        else:
            assert row.decision == fixed[status], row
    delays = {r.origin: r.crawl_delay for r in rows}
    assert delays["https://a.com"] == 2.5 and delays["https://c.com"] == 7.0
    reasons = {r.origin: r.reason for r in rows}
    assert "403" in reasons["https://d.com"] and "unavailable" in reasons["https://e.com"]


def test_robots_file_of_thousands_of_rules(spark):
    rng = random.Random(5)
    rules = [(rng.choice(["Allow", "Disallow"]), "/" + "".join(
        rng.choices("ab", k=rng.randint(1, 11)))) for _ in range(3000)]
    body = "User-agent: *\n" + "\n".join(f"{kind}: {path}" for kind, path in rules)
    files = spark.createDataFrame(
        [("https://a.com", 200, body), ("https://b.com", 200, "")],
        "origin string, status int, body string")
    paths = ["/" + "".join(rng.choices("ab", k=rng.randint(0, 14))) for _ in range(400)] * 2
    asked = spark.createDataFrame(
        [(o, p, i) for i, p in enumerate(paths) for o in ("https://a.com", "https://b.com", None)]
        + [("https://a.com", None, -1)], "origin string, path_query string, allowed int")
    decided = robots.robots_decisions(asked, files, "ContactBot")
    rows = decided.collect()
    assert len(rows) == len(paths) * 3 + 1 and rows[0].allowed is not None
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(body.splitlines())
    for row in rows:
        if row.origin == "https://a.com" and row.path_query is not None:
            assert (row.decision == "ALLOWED") == parser.can_fetch(
                "ContactBot", row.origin + row.path_query), row
        elif row.origin is not None:
            assert row.decision == "ALLOWED"
        else:
            assert row.decision == "TEMPORARY_FAILURE"
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
