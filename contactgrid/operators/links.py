"""Link discovery and page ranking over a stored page corpus.

Every step from the HTML to the ranked links of a page works on arrays inside the page's own row.
The plan is a scan followed by projections: nothing is shuffled, and only the links leave the row.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import DiscoveryConfig
from contactgrid.functions import html, scoring, urls
from contactgrid.functions.stages import Getter, Stage, run_on_columns, run_on_elements
from contactgrid.functions.suffixes import DEFAULT_RULES, SuffixRules
from contactgrid.functions.text import decode_entities, first_chars, first_items, strip_space

SOURCE_FIELDS = ("normalized_url", "scheme", "hostname", "port", "path", "query",
                 "registrable_domain", "error_code")


@lru_cache(maxsize=None)
def resolution_stages() -> tuple[Stage, ...]:
    """Stages from `href` and the base address (`base_*`) to an absolute address in `raw`."""

    def shape(c: Getter) -> dict[str, Column]:
        href = F.translate(strip_space(c("href")), "\t\r\n", "")
        return {"reference": href, "own_scheme": F.lower(
            F.regexp_extract(href, r"^([a-zA-Z][a-zA-Z0-9+.\-]*+):", 1))}

    def remainder(c: Getter) -> dict[str, Column]:
        same = c("own_scheme") == c("base_scheme")
        rest = F.when(same, F.substr(c("reference"), F.length(c("own_scheme")) + 2)).otherwise(
            c("reference"))
        rest = F.substring_index(rest, "#", 1)
        return {"foreign": (c("own_scheme") != "") & ~same, "rest": rest,
                "rest_path": F.substring_index(rest, "?", 1)}

    def segments(c: Getter) -> dict[str, Column]:
        path, base = c("rest_path"), c("base_path")
        folder = F.substr(base, F.lit(1), F.length(base) - F.length(
            F.substring_index(base, "/", -1)))
        # a relative path is joined to the base folder without empty inner segments
        relative = F.regexp_replace(F.concat(folder, path), "(?<=.)/{2,}", "/")
        return {
            "rest_query": F.substr(c("rest"), F.length(path) + 1),
            "full_path": F.when(path.startswith("/"), path).otherwise(relative),
        }

    def resolved(c: Getter) -> dict[str, Column]:
        parts = F.split(c("full_path"), "/")

        def walk(done: Column, part: Column) -> Column:
            return F.when(part == "..", F.slice(
                done, 1, F.greatest(F.lit(0), F.size(done) - 1))
            ).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

        dots = c("full_path").contains("/.") | c("full_path").startswith(".")
        last = F.try_element_at(parts, F.lit(-1))
        walked = F.aggregate(parts, F.array().cast("array<string>"), walk)
        closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(
            walked)
        path = F.when(dots, F.array_join(closed, "/")).otherwise(c("full_path"))
        rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        origin = F.concat(c("base_scheme"), F.lit("://"), c("base_netloc"))
        base_query = F.when(c("base_query") == "", F.lit("")).otherwise(
            F.concat(F.lit("?"), c("base_query")))
        return {"raw": F.when(c("foreign"), c("reference")).when(
            c("rest").startswith("//"), F.concat(c("base_scheme"), F.lit(":"), c("rest"))
        ).when(c("rest_path") == "", F.concat(
            origin, c("base_path"),
            F.when(c("rest_query") == "", base_query).otherwise(c("rest_query")))
        ).otherwise(F.concat(origin, rooted, c("rest_query")))}

    return (shape, remainder, segments, resolved)


def netloc(hostname: Column, port: Column) -> Column:
    shown = F.when(hostname.contains(":"), F.concat(F.lit("["), hostname, F.lit("]"))).otherwise(
        hostname)
    return F.when(port.isNull(), shown).otherwise(
        F.concat(shown, F.lit(":"), port.cast("string")))


def same_origin(c: Getter, one: str, other: str) -> Column:
    def port(side: str) -> Column:
        standard = F.when(c(side + "scheme") == "https", F.lit(443)).otherwise(F.lit(80))
        return F.coalesce(c(side + "port"), standard)

    return ((c(one + "scheme") == c(other + "scheme"))
            & (c(one + "hostname") == c(other + "hostname")) & (port(one) == port(other)))


def same_registrable_domain(c: Getter, one: str, other: str) -> Column:
    mine, theirs = c(one + "registrable_domain"), c(other + "registrable_domain")
    return F.when(mine.isNotNull() & theirs.isNotNull(), mine == theirs).otherwise(
        c(one + "hostname") == c(other + "hostname"))


def is_asset_path(path: Column, extensions: tuple[str, ...]) -> Column:
    names = "|".join(e.lower().removeprefix(".") for e in extensions)
    return F.lower(path).rlike(rf"\.(?:{names})\z")


def is_rejected_scheme(href: Column) -> Column:
    low = F.lower(strip_space(href))
    hit = F.lit(False)
    for scheme in ref.REJECTED_LINK_SCHEMES:
        hit = hit | low.startswith(scheme)
    # most links hold no colon at all
    return low.contains(":") & hit


@lru_cache(maxsize=None)
def _page_stages(config: DiscoveryConfig, rules: SuffixRules) -> tuple[Stage, ...]:
    """From `html` and the parsed source (`source_*`) to `found` anchors and the base address."""

    def clean(c: Getter) -> dict[str, Column]:
        cut = first_chars(c("html"), config.max_html_chars)
        return {"marked": html.mark_tags(cut, html.LINK_MARKUP)}

    def anchors(c: Getter) -> dict[str, Column]:
        return {
            "found": html.anchors(c("marked"), config.max_raw_anchors),
            "href": decode_entities(html.base_address(c("marked")), in_attribute=True),
            "base_scheme": c("source_scheme"),
            "base_netloc": netloc(c("source_hostname"), c("source_port")),
            "base_path": c("source_path"),
            "base_query": c("source_query"),
            "marked": F.lit(None).cast("string"),
        }

    def chosen_base(c: Getter) -> dict[str, Column]:
        own = F.coalesce(
            (strip_space(c("href")) != "") & c("error_code").isNull()
            & same_registrable_domain(c, "", "source_"), F.lit(False))
        return {
            "base_scheme": F.when(own, c("scheme")).otherwise(c("source_scheme")),
            "base_netloc": F.when(own, netloc(c("hostname"), c("port"))).otherwise(
                netloc(c("source_hostname"), c("source_port"))),
            "base_path": F.when(own, c("path")).otherwise(c("source_path")),
            "base_query": F.when(own, c("query")).otherwise(c("source_query")),
        }

    def texts(c: Getter) -> dict[str, Column]:
        return {"found": F.transform(c("found"), lambda a, at: F.struct(
            at.alias("position"),
            decode_entities(a["value"], in_attribute=True).alias("href"),
            html.anchor_text(a["inner"]).alias("link_text")))}

    return (clean, anchors, *resolution_stages(), *urls.normalization_stages(rules),
            chosen_base, texts)


BASE_FIELDS = ("base_scheme", "base_netloc", "base_path", "base_query")


def with_source(
    pages: DataFrame, url: str = "url", rules: SuffixRules = DEFAULT_RULES
) -> DataFrame:
    """Add the parsed page address as `source_*` columns."""
    parsed = run_on_columns(
        pages, {"raw": F.col(url)}, urls.normalization_stages(rules), SOURCE_FIELDS)
    return parsed.withColumnsRenamed({name: "source_" + name for name in SOURCE_FIELDS})


def raw_anchors(
    pages: DataFrame, config: DiscoveryConfig = DiscoveryConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Pages with their anchors (`found`: position, raw href, text) and effective base address.

    Input columns: `page_id`, `url`, `html`. The HTML does not leave this operator.
    """
    pages = with_source(pages.select("page_id", "url", "html"), rules=rules)
    inputs = {c: F.col(c) for c in pages.columns if c.startswith("source_")}
    inputs["html"] = F.col("html")
    return run_on_columns(
        pages, inputs, _page_stages(config, rules), ["found", *BASE_FIELDS]).drop("html")


@lru_cache(maxsize=None)
def _link_stages(config: DiscoveryConfig, rules: SuffixRules) -> tuple[Stage, ...]:
    def scope(c: Getter) -> dict[str, Column]:
        return {"same_origin": same_origin(c, "", "source_"),
                "same_domain": same_registrable_domain(c, "", "source_")}

    def text(c: Getter) -> dict[str, Column]:
        inside = c("same_origin") if config.scope == "SAME_ORIGIN" else c("same_domain")
        return {
            "keep": F.coalesce(
                c("error_code").isNull() & inside
                & ~is_asset_path(c("path"), config.asset_extensions), F.lit(False)),
            "score_path": scoring.scoring_path(c("path")),
            "score_text": scoring.scoring_text(c("path"), c("link_text")),
        }

    def signals(c: Getter) -> dict[str, Column]:
        return {"signals": scoring.page_signals(c("score_path"), c("score_text"))}

    def entry(c: Getter) -> dict[str, Column]:
        # sort keys first: natural struct order is target, best score, longest text, first seen
        return {"entry": F.struct(
            c("normalized_url").alias("url"), (-scoring.score_of(c("signals"))).alias("low"),
            (-F.length(c("link_text"))).alias("short"), c("position").alias("position"),
            c("link_text").alias("link_text"), c("href").alias("raw_href"),
            c("same_origin").alias("same_origin"), c("same_domain").alias("same_domain"),
            c("signals").alias("signals"))}

    return (*resolution_stages(), *urls.normalization_stages(rules), scope, text, signals,
            entry)


def _first_per_target(ordered: Column) -> Column:
    """Keep the first entry of every target in an array sorted by target."""
    return F.filter(F.transform(ordered, lambda e, at: F.struct(
        (F.coalesce(F.get(ordered, at - 1)["url"], F.lit("")) != e["url"]).alias("first"),
        e.alias("entry"))), lambda e: e["first"])


def resolved_anchors(
    pages: DataFrame, config: DiscoveryConfig = DiscoveryConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Flat anchors with their resolved address; `url` is null when a link is no web address."""
    found = raw_anchors(pages, config, rules)
    rows = found.select(
        *[c for c in found.columns if c != "found"], F.explode_outer("found").alias("a")
    ).filter("a is not null").select(
        *[c for c in found.columns if c not in ("found", "url")], "a.*")
    inputs = {c: F.col(c) for c in ("href", *BASE_FIELDS)}
    parsed = run_on_columns(
        rows, inputs, (*resolution_stages(), *urls.normalization_stages(rules)),
        ["normalized_url", "path"])
    usable = ~is_rejected_scheme(F.col("href"))
    return parsed.select(
        "page_id", "position", "href", "link_text",
        F.when(usable, F.col("normalized_url")).alias("url"), "path")


@lru_cache(maxsize=None)
def _link_arrays(names: tuple[str, ...], limit: int | None) -> tuple[Column, Column, Column]:
    """Columns for the usable anchors, the best anchor per target, and the ranked links."""
    elements = F.transform(
        F.filter("found", lambda a: ~is_rejected_scheme(a["href"])),
        lambda a: F.struct(a["position"].alias("position"), a["href"].alias("href"),
                           a["link_text"].alias("link_text"), *[F.col(n) for n in names]))
    best = F.transform(_first_per_target(F.col("__ordered")), lambda e: F.struct(
        *[e["entry"][n].alias(n) for n in (
            "low", "url", "link_text", "raw_href", "same_origin", "same_domain", "signals")]))
    links = F.transform(first_items(F.array_sort("__best"), limit), lambda e: F.struct(
        (-e["low"]).alias("score"), *[e[n].alias(n) for n in (
            "url", "link_text", "raw_href", "same_origin", "same_domain", "signals")]))
    return elements, best, links


def discover_links(
    pages: DataFrame, config: DiscoveryConfig = DiscoveryConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """One row per page: parsed source, outcome, and `links` in rank order.

    `links` holds (score, url, link_text, raw_href, same_origin, same_domain, signals): the best
    anchor per target (score, then longer text, then first seen), best targets first.
    """
    df = raw_anchors(pages, config, rules)
    names = [*BASE_FIELDS, *(c for c in df.columns if c.startswith("source_"))]
    elements, best, links = _link_arrays(tuple(names), config.max_discovered_links)
    df = run_on_elements(
        df, elements, ["position", "href", "link_text", *names], _link_stages(config, rules),
        "__targets")
    kept = F.transform(F.filter("__targets", lambda t: t["keep"]), lambda t: t["entry"])
    df = df.withColumn("__ordered", F.when(
        F.col("source_error_code").isNull(), F.array_sort(kept)))
    df = df.withColumn("__best", best).withColumn("links", links)
    outcome = F.when(F.col("source_error_code").isNotNull(), F.lit("INVALID_SOURCE_URL")).when(
        F.size("links") > 0, F.lit("SUCCESS")).otherwise(F.lit("NO_LINKS_DISCOVERED"))
    return df.withColumn("outcome", outcome).drop(
        "found", "__targets", "__ordered", "__best", *BASE_FIELDS)


def link_rows(discovered: DataFrame) -> DataFrame:
    """Flat links with their rank on the page."""
    # the outer form keeps the optimizer from evaluating the array once more as a filter
    return discovered.select(
        "page_id", F.col("source_normalized_url").alias("source_url"),
        F.posexplode_outer("links").alias("rank", "link")).filter("rank is not null").select(
        "page_id", "source_url", (F.col("rank") + 1).alias("rank"), "link.*")


def rank_pages(
    discovered: DataFrame, config: DiscoveryConfig = DiscoveryConfig()
) -> DataFrame:
    """Ranked pages per source: its links plus the source itself, scored with the text "Home"."""
    path = F.col("source_path")
    source_text = scoring.scoring_text(path, F.lit("Home"))
    df = discovered.filter(F.col("outcome") != "INVALID_SOURCE_URL").withColumn(
        "__signals", scoring.page_signals(scoring.scoring_path(path), source_text)
    ).withColumn("__score", scoring.score_of(F.col("__signals")))
    source, own_score = F.col("source_normalized_url"), F.col("__score")
    stronger = F.exists(
        "links", lambda k: (k["url"] == source) & (k["score"] > own_score))

    def entry(url: Column, score: Column, signals: Column, text: Column) -> Column:
        return F.struct((-score).alias("low"), url.alias("url"), signals.alias("signals"),
                        text.alias("link_text"))

    own = F.when(stronger, F.array()).otherwise(F.array(entry(
        source, own_score, F.col("__signals"), F.lit(None).cast("string"))))
    others = F.transform(
        F.filter("links", lambda k: (k["url"] != source) | (k["score"] > own_score)),
        lambda k: entry(k["url"], k["score"], k["signals"], k["link_text"]))
    ranked = first_items(F.array_sort(F.concat(others, own)), config.max_ranked_pages)
    return df.select("page_id", source.alias("source_url"),
                     F.posexplode_outer(ranked).alias("rank", "page")).filter(
        "rank is not null").select(
        "page_id", "source_url", (F.col("rank") + 1).alias("rank"), "page.url",
        (-F.col("page.low")).alias("score"), F.col("page.signals").alias("signals"),
        "page.link_text", F.lit(ref.RANKING_VERSION).alias("ranking_version"))


def in_scope(df: DataFrame, one: str, other: str, mode: str) -> Column:
    """Scope predicate over two parsed addresses with the given column prefixes."""
    test = same_origin if mode == "SAME_ORIGIN" else same_registrable_domain
    return test(lambda name: F.col(name), one, other)
