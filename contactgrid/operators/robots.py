"""Robots rules: parsing, decision per address, crawl delay.

Addresses find their rules by equality on cut paths (`prefixes`), so a path costs one look-up per
prefix length of its origin, and files with thousands of rules never meet a path rule by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid.functions.urls import decode_percent
from contactgrid.operators.prefixes import rules_of_prefixes


def rule_lines(files: DataFrame) -> DataFrame:
    """Directives (origin, ordinal, field, value, group) of robots files (origin, body).

    A group is a run of user-agent lines with the rules that follow; a blank line or a
    user-agent line after rules starts the next one. The window spans one file.
    """
    lines = files.select("origin", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias(
        "ordinal", "line"))
    blank = F.col("line") == ""
    text = F.trim(F.substring_index("line", "#", 1))
    parsed = lines.select(
        "origin", "ordinal", blank.alias("blank"), text.alias("text"),
        F.lower(F.trim(F.substring_index(text, ":", 1))).alias("field"),
        F.trim(F.substr(text, F.length(F.substring_index(text, ":", 1)) + 2)).alias("value"))
    known = F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay")
    useful = parsed.filter(F.col("blank") | (F.col("text").contains(":") & known))
    file_order = W.partitionBy("origin").orderBy("ordinal")
    agent = F.col("field") == "user-agent"
    starts = F.col("blank") | (agent & ~F.coalesce(F.lag(agent).over(file_order), F.lit(False)))
    grouped = useful.withColumn("__starts", starts.cast("int")).withColumn(
        "group", F.sum("__starts").over(file_order)).filter(~F.col("blank"))
    return grouped.select("origin", "ordinal", "field", "value", "group")


def origin_rules(lines: DataFrame, token: str) -> DataFrame:
    """Rules (origin, prefix, ordinal, allow) that apply to `token`: of each prefix, the first.

    The first group that names the token wins over the first `*` group. A rule without a value
    allows everything; the prefix `*` stands for every path and becomes the empty one.
    """
    agent = F.lower("value")
    named = (agent != "*") & F.lit(token.split("/")[0].lower()).contains(agent)
    groups = lines.groupBy("origin", "group").agg(
        F.max(F.when(F.col("field") == "user-agent", named)).alias("named"),
        F.max(F.when(F.col("field") == "user-agent", agent == "*")).alias("any"),
        F.count_if(F.col("field") != "user-agent").alias("rules"))
    usable = groups.filter((F.col("rules") > 0) & (F.col("named") | F.col("any")))
    # `*` groups are the fallback: a group that lists `*` never counts as naming the token
    rank = F.struct(F.col("any").alias("fallback"), F.col("group").alias("group"))
    chosen = usable.groupBy("origin").agg(F.min(rank)["group"].alias("group"))
    rules = lines.filter(F.col("field").isin("allow", "disallow")).join(
        chosen, ["origin", "group"], "left_semi")
    return first_rules(rules.select(
        "origin", "ordinal", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        decode_percent(F.col("value")).alias("prefix")))


def first_rules(rules: DataFrame) -> DataFrame:
    """One rule per origin and prefix, the first by `ordinal`; `*` is the empty prefix."""
    prefix = F.when(F.col("prefix") == "*", F.lit("")).otherwise(F.col("prefix"))
    return rules.withColumn("prefix", prefix).groupBy("origin", "prefix").agg(
        F.min_by("allow", "ordinal").alias("allow"), F.min("ordinal").alias("ordinal"))


def allowed_paths(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(origin, path, allowed) of every distinct asked path that a rule of its origin starts.

    The first matching rule in file order decides. Rules (origin, ordinal, allow, prefix) may be
    thousands per origin: a path meets one rule per prefix length of its origin at most.
    """
    first = first_rules(rules)
    lengths = first.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    return rules_of_prefixes(
        asked.select("origin", "path").join(lengths, "origin"), first, ["origin"], "path",
        "prefix", F.col("lengths"), allowed=F.min_by("allow", "ordinal"))


def crawl_delays(lines: DataFrame, token: str) -> DataFrame:
    """Crawl delay per origin: the exact agent over `*`, the last value of each."""
    agent = F.lower("value")
    agents = lines.filter(F.col("field") == "user-agent").groupBy("origin", "group").agg(
        F.max(agent == token.lower()).alias("exact"), F.max(agent == "*").alias("any"))
    delays = lines.filter(F.col("field") == "crawl-delay").select(
        "origin", "group", "ordinal", F.col("value").try_cast("double").alias("delay")
    ).filter(F.col("delay").isNotNull())
    rated = delays.join(agents, ["origin", "group"])
    return rated.groupBy("origin").agg(
        F.max_by(F.when(F.col("exact"), F.col("delay")),
                 F.when(F.col("exact"), F.col("ordinal"))).alias("exact_delay"),
        F.max_by(F.when(F.col("any") & ~F.col("exact"), F.col("delay")),
                 F.when(F.col("any") & ~F.col("exact"), F.col("ordinal"))).alias("any_delay")
    ).select("origin", F.coalesce("exact_delay", "any_delay").alias("crawl_delay"))


def robots_decisions(
    addresses: DataFrame, files: DataFrame, token: str
) -> DataFrame:
    """Decision per address (origin, path_query): ALLOWED, DISALLOWED or TEMPORARY_FAILURE.

    `files` has (origin, status, body); a null status means the fetch itself failed. The file
    side has one row per origin; a very frequent origin is left to the skew join.
    """
    lines = rule_lines(files.filter(F.col("status") == 200))
    policy = files.select("origin", "status").join(crawl_delays(lines, token), "origin", "left")
    path = F.when(F.col("path_query") == "", F.lit("/")).otherwise(
        decode_percent(F.col("path_query")))
    asked = addresses.withColumn("__path", path)
    decided = allowed_paths(
        asked.select("origin", F.col("__path").alias("path")), origin_rules(lines, token)
    ).select("origin", F.col("path").alias("__path"), F.col("allowed").alias("__allowed"))
    df = asked.join(policy, "origin", "left").join(decided, ["origin", "__path"], "left")
    status = F.col("status")
    allowed = F.coalesce("__allowed", F.lit(True))
    decision = (
        F.when(status == 200, F.when(allowed, F.lit("ALLOWED")).otherwise(F.lit("DISALLOWED")))
        .when(status.isin(401, 403), F.lit("DISALLOWED"))
        .when(status.isNull() | (status == 429) | (status >= 500), F.lit("TEMPORARY_FAILURE"))
        .otherwise(F.lit("ALLOWED")))
    reason = (
        F.when(status == 200, F.when(allowed, F.lit("Allowed by robots.txt rules for '")
                                     ).otherwise(F.lit("Disallowed by robots.txt rules for '")))
        .when(status.isin(401, 403), F.lit("robots.txt access denied with HTTP status "))
        .when(status.isNull(), F.lit("robots.txt fetch error"))
        .when((status == 429) | (status >= 500),
              F.lit("robots.txt temporary failure with HTTP status "))
        .otherwise(F.lit("robots.txt file unavailable (HTTP status ")))
    tail = F.when(status == 200, F.lit(token + "'")).when(status.isNull(), F.lit("")).otherwise(
        F.concat(status.cast("string"), F.when(
            ~status.isin(401, 403, 429) & (status < 500), F.lit(")")).otherwise(F.lit(""))))
    return df.select(*addresses.columns, decision.alias("decision"), "crawl_delay",
                     F.concat(reason, tail).alias("reason"))
