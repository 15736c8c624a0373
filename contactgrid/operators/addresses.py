"""Address-list jobs: normalization, classification, de-duplication, review summary."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import IngestLimits
from contactgrid.functions import hosts, urls
from contactgrid.functions.stages import Getter, Stage, run_on_columns
from contactgrid.functions.suffixes import (
    DEFAULT_RULES,
    SuffixRules,
    domain_under_suffix,
    name_label,
    subdomain,
)
from contactgrid.operators.quality import ordered_checksum
from contactgrid.operators.keyed import sequence_within, with_group_values
from contactgrid.session import materialize


def normalize_urls(
    df: DataFrame, column: str, rules: SuffixRules = DEFAULT_RULES
) -> DataFrame:
    """Add the fields of `URL_FIELDS` plus `error_message` for the address in `column`.

    Row-local: no join, no shuffle, no Python worker.
    """
    return run_on_columns(
        df, {"raw": F.col(column)}, [*urls.normalization_stages(rules), _message],
        [*urls.URL_FIELDS, "error_message"])


def _message(c: Getter) -> dict[str, Column]:
    return {"error_message": urls.error_message(c("error_code"), c("raw_host") != "")}


@lru_cache(maxsize=None)
def platform_stages(rules: SuffixRules = DEFAULT_RULES) -> tuple[Stage, ...]:
    """Stages from `hostname`, `suffix_size` and `path` to the platform flags."""

    def names(c: Getter) -> dict[str, Column]:
        host, size = c("hostname"), c("suffix_size")
        return {
            "domain_name": name_label(host, size),
            "subdomain": subdomain(host, size),
            "registered": domain_under_suffix(host, size),
            "low_path": F.lower(c("path")),
        }

    def owner(c: Getter) -> dict[str, Column]:
        official = (
            c("registered").isin(*ref.PLATFORM_DOMAINS)
            | (c("domain_name") == "googleadservices")
            | ((c("domain_name") == "google") & (c("suffix_size") > 0)))
        return {"on_platform": F.coalesce(official, F.lit(False))}

    def verdict(c: Getter) -> dict[str, Column]:
        return {
            "platform_code": F.when(c("on_platform"), _platform_page(
                c("hostname"), c("domain_name"), c("subdomain"), c("low_path"))),
            "lookalike": ~c("on_platform") & _has_platform_prefix(c("hostname")),
        }

    return (names, owner, verdict)


def _platform_page(host: Column, name: Column, sub: Column, low: Column) -> Column:
    def under(*prefixes: str) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | low.startswith(prefix)
        return hit

    ads = (name == "googleadservices") | host.endswith(".googleadservices.com")
    return (
        F.when(ads, F.lit("ADVERTISEMENT_OR_TRACKING_REDIRECT"))
        .when((sub == "accounts") | under("/accounts/")
              | low.isin("/signoutoptions", "/servicelogin"), F.lit("ACCOUNT_OR_AUTH_PAGE"))
        .when((sub == "support") | under("/support/", "/help/"), F.lit("SUPPORT_OR_HELP_PAGE"))
        .when((sub == "policies") | under("/privacy", "/terms", "/policies/"),
              F.lit("PRIVACY_TERMS_OR_POLICY_PAGE"))
        .when((sub == "maps") | (low == "/maps") | under("/maps/", "/dir/"),
              F.lit("MAPS_OR_DIRECTIONS"))
        .when((low == "/aclk") | under("/aclk/", "/pagead/"),
              F.lit("ADVERTISEMENT_OR_TRACKING_REDIRECT"))
        .when((low == "/search") | under("/search/")
              | low.isin("/webhp", "/imghp", "/shopping"), F.lit("SEARCH_ENGINE_PAGE"))
        .when(low.isin("/", "", "/index.html") | sub.isin("", "www"),
              F.lit("NON_TARGET_PLATFORM_PAGE")))


def _has_platform_prefix(host: Column) -> Column:
    low = F.lower(host)
    hit = F.lit(False)
    for prefix in ref.LOOKALIKE_PREFIXES:
        hit = hit | low.startswith(prefix) | low.contains("." + prefix)
    return hit


@lru_cache(maxsize=None)
def classification_stages(rules: SuffixRules = DEFAULT_RULES) -> tuple[Stage, ...]:
    """Stages after normalization: decision before de-duplication, duplicate key, target."""

    def checks(c: Getter) -> dict[str, Column]:
        unusable = c("error_code").isNotNull() | c("ip_unsafe")
        no_suffix = (c("host_type") == "DOMAIN") & c("registrable_domain").isNull()
        return {
            "literal": c("ip_is_v4") | c("ip_is_v6"),
            "unsafe_ip": c("error_code").isNull() & c("ip_unsafe"),
            "no_suffix": F.coalesce(no_suffix, F.lit(False)),
            "platform_code": F.when(~unusable & ~no_suffix, c("platform_code")),
        }

    def decision(c: Getter) -> dict[str, Column]:
        code = (
            F.when(c("error_code") == "UNSUPPORTED_SCHEME", F.lit("UNSUPPORTED_SCHEME"))
            .when(c("error_code").isNotNull() | c("unsafe_ip") | c("no_suffix"),
                  F.lit("INVALID_URL"))
            .when(c("platform_code").isNotNull(), c("platform_code"))
            .when(c("lookalike") | c("literal"), F.lit("NEEDS_REVIEW"))
            .otherwise(F.lit("READY_TO_CHECK")))
        text = (
            F.when(c("error_code").isNotNull(), c("error_message"))
            .when(c("unsafe_ip"), F.concat(
                F.lit("Private, loopback, or reserved IP address ["), c("hostname"),
                F.lit("] is not allowed.")))
            .when(c("no_suffix"), F.lit(ref.NO_SUFFIX_EXPLANATION)))
        for name in ref.UNRELATED_PLATFORM_CODES:
            text = text.when(c("platform_code") == name, F.lit(ref.DECISION_EXPLANATIONS[name]))
        text = (
            text.when(c("lookalike"), F.lit(ref.LOOKALIKE_EXPLANATION))
            .when(c("literal"), F.lit(ref.PUBLIC_IP_EXPLANATION))
            .otherwise(F.lit(ref.DECISION_EXPLANATIONS["READY_TO_CHECK"])))
        return {"first_decision": code, "first_explanation": text}

    def key(c: Getter) -> dict[str, Column]:
        host, path = c("hostname"), c("path")
        trimmed = F.regexp_replace(path, r"(?<!/)/++$|^/++$", "")
        return {
            "eligible": c("first_decision").isin("READY_TO_CHECK", "NEEDS_REVIEW"),
            "apex_host": F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host),
            "norm_path": F.when(path == "/", F.lit("/")).otherwise(trimmed),
            "clean_query": urls.clean_query(c("query"), c("on_platform")),
        }

    def target(c: Getter) -> dict[str, Column]:
        netloc = F.when(
            c("host_type") == "IPV6", F.concat(F.lit("["), c("apex_host"), F.lit("]"))
        ).otherwise(c("apex_host"))
        port = F.when(c("port").isNull(), F.lit("")).otherwise(
            F.concat(F.lit(":"), c("port").cast("string")))
        tail = F.when(c("clean_query") == "", c("norm_path")).otherwise(
            F.concat(c("norm_path"), F.lit("?"), c("clean_query")))
        # trimming can leave a bare query, which needs its slash back
        lead = F.when((tail != "") & ~tail.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        return {"canonical_url": F.concat(F.lit("https://"), netloc, port, lead, tail)}

    return (_message, *hosts.address_stages("hostname", "ip_"), *platform_stages(rules), checks,
            decision, key, target)


REVIEW_FIELDS = (
    "normalized_url", "hostname", "host_type", "registrable_domain", "error_code",
    "platform_code", "lookalike", "unsafe_ip", "first_decision", "first_explanation",
    "eligible", "apex_host", "norm_path", "clean_query", "canonical_url",
)


def classify_addresses(
    df: DataFrame, column: str = "original_input", rules: SuffixRules = DEFAULT_RULES
) -> DataFrame:
    """Row-local part of the review: normalized fields, decision before de-duplication, key."""
    stages = [*urls.normalization_stages(rules), *classification_stages(rules)]
    return run_on_columns(df, {"raw": F.col(column)}, stages, REVIEW_FIELDS)


def review_addresses(
    df: DataFrame,
    overrides: DataFrame | None = None,
    batch: tuple[str, ...] = (),
    index: str = "original_index",
    column: str = "original_input",
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Full review of an address list: decision, owner of duplicates, selection, target."""
    return review_classified(
        classify_addresses(df, column, rules), overrides, batch, index, column)


def review_classified(
    df: DataFrame,
    overrides: DataFrame | None = None,
    batch: tuple[str, ...] = (),
    index: str = "original_index",
    column: str = "original_input",
) -> DataFrame:
    """Review of classified rows. They are read twice: once to find owners, once to decide.

    The earliest index of a duplicate key comes from a grouped minimum (combined map-side) that
    is joined back, so a key that holds a large share of the rows is spread by the skew join
    instead of being ranked in one task. `overrides` has (batch.., index, selected).
    """
    # rows outside the duplicate check get a key of their own, so they spread over all tasks
    key = F.when(F.col("eligible"), F.concat_ws(
        "\n", F.lit("key"), "apex_host", "norm_path", "clean_query")
    ).otherwise(F.concat(F.lit("row "), F.col(index).cast("string")))
    df = df.withColumn("__key", key)
    owner = F.min(F.struct(F.col(index).alias("index"), F.col("canonical_url").alias("url")))
    owners = df.groupBy(*batch, "__key").agg(owner.alias("owner"))
    df = df.join(owners, [*batch, "__key"], "left")
    duplicate = F.col("eligible") & (F.col("owner.index") != F.col(index))
    if overrides is not None:
        chosen = overrides.select(*batch, index, F.col("selected").alias("override"))
        df = df.join(chosen, [*batch, index], "left")
    else:
        df = df.withColumn("override", F.lit(None).cast("boolean"))
    decision = F.when(duplicate, F.lit("DUPLICATE_URL")).otherwise(F.col("first_decision"))
    invalid = F.col("first_decision").isin("INVALID_URL", "UNSUPPORTED_SCHEME")
    platform = F.col("platform_code").isNotNull()
    selected = F.when(invalid, F.lit(False)).when(
        platform | duplicate, F.coalesce(F.col("override"), F.lit(False))
    ).otherwise(F.coalesce(F.col("override"), F.lit(True)))
    df = df.withColumns({
        "decision_code": decision,
        "duplicate_of_index": F.when(duplicate, F.col("owner.index")),
        "is_selected": selected,
        "user_override_permitted": ~invalid,
        "explanation": F.when(duplicate, F.concat(
            F.lit("Duplicate website address of item #"),
            (F.col("owner.index") + 1).cast("string"), F.lit(" ("), F.col("owner.url"),
            F.lit(")."))).otherwise(F.col("first_explanation")),
    })
    target = F.when(
        F.col("is_selected") & (F.col("decision_code") != "DUPLICATE_URL"),
        F.when(F.col("platform_code").isNotNull(), F.col("normalized_url")).otherwise(
            F.col("canonical_url")))
    label = F.create_map(*[F.lit(x) for pair in ref.DECISION_LABELS.items() for x in pair])
    return df.withColumns({
        "canonical_target": target,
        "ui_label": F.element_at(label, F.col("decision_code")),
    }).select(
        *batch, index, column, "normalized_url", "canonical_target", "decision_code",
        "explanation", "duplicate_of_index", "is_selected", "user_override_permitted",
        "ui_label", "hostname")


def review_summary(reviewed: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """Counts per batch."""
    code = F.col("decision_code")
    platform = code.isin(*ref.UNRELATED_PLATFORM_CODES)
    return reviewed.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total_input_count"),
        F.count_if(code == "READY_TO_CHECK").alias("ready_to_check_count"),
        F.count_if(code == "NEEDS_REVIEW").alias("needs_review_count"),
        F.count_if(platform).alias("unrelated_platform_count"),
        F.count_if(code.startswith("DUPLICATE")).alias("duplicate_input_count"),
        F.count_if(code.isin("INVALID_URL", "UNSUPPORTED_SCHEME")).alias("invalid_input_count"),
        F.count_distinct("canonical_target").alias("final_target_count"),
    )


def accepted_targets(
    reviewed: DataFrame, batch: tuple[str, ...] = (), index: str = "original_index"
) -> DataFrame:
    """Distinct targets of selected rows with the index of their first appearance."""
    wanted = reviewed.filter(F.col("is_selected") & F.col("canonical_target").isNotNull())
    return wanted.groupBy(*batch, "canonical_target").agg(F.min(index).alias("first_index"))


def preview(reviewed: DataFrame) -> DataFrame:
    """Screen form of a review: class, and the code and text of rows that are not selected."""
    code = F.col("decision_code")
    taken = F.col("is_selected") & F.col("canonical_target").isNotNull()
    return reviewed.withColumns({
        "classification": F.when(taken, F.lit("VALID")).when(
            code.startswith("DUPLICATE"), F.lit("DUPLICATE")).otherwise(F.lit("INVALID")),
        "error_code": F.when(~F.col("is_selected"), code),
        "error_message": F.when(~F.col("is_selected"), F.col("explanation")),
        "normalized_domain": F.col("hostname"),
    })


def ingest_violations(
    df: DataFrame,
    limits: IngestLimits = IngestLimits(),
    job: str = "job_id",
    index: str = "original_index",
    column: str = "original_input",
    configuration: DataFrame | None = None,
) -> DataFrame:
    """Jobs that break an ingest limit, with the first offending index and its length."""
    length = F.length(column)
    too_long = length > limits.max_input_length
    per_job = df.groupBy(job).agg(
        F.count(F.lit(1)).alias("inputs"),
        F.min(F.when(too_long, F.struct(F.col(index).alias("at"), length.alias("size")))
              ).alias("long"))
    found = per_job.select(
        job,
        F.explode(F.array_compact(F.array(
            F.when(F.col("inputs") > limits.max_inputs_per_job, F.struct(
                F.lit("INPUT_LIMIT_EXCEEDED").alias("violation"),
                F.lit(None).cast("bigint").alias("first_index"),
                F.col("inputs").alias("observed"))),
            F.when(F.col("long").isNotNull(), F.struct(
                F.lit("INPUT_TOO_LONG").alias("violation"),
                F.col("long.at").cast("bigint").alias("first_index"),
                F.col("long.size").cast("bigint").alias("observed"))),
        ))).alias("v")).select(job, "v.*")
    if configuration is not None:
        size = F.octet_length("configuration").cast("bigint")
        found = found.unionByName(
            configuration.filter(size > limits.max_configuration_bytes).select(
                job, F.lit("CONFIGURATION_TOO_LARGE").alias("violation"),
                F.lit(None).cast("bigint").alias("first_index"), size.alias("observed")))
    return found


def coalesce_batch(
    df: DataFrame,
    batch: tuple[str, ...] = (),
    index: str = "original_index",
    column: str = "original_input",
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """One owner per full normalized address; later rows point at the owner."""
    df = normalize_urls(df, column, rules).withColumn("__key", F.coalesce(
        "normalized_url", F.concat(F.lit("row "), F.col(index).cast("string"))))
    df = with_group_values(df, [*batch, "__key"], owner_index=F.min(index))
    duplicate = F.col("owner_index") != F.col(index)
    role = F.when(F.col("error_code").isNotNull(), F.lit("INVALID_INPUT")).when(
        duplicate, F.lit("DUPLICATE_COALESCED")).otherwise(F.lit("OWNER"))
    domain_key = F.lower(F.coalesce("registrable_domain", "hostname"))
    return df.withColumns({
        "item_role": role,
        "is_duplicate": F.coalesce(duplicate, F.lit(False)),
        "duplicate_of_index": F.when(duplicate, F.col("owner_index")),
        "domain_key": domain_key,
    }).drop("owner_index", "__key")


def inherit_results(
    coalesced: DataFrame,
    results: DataFrame,
    batch: tuple[str, ...] = (),
    index: str = "original_index",
) -> DataFrame:
    """Attach the owner's result to every row; `results` is keyed by (batch.., index)."""
    owner = F.coalesce("duplicate_of_index", index)
    keyed = coalesced.withColumn("__owner", owner)
    return keyed.join(
        results.withColumnRenamed(index, "__owner"), [*batch, "__owner"], "left").drop("__owner")


def request_fingerprints(
    targets: DataFrame,
    requests: DataFrame,
    key: str = "request_id",
    position: str = "position",
    target: str = "target",
    chunk: int = 1_000,
) -> DataFrame:
    """Digest of each request over its ordered targets and its settings.

    `targets` holds (key, position, target); every other column of `requests` is a setting. The
    targets are hashed in a tree of chunks of consecutive positions, so the target list of a huge
    request is never held by one task.
    """
    bodies = ordered_checksum(targets, [key], position, F.col(target), chunk).withColumnRenamed(
        "checksum", "targets_digest")
    settings = sorted(c for c in requests.columns if c != key)
    joined = requests.join(bodies, key, "left")
    payload = F.to_json(F.struct(*settings, F.coalesce("targets_digest", F.lit("")).alias(
        "canonical_targets")))
    return joined.withColumn("request_fingerprint", F.sha2(payload, 256)).drop("targets_digest")


def idempotency_outcome(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """NEW, REPLAY or CONFLICT per incoming request, by idempotency key and fingerprint."""
    known = stored.select(*key, F.col("request_fingerprint").alias("__stored"))
    outcome = F.when(F.col("__stored").isNull(), F.lit("NEW")).when(
        F.col("__stored") == F.col("request_fingerprint"), F.lit("REPLAY")
    ).otherwise(F.lit("CONFLICT"))
    return incoming.join(known, key, "left").withColumn("outcome", outcome).drop("__stored")


def interleave_by_domain(
    df: DataFrame, batch: tuple[str, ...] = (), index: str = "original_index"
) -> DataFrame:
    """Round-robin over domains: `domain_rank`, the rank of an item within its domain, and
    `position`, its place (from 1) when all first items come first, by domain name, then all second
    ones.

    `df` and its ranks are written to shared storage: a sequence reads its input in up to ten
    branches, and two of them in a row would plan and run `df` sixty times.
    """
    ranked = materialize(sequence_within(
        materialize(df), [*batch, "domain_key"], [F.col(index)],
        bucket=F.floor(F.col(index) / 100_000), name="domain_rank"))
    # a bucket is a round and the start of a name, so that no round meets in one task; the counts of
    # a round's buckets, of a thousand rounds, and of all thousands are added up apart
    return sequence_within(
        ranked, list(batch), [F.col("domain_rank"), F.col("domain_key")],
        bucket=F.struct("domain_rank", F.substring("domain_key", 1, 3)), name="position",
        wider=[F.floor(F.col("domain_rank") / 1_000), F.col("domain_rank")])
