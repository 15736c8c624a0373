"""E-mail candidates, validation, category, masking and hashing as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import ExtractionConfig
from contactgrid.functions import html
from contactgrid.functions.hosts import ascii_host
from contactgrid.functions.stages import Getter, Stage
from contactgrid.functions.suffixes import (
    DEFAULT_RULES,
    SuffixRules,
    domain_under_suffix,
    suffix_size,
)
from contactgrid.functions.text import (
    SPACE,
    collapse_space,
    decode_entities,
    evidence_snippet,
    first_items,
    is_ascii,
    strip_space,
)
from contactgrid.functions.urls import decode_percent

_PART = rf"[^{SPACE}@:<>()\",;]"
# the look-behind starts a match only where a run of allowed characters starts: linear time
PLAIN_PATTERN = rf"(?<!{_PART}){_PART}++@{_PART}+\.{_PART}+"

# case-insensitive letters also cover four non-ASCII letters that fold to ASCII ones
_LETTER = r"a-zA-Z\x{130}\x{131}\x{17f}\x{212a}"
_LOCAL = rf"[{_LETTER}0-9._%+\-]"
_GAP = rf"[{SPACE}]*+"
_AT = r"(?:\[at\]|\(at\)|\bat\b)"
_DOT = r"(?:\[dot\]|\(dot\)|\bdot\b)"
_TAIL = rf"{_GAP}{_AT}{_GAP}[{_LETTER}0-9.\-]+{_GAP}{_DOT}{_GAP}[{_LETTER}]{{2,}}"
OBFUSCATED_PATTERN = rf"(?iU)(?:(?<!{_LOCAL})|\G)[.%+\-]*?\b({_LOCAL}+{_TAIL})\b"
_OBFUSCATED_PARTS = (
    rf"(?iU)^({_LOCAL}+){_GAP}{_AT}{_GAP}([{_LETTER}0-9.\-]+){_GAP}{_DOT}{_GAP}([{_LETTER}]{{2,}})$"
)
_TRIM = "[" + "".join("\\" + ch for ch in ref.TRIM_PUNCTUATION) + "]"


def trim_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_TRIM}++|(?<!{_TRIM}){_TRIM}++$", "")


def _candidate(kind: str, raw: Column, snippet: Column) -> Column:
    return F.struct(F.lit(kind).alias("source_kind"), raw.alias("raw_candidate"),
                    snippet.alias("snippet"))


def mailto_candidates(href: Column, config: ExtractionConfig) -> Column:
    """Candidates of one mailto link (already unescaped once by the markup)."""
    body = F.substring_index(decode_percent(decode_entities(strip_space(href))), "?", 1)
    body = F.regexp_replace(body, "(?i)^mailto:", "")
    evidence = F.substring(
        collapse_space(F.concat(F.lit("mailto:"), body)), 1, config.max_evidence_length)
    recipients = F.transform(
        F.split(body, "[,;]"), lambda r: trim_punctuation(strip_space(r)))
    return F.transform(F.filter(recipients, lambda r: r != ""),
                       lambda r: _candidate("MAILTO", r, evidence))


def plain_candidates(text: Column, config: ExtractionConfig) -> Column:
    """Candidates written out in the text, in order; texts without `@` cost one scan."""
    found = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(PLAIN_PATTERN), 0))
    found = F.coalesce(found, F.array().cast("array<string>"))
    candidates = F.transform(found, lambda raw: _candidate(
        "VISIBLE_TEXT", trim_punctuation(raw),
        evidence_snippet(text, raw, config.max_evidence_length)))
    return F.filter(candidates, lambda c: c["raw_candidate"].contains("@"))


def obfuscated_candidates(text: Column, config: ExtractionConfig) -> Column:
    """Candidates spelled with `at` and `dot`, put together again."""
    low = F.lower(text)
    spelled = low.contains("dot") & low.contains("at")
    found = F.when(spelled, F.regexp_extract_all(text, F.lit(OBFUSCATED_PATTERN), 1))
    found = F.coalesce(found, F.array().cast("array<string>"))

    def rebuilt(match: Column) -> Column:
        local, domain, tld = (
            F.regexp_extract(match, _OBFUSCATED_PARTS, i) for i in (1, 2, 3))
        return F.concat(local, F.lit("@"), domain, F.lit("."), tld)

    return F.transform(found, lambda match: _candidate(
        "OBFUSCATED_TEXT", rebuilt(match),
        evidence_snippet(text, match, config.max_evidence_length)))


@lru_cache(maxsize=None)
def candidate_stages(config: ExtractionConfig, from_html: bool) -> tuple[Stage, ...]:
    """Stages to `candidates`: mailto, then visible, then obfuscated, capped in that order.

    From `html` the markup is parsed first; from `visible_text` only the text is searched.
    """

    def mailto(c: Getter) -> dict[str, Column]:
        # most pages hold no such link: their markup is not read a second time
        links = F.when(c("html").rlike("(?i)mailto|href[^>]*+&"), html.link_addresses(html.mark_tags(c("html"), html.TEXT_MARKUP)))
        links = F.transform(
            F.coalesce(links, F.array().cast("array<string>")),
            lambda value: strip_space(decode_entities(value, in_attribute=True)))
        return {"mailto": F.flatten(F.transform(
            F.filter(links, lambda value: F.lower(value).startswith("mailto:")),
            lambda value: mailto_candidates(value, config)))}

    def no_mailto(c: Getter) -> dict[str, Column]:
        return {"mailto": F.array().cast(
            "array<struct<source_kind:string,raw_candidate:string,snippet:string>>")}

    def collected(c: Getter) -> dict[str, Column]:
        groups = [c("mailto"), plain_candidates(c("visible_text"), config)]
        if config.allow_obfuscated:
            groups.append(obfuscated_candidates(c("visible_text"), config))
        return {"candidates": first_items(F.concat(*groups), config.max_raw_candidates)}

    if from_html:
        return (*html.visible_text_stages(), mailto, collected)
    return (no_mailto, collected)


@lru_cache(maxsize=None)
def validation_stages(
    config: ExtractionConfig, rules: SuffixRules = DEFAULT_RULES
) -> tuple[Stage, ...]:
    """Stages from `raw_candidate` to the parts, `rejection_code`, `reason` and `canonical_email`.

    The first failing rule gives the code, so the rules form one ordered `CASE`.
    """

    def parts(c: Getter) -> dict[str, Column]:
        raw = c("raw_candidate")
        domain = F.substring_index(raw, "@", -1)
        return {
            "raw_domain": domain,
            "local_part": F.substr(raw, F.lit(1), F.length(raw) - F.length(domain) - 1),
        }

    def encoded(c: Getter) -> dict[str, Column]:
        return {"domain": F.lower(ascii_host(c("raw_domain"))),
                "low_local": F.lower(c("local_part"))}

    def names(c: Getter) -> dict[str, Column]:
        return {
            "canonical": F.concat(c("low_local"), F.lit("@"), c("domain")),
            "labels": F.split(c("domain"), r"\."),
            "suffix_size": suffix_size(c("domain"), rules),
        }

    def checks(c: Getter) -> dict[str, Column]:
        bad = F.filter(c("labels"), lambda x: ~x.rlike(
            "^[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?$"))
        return {
            "bad_label": F.try_element_at(bad, F.lit(1)),
            "registrable_domain": domain_under_suffix(c("domain"), c("suffix_size")),
        }

    def verdict(c: Getter) -> dict[str, Column]:
        local, domain, low = c("local_part"), c("domain"), c("low_local")
        extensions = "|".join(e.removeprefix(".") for e in ref.ASSET_LIKE_LOCALS)
        never = F.lit(False)
        edge_dot = (local.startswith(".") | local.endswith(".")
                    | c("raw_domain").startswith(".") | c("raw_domain").endswith("."))
        placeholder = (domain.isin(*ref.PLACEHOLDER_DOMAINS) | domain.endswith(".invalid")
                       | domain.endswith(".example"))
        rules_in_order = (
            (~is_ascii(local), "INVALID_SYNTAX",
             F.lit("Unicode local parts are not supported")),
            (F.length(local) > 64, "LOCAL_PART_TOO_LONG", F.concat(
                F.lit("Local part length ("), F.length(local).cast("string"),
                F.lit(") exceeds 64 characters"))),
            (local.contains("..") | c("raw_domain").contains(".."), "INVALID_SYNTAX",
             F.lit("Email contains consecutive dots")),
            (edge_dot, "INVALID_SYNTAX", F.lit("Email contains leading or trailing dots")),
            (domain.isNull(), "INVALID_DOMAIN_LABEL",
             F.concat(F.lit("Invalid IDNA domain encoding: "), c("raw_domain"))),
            (F.length(c("canonical")) > 254, "TOTAL_LENGTH_TOO_LONG", F.concat(
                F.lit("Total email length ("), F.length(c("canonical")).cast("string"),
                F.lit(") exceeds 254 characters"))),
            (F.size(c("labels")) < 2, "INVALID_DOMAIN_LABEL",
             F.lit("Domain must contain at least two labels")),
            (c("bad_label").contains("_"), "INVALID_DOMAIN_LABEL",
             F.concat(F.lit("Domain label contains underscore: "), c("bad_label"))),
            (c("bad_label").isNotNull(), "INVALID_DOMAIN_LABEL",
             F.concat(F.lit("Domain label is invalid: "), c("bad_label"))),
            (c("registrable_domain").isNull(), "NO_PUBLIC_SUFFIX",
             F.concat(F.lit("Domain lacks a valid public suffix: "), domain)),
            (placeholder, "PLACEHOLDER_DOMAIN",
             F.concat(F.lit("Domain is a reserved/placeholder domain: "), domain)),
            (low.rlike(rf"\.(?:{extensions})\z"), "FILE_EXTENSION_LIKE",
             F.concat(F.lit("Local part appears to be a static asset filename: "), local)),
            (low.isin(*ref.NO_REPLY_LOCALS) if config.reject_no_reply else never,
             "NO_REPLY_ADDRESS",
             F.concat(F.lit("No-reply address rejected by policy: "), local)),
            (low.isin(*ref.DUMMY_LOCALS) if config.reject_dummy_test else never,
             "DUMMY_TEST_ADDRESS",
             F.concat(F.lit("Dummy/test address rejected by policy: "), local)),
        )
        code = reason = None
        for test, name, text in rules_in_order:
            code = F.when(test, F.lit(name)) if code is None else code.when(test, F.lit(name))
            reason = F.when(test, text) if reason is None else reason.when(test, text)
        return {"rejection_code": code, "reason": reason}

    def accepted(c: Getter) -> dict[str, Column]:
        return {
            "canonical_email": F.when(c("rejection_code").isNull(), c("canonical")),
            "category": category(c("low_local")),
        }

    return (parts, encoded, names, checks, verdict, accepted)


VALIDATION_FIELDS = ("local_part", "domain", "registrable_domain", "canonical_email",
                     "rejection_code", "reason", "category")


def category(local_part: Column) -> Column:
    low = F.lower(local_part)
    return F.when(low.isin(*ref.NO_REPLY_LOCALS), F.lit("NO_REPLY")).when(
        low.isin(*ref.ROLE_LOCALS), F.lit("ROLE_BASED")).when(
        low.rlike(r"\p{L}"), F.lit("PERSONAL_OR_NAMED")).otherwise(F.lit("UNKNOWN"))


def domain_affinity(
    domain: Column, domain_registrable: Column, host: Column, host_registrable: Column
) -> Column:
    """Relation of an address domain to the page host; unknown never equals unknown."""
    return F.when(F.lower(domain) == F.lower(host), F.lit("EXACT_HOST")).when(
        domain_registrable == host_registrable, F.lit("SAME_REGISTRABLE_DOMAIN")
    ).otherwise(F.lit("EXTERNAL"))


def mask_candidate(candidate: Column) -> Column:
    """`john.doe@acme.com` becomes `j***e@acme.com`; short local parts lose more."""
    text = F.lower(strip_space(candidate))
    domain = F.substring_index(text, "@", -1)
    size = F.length(text) - F.length(domain) - 1
    first = F.substring(text, 1, 1)
    last = F.substr(text, size, F.lit(1))
    local = (
        F.when(size == 0, F.lit("***")).when(size == 1, F.lit("*"))
        .when(size == 2, F.concat(first, F.lit("*")))
        .when(size == 3, F.concat(first, F.lit("*"), last))
        .otherwise(F.concat(first, F.lit("***"), last)))
    return F.when(candidate != "", F.when(
        ~text.contains("@"), F.lit("***")).otherwise(F.concat(local, F.lit("@"), domain)))


def candidate_hash(candidate: Column, snippet: Column | None = None) -> Column:
    tail = F.lit("") if snippet is None else strip_space(F.coalesce(snippet, F.lit("")))
    return F.sha2(F.concat(F.lower(strip_space(candidate)), F.lit(":"), tail), 256)


def is_free_provider(domain: Column, registrable: Column) -> Column:
    return F.coalesce(F.lower(strip_space(domain)).isin(*ref.FREE_PROVIDERS), F.lit(False)) | (
        F.coalesce(F.lower(registrable).isin(*ref.FREE_PROVIDERS), F.lit(False)))
