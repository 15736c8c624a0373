"""E-mail extraction from pages or plain texts.

Parsing, candidate search and snippets happen inside the page's row; only the few candidates leave
it. What is shuffled afterwards is candidate-sized, never page-sized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import ExtractionConfig
from contactgrid.functions import emails
from contactgrid.functions.stages import run_on_columns, run_on_elements
from contactgrid.functions.suffixes import DEFAULT_RULES, SuffixRules
from contactgrid.operators.keyed import winner_per_key
from contactgrid.operators.links import with_source

SOURCE_COLUMNS = ("source_normalized_url", "source_hostname", "source_path",
                  "source_registrable_domain", "source_error_code")


def page_candidates(
    pages: DataFrame,
    config: ExtractionConfig = ExtractionConfig(),
    content: str = "html",
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Pages (page_id, url, content) with the array `candidates` and flag `too_large`.

    `content` is "html" for markup or "text" for text that is already visible. Further columns
    of the input are kept; the content is not.
    """
    source = "html" if content == "html" else "visible_text"
    pages = with_source(pages, rules=rules)
    too_large = F.lit(False) if config.max_html_chars is None else (
        F.length(content) > config.max_html_chars)
    usable = F.col("source_error_code").isNull() & ~too_large
    pages = pages.withColumn("too_large", too_large)
    found = run_on_columns(
        pages, {source: F.when(usable, F.col(content))},
        emails.candidate_stages(config, content == "html"), ["candidates"])
    return found.drop(content)


def _with_verdicts(found: DataFrame, config: ExtractionConfig, rules: SuffixRules) -> DataFrame:
    fields = ["source_kind", "raw_candidate", "snippet"]
    return run_on_elements(
        found, F.col("candidates"), fields, emails.validation_stages(config, rules), "candidates")


def candidate_rows(
    found: DataFrame,
    config: ExtractionConfig = ExtractionConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """One validated row per candidate, in source order (`ordinal`)."""
    kept = [c for c in found.columns if c not in ("candidates", "too_large", "url")]
    rows = found.select(
        *kept, F.posexplode_outer("candidates").alias("ordinal", "c")
    ).filter("ordinal is not null").select(*kept, "ordinal", "c.*")
    rows = run_on_columns(
        rows, {"raw_candidate": F.col("raw_candidate")},
        emails.validation_stages(config, rules), emails.VALIDATION_FIELDS)
    affinity = emails.domain_affinity(
        F.col("domain"), F.col("registrable_domain"), F.col("source_hostname"),
        F.col("source_registrable_domain"))
    rows = rows.withColumn("domain_affinity", F.when(F.col("rejection_code").isNull(), affinity))
    if config.allow_external_domains:
        return rows
    external = F.col("domain_affinity") == "EXTERNAL"
    return rows.withColumns({
        "rejection_code": F.when(external, F.lit("EXTERNAL_DOMAIN_REJECTED")).otherwise(
            F.col("rejection_code")),
        "reason": F.when(external, F.concat(
            F.lit("External domain rejected by policy: "), F.col("domain"))).otherwise(
            F.col("reason")),
        "canonical_email": F.when(~external, F.col("canonical_email")),
    })


def validate_emails(
    df: DataFrame,
    column: str,
    config: ExtractionConfig = ExtractionConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Add parts, verdict, canonical form and category for the candidate in `column`."""
    return run_on_columns(
        df, {"raw_candidate": F.col(column)}, emails.validation_stages(config, rules),
        emails.VALIDATION_FIELDS)


def source_priority(kind: Column) -> Column:
    return _lookup(ref.SOURCE_PRIORITY, kind)


def source_weight(kind: Column) -> Column:
    return _lookup(ref.SOURCE_WEIGHTS, kind)


def _lookup(values: dict[str, int], key: Column) -> Column:
    choice = None
    for name, value in values.items():
        choice = (F.when(key == name, F.lit(value)) if choice is None
                  else choice.when(key == name, F.lit(value)))
    return F.coalesce(choice, F.lit(0))


def page_findings(
    rows: DataFrame, config: ExtractionConfig = ExtractionConfig(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One finding per (page, canonical e-mail) with its representative candidate.

    Representative: source priority, then longer snippet, then smaller raw text. A combined
    aggregate picks it.
    """
    accepted = rows.filter(F.col("rejection_code").isNull()).select(
        "page_id", *keep, "canonical_email",
        F.col("source_normalized_url").alias("source_url"),
        "source_path", "raw_candidate", "local_part", "domain", "registrable_domain",
        "source_kind", "category", "domain_affinity", "snippet", "ordinal")
    best = winner_per_key(accepted, ["page_id", *keep, "canonical_email"], [
        -source_priority(F.col("source_kind")), -F.length("snippet"), F.col("raw_candidate"),
        F.col("ordinal")]).drop("ordinal")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("canonical_email"))
    return _ranked(best, "finding_rank", rank, config.max_accepted_findings)


def _ranked(rows: DataFrame, name: str, rank: Column, limit: int | None) -> DataFrame:
    ranked = rows.withColumn(name, rank)
    return ranked if limit is None else ranked.filter(F.col(name) <= limit)


def page_evidence(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of accepted candidates, distinct on (page, e-mail, kind, snippet), first kept."""
    accepted = rows.filter(F.col("rejection_code").isNull()).select(
        "page_id", *keep, "canonical_email", "source_kind", "snippet",
        F.col("source_normalized_url").alias("source_url"), "source_path", "raw_candidate",
        "ordinal")
    return winner_per_key(
        accepted, ["page_id", *keep, "canonical_email", "source_kind", "snippet"],
        [F.col("ordinal")])


def rejected_candidates(
    rows: DataFrame, config: ExtractionConfig = ExtractionConfig()
) -> DataFrame:
    """Distinct rejected candidates per page, ordered by (raw text, code)."""
    distinct = rows.filter(F.col("rejection_code").isNotNull()).select(
        "page_id", F.col("source_normalized_url").alias("source_url"), "raw_candidate",
        "rejection_code", "reason", "source_kind", "snippet").distinct()
    order = W.partitionBy("page_id").orderBy(
        "raw_candidate", "rejection_code", "source_kind", "snippet")
    return _ranked(distinct, "rejected_rank", F.row_number().over(order),
                   config.max_rejected_candidates)


def page_outcomes(
    found: DataFrame,
    config: ExtractionConfig = ExtractionConfig(),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Outcome per page, decided inside the row: no join back to the findings."""
    df = _with_verdicts(found, config, rules)
    valid = F.exists("candidates", lambda c: c["rejection_code"].isNull())
    if not config.allow_external_domains:
        valid = F.exists("candidates", lambda c: c["rejection_code"].isNull() & (
            (c["domain"] == F.col("source_hostname"))
            | F.coalesce(c["registrable_domain"] == F.col("source_registrable_domain"),
                         F.lit(False))))
    outcome = (
        F.when(F.col("too_large"), F.lit("HTML_TOO_LARGE"))
        .when(F.col("source_error_code").isNotNull(), F.lit("INVALID_SOURCE_URL"))
        .when(valid, F.lit("SUCCESS")).otherwise(F.lit("NO_EMAILS_FOUND")))
    return df.select("page_id", F.size("candidates").alias("candidates"),
                     outcome.alias("outcome"))


def site_findings(findings: DataFrame, evidence: DataFrame, site: str, order: str) -> DataFrame:
    """Findings merged over the pages of a site.

    The representative fields come from the first page in visiting order (`order`); evidence is
    counted once per (source address, kind, snippet) and stays in its own flat table, because an
    address printed on every page of a large site has as many records as the site has pages.
    """
    first = winner_per_key(
        findings.select(
            site, "canonical_email", F.col(order).alias("__order"), "source_url",
            "raw_candidate", "local_part", "domain", "registrable_domain", "source_kind",
            "category", "domain_affinity", "snippet"),
        [site, "canonical_email"], [F.col("__order")]).drop("__order")
    counts = site_evidence(evidence, site).groupBy(site, "canonical_email").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max("page_score").alias("max_page_score"),
        F.max(source_weight(F.col("source_kind"))).alias("best_source_weight"))
    return first.join(counts, [site, "canonical_email"])


def site_evidence(evidence: DataFrame, site: str) -> DataFrame:
    """Flat evidence of a site, distinct on (e-mail, source address, kind, snippet)."""
    return winner_per_key(
        evidence.select(site, "canonical_email", "source_url", "source_kind", "snippet",
                        "raw_candidate", "page_score"),
        [site, "canonical_email", "source_url", "source_kind", "snippet"],
        [-F.col("page_score"), F.col("raw_candidate")])
