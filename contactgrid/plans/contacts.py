"""End-to-end jobs: address review, and from a stored corpus to one contact per site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid.config import ExtractionConfig
from contactgrid.functions import scoring
from contactgrid.functions.suffixes import DEFAULT_RULES, SuffixRules
from contactgrid.operators import extraction, primary
from contactgrid.operators.addresses import classify_addresses, review_classified
from contactgrid.session import materialize


def review_list(
    addresses: DataFrame, overrides: DataFrame | None = None, batch: tuple[str, ...] = (),
    rules: SuffixRules = DEFAULT_RULES,
) -> DataFrame:
    """Review of an address list that parses every address once."""
    classified = materialize(classify_addresses(addresses, rules=rules))
    return review_classified(classified, overrides, batch)


def with_page_score(rows: DataFrame) -> DataFrame:
    """Score of the page a row comes from, as the start page of a visit is scored."""
    path = F.col("source_path")
    return rows.withColumn("page_score", scoring.page_score(
        scoring.scoring_path(path), scoring.scoring_text(path, F.lit(""))))


@dataclass(frozen=True)
class SiteContacts:
    """Tables of one extraction run."""

    candidates: DataFrame
    findings: DataFrame
    evidence: DataFrame
    scored: DataFrame
    primary: DataFrame


def site_contacts(
    pages: DataFrame, site: str = "site", content: str = "html",
    config: ExtractionConfig = ExtractionConfig(), rules: SuffixRules = DEFAULT_RULES,
) -> SiteContacts:
    """From pages (page_id, site, url, content) to findings, evidence and primary addresses.

    The pages are scanned once. What they yield, a few candidates each, is written to shared
    storage, and every later step reads that table.
    """
    found = extraction.page_candidates(pages, config, content, rules)
    rows = materialize(extraction.candidate_rows(found, config, rules))
    page_findings = extraction.page_findings(rows, config, keep=(site,))
    evidence = with_page_score(extraction.page_evidence(rows, keep=(site,)))
    findings = extraction.site_findings(page_findings, evidence, site, "page_id")
    scored = primary.score_candidates(findings, evidence, site)
    return SiteContacts(rows, findings, evidence, scored, primary.select_primary(scored, site))
