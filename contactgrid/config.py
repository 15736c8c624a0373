"""Frozen settings passed to operators. A limit that is None does not limit."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from contactgrid import reference_data as ref


def _at_least_one(settings: object, *names: str) -> None:
    for name in names:
        value = getattr(settings, name)
        if value is not None and value < 1:
            raise ValueError(f"INVALID_LIMIT: {name} must be at least 1.")


@dataclass(frozen=True)
class DiscoveryConfig:
    scope: str = "SAME_REGISTRABLE_DOMAIN"
    max_html_chars: int | None = None
    max_raw_anchors: int | None = None
    max_discovered_links: int | None = None
    max_ranked_pages: int | None = None
    asset_extensions: tuple[str, ...] = ref.ASSET_EXTENSIONS

    def __post_init__(self) -> None:
        _at_least_one(self, "max_html_chars", "max_raw_anchors", "max_discovered_links",
                      "max_ranked_pages")
        if (self.max_ranked_pages is not None and self.max_discovered_links is not None
                and self.max_ranked_pages > self.max_discovered_links):
            raise ValueError("INVALID_LIMIT: max_ranked_pages exceeds max_discovered_links.")
        if self.scope not in ("SAME_ORIGIN", "SAME_REGISTRABLE_DOMAIN"):
            raise ValueError(f"unknown scope {self.scope!r}")


@dataclass(frozen=True)
class ExtractionConfig:
    max_html_chars: int | None = None
    max_raw_candidates: int | None = None
    max_accepted_findings: int | None = None
    max_rejected_candidates: int | None = None
    max_evidence_length: int = 120
    allow_obfuscated: bool = True
    allow_external_domains: bool = True
    reject_no_reply: bool = True
    reject_dummy_test: bool = True

    def __post_init__(self) -> None:
        _at_least_one(self, "max_html_chars", "max_raw_candidates", "max_accepted_findings",
                      "max_rejected_candidates")
        if self.max_evidence_length < 10:
            raise ValueError("INVALID_LIMIT: max_evidence_length must be at least 10.")


@dataclass(frozen=True)
class SiteScanConfig:
    """Budgets of a visit; a best-first visit is defined by them, so they have no defaults."""

    max_pages: int
    max_depth: int
    max_total_discovered_urls: int
    discovery: DiscoveryConfig = field(default_factory=DiscoveryConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)

    def __post_init__(self) -> None:
        _at_least_one(self, "max_pages", "max_total_discovered_urls")
        if self.max_depth < 0:
            raise ValueError("INVALID_LIMIT: max_depth must be non-negative.")


@dataclass(frozen=True)
class FetchRetryPolicy:
    """Delay before repeating one request."""

    base_delay_seconds: float = 0.5
    max_delay_seconds: float = 10.0
    jitter_fraction: float = 0.1


@dataclass(frozen=True)
class BackoffPolicy:
    """Delay before repeating a whole scan."""

    base_delay_seconds: float = 5.0
    factor: float = 2.0
    max_delay_seconds: float = 3600.0

    def __post_init__(self) -> None:
        values = (self.base_delay_seconds, self.factor, self.max_delay_seconds)
        if not all(math.isfinite(v) for v in values):
            raise ValueError("backoff settings must be finite")
        if (self.base_delay_seconds <= 0 or self.factor < 1.0
                or self.max_delay_seconds < self.base_delay_seconds):
            raise ValueError("backoff settings are out of range")


@dataclass(frozen=True)
class IngestLimits:
    max_inputs_per_job: int = 10_000
    max_input_length: int = 2_048
    max_configuration_bytes: int = 65_536


@dataclass(frozen=True)
class ResultCaps:
    max_pages: int | None = None
    max_findings: int | None = None
    max_rejected: int | None = None
    max_snippet_length: int | None = None
    max_candidate_length: int | None = None
    max_content_type_length: int | None = None
    max_redirect_hops: int | None = None
