"""Selection of one primary address per site with explainable scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.functions import emails
from contactgrid.functions.text import strip_space
from contactgrid.operators.extraction import source_weight
from contactgrid.operators.keyed import top_per_key, winner_per_key

TIER_NAMES = ("SAME_DOMAIN", "EXTERNAL_BUSINESS", "FREE_PROVIDER_FALLBACK")


def eligible(findings: DataFrame) -> DataFrame:
    """Findings that may become primary: a real address that accepts replies."""
    return findings.filter(
        F.col("canonical_email").contains("@") & (F.col("category") != "NO_REPLY")
        & ~F.lower("local_part").isin(*ref.NO_REPLY_LOCALS))


def tier() -> Column:
    """0 same domain, 1 external business, 2 free provider."""
    same = F.col("domain_affinity").isin("EXACT_HOST", "SAME_REGISTRABLE_DOMAIN")
    free = emails.is_free_provider(F.col("domain"), F.col("registrable_domain"))
    return F.when(same, F.lit(0)).when(free, F.lit(2)).otherwise(F.lit(1))


def distinct_evidence(evidence: DataFrame, site: str) -> DataFrame:
    """Evidence once per (e-mail, address, kind, snippet), both texts trimmed."""
    return winner_per_key(
        evidence.withColumns({"__url": strip_space(F.col("source_url")),
                              "__text": strip_space(F.col("snippet"))}),
        [site, "canonical_email", "__url", "source_kind", "__text"],
        [-F.col("page_score"), F.col("raw_candidate")]).drop("__url", "__text")


def evidence_order() -> list[Column]:
    return [-source_weight(F.col("source_kind")), -F.col("page_score"), F.col("source_url"),
            F.col("snippet")]


def ordered_evidence(evidence: DataFrame, site: str, k: int) -> DataFrame:
    """The `k` strongest records per finding: kind weight, page score, address, text."""
    return top_per_key(
        distinct_evidence(evidence, site), [site, "canonical_email"], evidence_order(), k,
        "evidence_rank")


def score_candidates(findings: DataFrame, evidence: DataFrame, site: str) -> DataFrame:
    """Score and its parts per (site, e-mail); every aggregate is combined before the shuffle."""
    candidates = winner_per_key(
        eligible(findings).withColumn("tier", tier()).select(
            site, "canonical_email", "local_part", "domain", "category", "domain_affinity",
            "tier"),
        [site, "canonical_email"], [F.col("tier"), F.col("domain_affinity")])
    strength = distinct_evidence(evidence, site).groupBy(site, "canonical_email").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.max(source_weight(F.col("source_kind"))).alias("source_score"),
        F.greatest(F.max("page_score"), F.lit(0)).alias("max_page_score"),
        F.min_by(F.struct("source_url", "raw_candidate", "snippet", "source_kind"),
                 F.struct(*[o.alias(f"o{i}") for i, o in enumerate(evidence_order())])
                 ).alias("first_evidence"))
    df = candidates.join(strength, [site, "canonical_email"], "left").fillna(
        {"evidence_count": 0, "max_page_score": 0, "source_score": 100})
    local = F.lower("local_part")
    top_role = F.array_position(F.array(*map(F.lit, ref.TOP_CONTACT_ROLES)), local)
    role_kind = (
        F.when(top_role > 0, F.lit("TOP_CONTACT_ROLE"))
        .when(F.col("category") == "PERSONAL_OR_NAMED", F.lit("PERSONAL_NAMED"))
        .when(local.isin(*ref.RECRUITMENT_ROLES), F.lit("RECRUITMENT_ROLE"))
        .when(local.isin(*ref.UTILITY_ROLES), F.lit("UTILITY_LEGAL_ROLE"))
        .otherwise(F.lit("ROLE_BASED")))
    role_score = (
        F.when(top_role > 0, 5000 + len(ref.TOP_CONTACT_ROLES) + 1 - top_role)
        .when(F.col("category") == "PERSONAL_OR_NAMED", F.lit(3000))
        .when(local.isin(*ref.RECRUITMENT_ROLES), F.lit(1000))
        .when(local.isin(*ref.UTILITY_ROLES), F.lit(500)).otherwise(F.lit(800)))
    affinity_name = F.when(F.col("tier") == 0, F.col("domain_affinity")).when(
        F.col("tier") == 1, F.lit("EXTERNAL_BUSINESS")).otherwise(
        F.lit("FREE_PROVIDER_FALLBACK"))
    affinity_score = (
        F.when((F.col("tier") == 0) & (F.col("domain_affinity") == "EXACT_HOST"), F.lit(15000))
        .when(F.col("tier") == 0, F.lit(10000)).when(F.col("tier") == 1, F.lit(2000))
        .otherwise(F.lit(1000)))
    df = df.withColumns({
        "affinity_name": affinity_name,
        "affinity_score": affinity_score,
        "role_kind": role_kind,
        "role_score": role_score.cast("int"),
        "frequency_score": F.least(F.lit(50), F.col("evidence_count") * 10).cast("int"),
    })
    total = (F.col("affinity_score") + F.col("role_score") + F.col("source_score")
             + F.col("max_page_score") + F.col("frequency_score"))
    return df.withColumn("score", total.cast("int"))


def active_tier(scored: DataFrame, site: str) -> DataFrame:
    """Candidates of the best tier present on each site."""
    best = scored.groupBy(site).agg(F.min("tier").alias("__tier"))
    return scored.join(best, site).filter(F.col("tier") == F.col("__tier")).drop("__tier")


def signals() -> Column:
    """Sorted (name, value, contribution) list that explains a score."""
    kind = None
    for name, weight in ref.SOURCE_WEIGHTS.items():
        test = F.col("source_score") == weight
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))

    def signal(name: str, value: Column, score: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), (-score.cast("int")).alias("low"),
                        value.cast("string").alias("value"))

    listed = F.array_compact(F.array(
        signal("domain_affinity", F.col("affinity_name"), F.col("affinity_score")),
        signal("business_suitability",
               F.concat("role_kind", F.lit(":"), F.lower("local_part")), F.col("role_score")),
        signal("evidence_source_kind", kind, F.col("source_score")),
        F.when(F.col("max_page_score") > 0, signal(
            "page_score", F.col("max_page_score"), F.col("max_page_score"))),
        F.when(F.col("frequency_score") > 0, signal(
            "evidence_frequency", F.col("evidence_count"), F.col("frequency_score")))))
    return F.transform(F.array_sort(listed), lambda s: F.struct(
        s["name"].alias("name"), s["value"].alias("value"), (-s["low"]).alias("contribution")))


def select_primary(scored: DataFrame, site: str) -> DataFrame:
    """One winner per site: best tier, then score, then smaller address.

    A single combined aggregate: the tier leads the ordering, so lower tiers never win while a
    higher one is present, and no site is gathered in one task.
    """
    best = winner_per_key(
        scored.withColumn("signals", signals()), [site],
        [F.col("tier"), -F.col("score"), F.col("canonical_email")])
    return best.select(
        site, "canonical_email", "local_part", "domain", "category", "domain_affinity", "tier",
        "score", "evidence_count", F.col("first_evidence.source_url").alias("source_url"),
        F.col("first_evidence.raw_candidate").alias("raw_candidate"),
        F.col("first_evidence.snippet").alias("snippet"),
        F.col("first_evidence.source_kind").alias("source_kind"), "signals",
        F.lit(ref.SELECTION_VERSION).alias("selection_version"))
