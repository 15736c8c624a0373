"""E-mail extraction, validation and primary selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from catalog.sql import page_score, parsed, quoted, registrable, views
from contactgrid import reference_data as ref
from contactgrid.config import ExtractionConfig
from contactgrid.functions import emails, html
from contactgrid.functions.stages import run_on_columns
from contactgrid.functions.text import collapse_space, csv_cell, sanitize_text, short_digest
from contactgrid.operators import audit, primary
from contactgrid.operators import extraction as X
from contactgrid.operators.links import with_source
from contactgrid.plans import views as V
from contactgrid.plans.contacts import site_contacts, with_page_score
from contactgrid.sources.tables import read_table

_PART = r'[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}@:<>()",;]'
PLAIN = rf"{_PART}+@{_PART}+\.{_PART}+"
_TRIM = r"""[.,;:!?)\]"'']"""
_EDGES = rf"^{_TRIM}+|{_TRIM}+$"
_ASSET = "|".join(e[1:] for e in ref.ASSET_LIKE_LOCALS)
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _snippet(text: str, target: str, size: int = 120) -> str:
    margin = f"greatest(0, ({size} - length({target})) // 2)"
    at = f"(instr({text}, {target}) - 1)"
    start = f"greatest(0, {at} - {margin})"
    return (f"left(trim(regexp_replace(substr({text}, CAST({start} + 1 AS BIGINT), "
            f"CAST({at} + length({target}) + {margin} - {start} AS BIGINT)), "
            f"'{_WS}', ' ', 'g')), {size})")


def _candidates(source: str, key: str, text: str) -> dict[str, str]:
    """CTEs from texts to validated candidates `cand` (host columns come from the parsed page)."""
    return {
        "found": f"""
      SELECT * EXCLUDE ({text}), raw, {_snippet(text, 'raw')} AS snippet,
        regexp_replace(raw, '{_EDGES}', '', 'g') AS raw_candidate
      FROM (SELECT *, unnest(m) AS raw, generate_subscripts(m, 1) - 1 AS ordinal
            FROM (SELECT *, regexp_extract_all({text}, '{PLAIN}') AS m FROM {source}))""",
        "split": r"""
      SELECT *, regexp_extract(raw_candidate, '^(.*)@[^@]*$', 1) AS local_part,
        lower(regexp_extract(raw_candidate, '@([^@]*)$', 1)) AS domain
      FROM found WHERE contains(raw_candidate, '@')""",
        "cand": rf"""
      SELECT *, CASE WHEN rejection_code IS NULL THEN lower(local_part) || '@' || domain END
          AS canonical_email, {registrable('domain')} AS mail_domain,
        CASE WHEN rejection_code IS NOT NULL THEN NULL WHEN domain = hostname THEN 'EXACT_HOST'
          WHEN {registrable('domain')} = registrable_domain THEN 'SAME_REGISTRABLE_DOMAIN'
          ELSE 'EXTERNAL' END AS domain_affinity,
        CASE WHEN lower(local_part) IN ({quoted(ref.NO_REPLY_LOCALS)}) THEN 'NO_REPLY'
          WHEN lower(local_part) IN ({quoted(ref.ROLE_LOCALS)}) THEN 'ROLE_BASED'
          WHEN regexp_matches(local_part, '\p{{L}}') THEN 'PERSONAL_OR_NAMED' ELSE 'UNKNOWN' END
          AS category
      FROM (SELECT *, CASE
          WHEN regexp_matches(local_part, '[^\x00-\x7f]') THEN 'INVALID_SYNTAX'
          WHEN length(local_part) > 64 THEN 'LOCAL_PART_TOO_LONG'
          WHEN contains(local_part, '..') OR contains(domain, '..')
            OR regexp_matches(local_part, '^\.|\.$') OR regexp_matches(domain, '^\.|\.$')
            THEN 'INVALID_SYNTAX'
          WHEN regexp_matches(domain, '[^.]{{64,}}') THEN 'INVALID_DOMAIN_LABEL'
          WHEN length(local_part) + 1 + length(domain) > 254 THEN 'TOTAL_LENGTH_TOO_LONG'
          WHEN NOT regexp_matches(domain,
            '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$')
            THEN 'INVALID_DOMAIN_LABEL'
          WHEN {registrable('domain')} IS NULL THEN 'NO_PUBLIC_SUFFIX'
          WHEN domain IN ({quoted(ref.PLACEHOLDER_DOMAINS)})
            OR regexp_matches(domain, '\.(invalid|example)$') THEN 'PLACEHOLDER_DOMAIN'
          WHEN regexp_matches(lower(local_part), '\.({_ASSET})$') THEN 'FILE_EXTENSION_LIKE'
          WHEN lower(local_part) IN ({quoted(ref.NO_REPLY_LOCALS)}) THEN 'NO_REPLY_ADDRESS'
          WHEN lower(local_part) IN ({quoted(ref.DUMMY_LOCALS)}) THEN 'DUMMY_TEST_ADDRESS'
          END AS rejection_code FROM split)""",
    }


_DOCS = parsed("src", "document_pages", "page_id", "url")
DOCS = views("document_pages", **_DOCS, **_candidates("src", "page_id", "text"))
_REMOVED = r"(?is)<!--.*?(?:-->|\z)|<(?:script)\b[^>]*>.*?(?:</script\b[^>]*>|\z)|<style\b[^>]*>.*?(?:</style\b[^>]*>|\z)|<template\b[^>]*>.*?(?:</template\b[^>]*>|\z)|<noscript\b[^>]*>.*?(?:</noscript\b[^>]*>|\z)"
# the references of the test corpus; all seven are valid without a semicolon, `&amp` comes last
_DECODED = "p"
for _name, _char in (("quot", "'\"'"), ("copy", "chr(169)"), ("middot", "chr(183)"),
                     ("lt", "'<'"), ("gt", "'>'"), ("nbsp", "chr(160)"), ("amp", "'&'")):
    _DECODED = f"regexp_replace({_DECODED}, '&{_name};?', {_char}, 'g')"
VISIBLE = {
    **parsed("src", "pages", "page_id", "url"),
    "visible": rf"""
      SELECT page_id, hostname, registrable_domain, registrable_domain AS site, path,
        normalized_url,
        array_to_string(list_filter(list_transform(
          pieces, lambda p: {_DECODED}), lambda p: regexp_matches(p, '[^\s\x{{a0}}]')), ' ') AS vtext
      FROM (SELECT *, regexp_split_to_array(regexp_replace(html, '{_REMOVED}', '<x>', 'g'),
              '</?[a-zA-Z][^>]*>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\z') AS pieces FROM src)""",
}
PAGES = views(**VISIBLE, **_candidates("visible", "page_id", "vtext"))


def doc_rows(spark, sf, config=ExtractionConfig()):
    found = X.page_candidates(V.document_pages(spark, sf), config, content="text")
    return X.candidate_rows(found, config)


def page_rows(spark, sf):
    pages = read_table(spark, sf, "pages")
    return X.candidate_rows(X.page_candidates(pages))


@register("eml1_visible_text", views(**VISIBLE) + f"""
SELECT page_id, sha256(trim(regexp_replace(vtext, '{_WS}', ' ', 'g'))) AS digest,
  CAST(length(vtext) AS INTEGER) AS size FROM visible""")
def _(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    df = run_on_columns(pages, {"html": F.col("html")}, html.visible_text_stages(),
                        ["visible_text"])
    return df.select("page_id", F.sha2(collapse_space(F.col("visible_text")), 256).alias(
        "digest"), F.length("visible_text").alias("size"))


@register("eml2_mailto_candidates", """
WITH c AS (SELECT c_custkey, lower(replace(c_mktsegment, ' ', '')) AS seg FROM customer)
SELECT c_custkey, CAST(i AS INTEGER) AS position,
  CASE i WHEN 0 THEN 'c' || c_custkey || '@' || seg || '.com' ELSE 'info@' || seg || '.org' END
    AS raw_candidate,
  'mailto:c' || c_custkey || '@' || seg || '.com, info@' || seg || '.org.' AS snippet
FROM c, range(2) t(i)""")
def _(spark, sf):
    seg = F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit("")))
    href = F.concat(
        F.lit(" MailTo:c"), F.col("c_custkey").cast("string"), F.lit("%40"), seg,
        F.lit(".com,%20info&#64;"), seg, F.lit(".org.?subject=Hi&body=a@b.com"))
    df = read_table(spark, sf, "customer").select(
        "c_custkey", F.posexplode(emails.mailto_candidates(href, ExtractionConfig())).alias(
            "position", "c"))
    return df.select("c_custkey", "position", "c.raw_candidate", "c.snippet")


@register("eml3_plain_candidates", DOCS + """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1 AS INTEGER)
  AS ordinal, raw_candidate FROM split""")
def _(spark, sf):
    return doc_rows(spark, sf).select("page_id", "ordinal", "raw_candidate")


@register("eml4_obfuscated_candidates", """
SELECT o_orderkey, 'u' || o_custkey || '@' || lower(left(o_orderpriority, 1)) || 'x-' ||
  (o_orderkey % 7) || '.com' AS raw_candidate FROM orders""")
def _(spark, sf):
    at = F.element_at(F.array(*map(F.lit, (" [at] ", " (AT) ", " at "))),
                      (F.col("o_orderkey") % 3 + 1).cast("int"))
    dot = F.element_at(F.array(*map(F.lit, ("[dot]", " (dot) ", " Dot "))),
                       (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("Look at length, write u"), F.col("o_custkey").cast("string"), at,
        F.lower(F.substring("o_orderpriority", 1, 1)), F.lit("x-"),
        (F.col("o_orderkey") % 7).cast("string"), dot, F.lit("com now, not at the dot."))
    df = read_table(spark, sf, "orders").select("o_orderkey", F.explode(
        emails.obfuscated_candidates(text, ExtractionConfig())).alias("c"))
    return df.select("o_orderkey", "c.raw_candidate")


@register("eml5_snippets", DOCS + "SELECT page_id, raw_candidate, snippet FROM split")
def _(spark, sf):
    return doc_rows(spark, sf).select("page_id", "raw_candidate", "snippet")


@register("eml6_candidate_order", DOCS + """
SELECT page_id, raw_candidate, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ordinal) - 1
  AS INTEGER) AS ordinal FROM split""")
def _(spark, sf):
    return doc_rows(spark, sf).select("page_id", "raw_candidate", "ordinal")


@register("eml7_validation_documents", DOCS + """
SELECT page_id, raw_candidate, rejection_code, canonical_email, count(*) AS copies FROM cand
GROUP BY ALL""")
def _(spark, sf):
    return doc_rows(spark, sf).groupBy(
        "page_id", "raw_candidate", "rejection_code", "canonical_email").agg(
        F.count(F.lit(1)).alias("copies"))


# candidates built from the events table, one kind per remainder, to reach every rule
_BUILT = """
  CASE event_id % 14 WHEN 0 THEN 'info@shop' || user_id || '.com'
    WHEN 1 THEN 'noreply@shop' || user_id || '.com' WHEN 2 THEN 'a..b@shop.com'
    WHEN 3 THEN '.a@shop.com' WHEN 4 THEN 'x@shop_' || user_id || '.com'
    WHEN 5 THEN 'x@' || user_id || '.nosuchtld' WHEN 6 THEN 'me@example.org'
    WHEN 7 THEN 'logo' || user_id || '.png@cdn.net' WHEN 8 THEN 'Test@shop.co.uk'
    WHEN 9 THEN repeat('l', 65) || '@shop.com' WHEN 10 THEN 'x@shop'
    WHEN 11 THEN 'B' || user_id || '@Shop.CO.UK'
    WHEN 12 THEN 'x@' || repeat(repeat('d', 60) || '.', 4) || 'long.com'
    ELSE '4' || user_id || '@-bad.com' END"""


def built(spark, sf):
    return V.events(spark, sf).select("event_id", F.expr(_BUILT).alias("raw_candidate"))


_BUILT_CTES = {"found": f"""
  SELECT event_id, 'shop.co.uk' AS hostname, 'shop.co.uk' AS registrable_domain,
    {_BUILT} AS raw_candidate FROM events""",
               **{k: v for k, v in _candidates("x", "x", "x").items() if k != "found"}}


@register("eml7_validation_rules", views(**_BUILT_CTES) + """
SELECT event_id, raw_candidate, rejection_code, canonical_email FROM cand""")
def _(spark, sf):
    return X.validate_emails(built(spark, sf), "raw_candidate").select(
        "event_id", "raw_candidate", "rejection_code", "canonical_email")


@register("eml8_canonical_forms", views(**_BUILT_CTES) + """
SELECT canonical_email, count(*) AS rows FROM cand WHERE canonical_email IS NOT NULL
GROUP BY canonical_email""")
def _(spark, sf):
    df = X.validate_emails(built(spark, sf), "raw_candidate")
    return df.filter("canonical_email is not null").groupBy("canonical_email").agg(
        F.count(F.lit(1)).alias("rows"))


@register("eml9_categories", views(**_BUILT_CTES) + """
SELECT category, count(*) AS rows FROM cand GROUP BY category""")
def _(spark, sf):
    return X.validate_emails(built(spark, sf), "raw_candidate").groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"))


@register("eml10_affinity_pages", PAGES + """
SELECT page_id, canonical_email, domain_affinity FROM cand WHERE rejection_code IS NULL""")
def _(spark, sf):
    return page_rows(spark, sf).filter("rejection_code is null").select(
        "page_id", "canonical_email", "domain_affinity")


@register("eml11_external_rejection", DOCS + """
SELECT page_id, raw_candidate, CASE WHEN rejection_code IS NULL AND domain_affinity = 'EXTERNAL'
  THEN 'EXTERNAL_DOMAIN_REJECTED' ELSE rejection_code END AS rejection_code FROM cand""")
def _(spark, sf):
    rows = doc_rows(spark, sf, ExtractionConfig(allow_external_domains=False))
    return rows.select("page_id", "raw_candidate", "rejection_code")


_FINDINGS = {"findings": """
  SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY canonical_email) AS INTEGER)
    AS finding_rank
  FROM (SELECT * FROM cand WHERE rejection_code IS NULL QUALIFY row_number() OVER (
    PARTITION BY page_id, canonical_email ORDER BY length(snippet) DESC, raw_candidate, ordinal)
    = 1)"""}
_EVIDENCE = {"evidence": f"""
  SELECT page_id, site, normalized_url AS source_url, canonical_email, 'VISIBLE_TEXT'
    AS source_kind, snippet, raw_candidate, {page_score('lower(path)', "lower(path) || ' '")}
    AS page_score
  FROM cand WHERE rejection_code IS NULL QUALIFY row_number() OVER (
    PARTITION BY page_id, canonical_email, snippet ORDER BY ordinal) = 1"""}
_DOC_CTES = {**_DOCS, **_candidates("src", "page_id", "text")}
DOC_ALL = views("document_pages", **_DOC_CTES, **_FINDINGS, **_EVIDENCE)


def doc_findings(spark, sf):
    return X.page_findings(doc_rows(spark, sf), keep=("site",))


def doc_evidence(spark, sf):
    return with_page_score(X.page_evidence(doc_rows(spark, sf), keep=("site",)))


@register("eml12_findings", DOC_ALL + """
SELECT page_id, canonical_email, raw_candidate, snippet, domain_affinity, category, finding_rank
FROM findings""")
def _(spark, sf):
    return doc_findings(spark, sf).select(
        "page_id", "canonical_email", "raw_candidate", "snippet", "domain_affinity", "category",
        "finding_rank")


@register("eml13_evidence", DOC_ALL + """
SELECT page_id, canonical_email, source_kind, snippet, raw_candidate, page_score FROM evidence""")
def _(spark, sf):
    return doc_evidence(spark, sf).select(
        "page_id", "canonical_email", "source_kind", "snippet", "raw_candidate", "page_score")


@register("eml14_rejected", DOC_ALL + """
SELECT page_id, raw_candidate, rejection_code, CAST(row_number() OVER (PARTITION BY page_id
  ORDER BY raw_candidate, rejection_code, snippet) AS INTEGER) AS rejected_rank
FROM (SELECT DISTINCT page_id, raw_candidate, rejection_code, snippet FROM cand
      WHERE rejection_code IS NOT NULL)""")
def _(spark, sf):
    return X.rejected_candidates(doc_rows(spark, sf)).select(
        "page_id", "raw_candidate", "rejection_code", "rejected_rank")


@register("eml15_page_outcomes", DOC_ALL + """
SELECT s.page_id, CASE WHEN count(c.page_id) FILTER (c.rejection_code IS NULL) > 0 THEN 'SUCCESS'
  ELSE 'NO_EMAILS_FOUND' END AS outcome, CAST(count(c.page_id) AS INTEGER) AS candidates
FROM src s LEFT JOIN cand c ON c.page_id = s.page_id GROUP BY s.page_id""")
def _(spark, sf):
    return X.page_outcomes(X.page_candidates(V.document_pages(spark, sf), content="text"))


_MASK = """CASE WHEN NOT contains(raw_candidate, '@') THEN '***' ELSE
  CASE length(l) WHEN 0 THEN '***' WHEN 1 THEN '*' WHEN 2 THEN left(l, 1) || '*'
    WHEN 3 THEN left(l, 1) || '*' || right(l, 1) ELSE left(l, 1) || '***' || right(l, 1) END
  || '@' || d END"""


@register("eml16_masked", views(**_BUILT_CTES) + f"""
SELECT event_id, {_MASK} AS masked FROM (SELECT *, lower(local_part) AS l, domain AS d FROM split)
""")
def _(spark, sf):
    return built(spark, sf).select(
        "event_id", emails.mask_candidate(F.col("raw_candidate")).alias("masked"))


@register("eml17_candidate_hashes", DOCS + """
SELECT page_id, raw_candidate, sha256(lower(trim(raw_candidate)) || ':' || trim(snippet))
  AS candidate_hash FROM split""")
def _(spark, sf):
    return doc_rows(spark, sf).select("page_id", "raw_candidate", emails.candidate_hash(
        F.col("raw_candidate"), F.col("snippet")).alias("candidate_hash"))


@register("eml18_sanitized_text", rf"""
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(text,
  '[\x00-\x1f\x7f-\x{{9f}}]+', ' ', 'g'), '{_WS}', ' ', 'g')), '') AS clean FROM documents""")
def _(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", sanitize_text(F.col("text")).alias("clean"))


_SITE = {"site_evidence": """
  SELECT site, canonical_email, source_url, snippet, max(page_score) AS page_score,
    arg_min(raw_candidate, (-page_score, raw_candidate)) AS raw_candidate
  FROM evidence GROUP BY site, canonical_email, source_url, snippet""",
         "site_findings": """
  SELECT f.site, f.canonical_email, f.raw_candidate, f.snippet, f.local_part, f.domain,
    f.mail_domain, f.category, f.domain_affinity, n.evidence_count, n.max_page_score
  FROM (SELECT * FROM findings QUALIFY row_number() OVER (
          PARTITION BY site, canonical_email ORDER BY page_id) = 1) f
  JOIN (SELECT site, canonical_email, count(*) AS evidence_count,
          max(page_score) AS max_page_score FROM site_evidence GROUP BY ALL) n
    ON n.site = f.site AND n.canonical_email = f.canonical_email"""}
DOC_SITES = views("document_pages", **_DOC_CTES, **_FINDINGS, **_EVIDENCE, **_SITE)


def contacts(spark, sf):
    return site_contacts(V.document_pages(spark, sf), site="site", content="text")


def site_tables(spark, sf):
    found = contacts(spark, sf)
    return found.findings, found.evidence


@register("eml19_site_findings", DOC_SITES + """
SELECT site, canonical_email, raw_candidate, snippet, evidence_count, max_page_score
FROM site_findings""")
def _(spark, sf):
    findings, _ = site_tables(spark, sf)
    return findings.select("site", "canonical_email", "raw_candidate", "snippet",
                           "evidence_count", "max_page_score")


@register("set1_rejected_by_site", DOC_ALL + """
SELECT DISTINCT site, raw_candidate, rejection_code FROM cand WHERE rejection_code IS NOT NULL""")
def _(spark, sf):
    rows = doc_rows(spark, sf).filter("rejection_code is not null")
    return rows.select("site", "raw_candidate", "rejection_code").distinct()


# --- primary selection -----------------------------------------------------------------------
_ROLES = " ".join(
    f"WHEN '{r}' THEN {5000 + len(ref.TOP_CONTACT_ROLES) - i}"
    for i, r in enumerate(ref.TOP_CONTACT_ROLES))
_PRIMARY = {**_SITE, "tiered": f"""
  SELECT *, CASE WHEN domain_affinity <> 'EXTERNAL' THEN 0
    WHEN domain IN ({quoted(ref.FREE_PROVIDERS)}) OR mail_domain IN ({quoted(ref.FREE_PROVIDERS)})
    THEN 2 ELSE 1 END AS tier
  FROM site_findings WHERE category <> 'NO_REPLY'""", "scored": f"""
  SELECT *, CASE WHEN tier = 0 AND domain_affinity = 'EXACT_HOST' THEN 15000 WHEN tier = 0
      THEN 10000 WHEN tier = 1 THEN 2000 ELSE 1000 END
    + coalesce(CASE lower(local_part) {_ROLES} END, CASE WHEN category = 'PERSONAL_OR_NAMED'
      THEN 3000 WHEN lower(local_part) IN ({quoted(ref.RECRUITMENT_ROLES)}) THEN 1000
      WHEN lower(local_part) IN ({quoted(ref.UTILITY_ROLES)}) THEN 500 ELSE 800 END)
    + 200 + greatest(max_page_score, 0) + least(50, evidence_count * 10) AS score
  FROM tiered"""}
PRIMARY = views("document_pages", **_DOC_CTES, **_FINDINGS, **_EVIDENCE, **_PRIMARY)


def scored(spark, sf):
    return contacts(spark, sf).scored


@register("pri1_eligible", PRIMARY + "SELECT site, count(*) AS eligible FROM tiered GROUP BY site")
def _(spark, sf):
    findings, _ = site_tables(spark, sf)
    return primary.eligible(findings).groupBy("site").agg(
        F.count(F.lit(1)).alias("eligible"))


@register("pri2_free_providers", f"""
SELECT o_orderkey, domain, domain IN ({quoted(ref.FREE_PROVIDERS)})
  OR parent IN ({quoted(ref.FREE_PROVIDERS)}) AS free
FROM (SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'eu.yahoo.co.uk'
  WHEN 2 THEN 'shop.com' WHEN 3 THEN 'mail.proton.me' ELSE 'notgmail.com' END AS domain,
  CASE o_custkey % 5 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'yahoo.co.uk' WHEN 2 THEN 'shop.com'
  WHEN 3 THEN 'proton.me' ELSE 'notgmail.com' END AS parent FROM orders)""")
def _(spark, sf):
    from contactgrid.functions.suffixes import registrable_domain

    names = F.array(*map(F.lit, ("gmail.com", "eu.yahoo.co.uk", "shop.com", "mail.proton.me",
                                 "notgmail.com")))
    df = read_table(spark, sf, "orders").select(
        "o_orderkey", F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int")).alias(
            "domain"))
    return df.select("o_orderkey", "domain", emails.is_free_provider(
        F.col("domain"), registrable_domain(F.col("domain"))).alias("free"))


@register("pri3_active_tier", PRIMARY + """
SELECT site, canonical_email, CAST(tier AS INTEGER) AS tier FROM scored
QUALIFY tier = min(tier) OVER (PARTITION BY site)""")
def _(spark, sf):
    return primary.active_tier(scored(spark, sf), "site").select(
        "site", "canonical_email", "tier")


@register("pri4_scores", PRIMARY + """
SELECT site, canonical_email, CAST(score AS INTEGER) AS score, evidence_count FROM scored""")
def _(spark, sf):
    return scored(spark, sf).select("site", "canonical_email", "score", "evidence_count")


@register("pri5_signals", PRIMARY + """
SELECT site, canonical_email, CAST(3 + CASE WHEN max_page_score > 0 THEN 1 ELSE 0 END
  + CASE WHEN evidence_count > 0 THEN 1 ELSE 0 END AS INTEGER) AS signals,
  CAST(score AS INTEGER) AS total FROM scored""")
def _(spark, sf):
    df = scored(spark, sf).withColumn("s", primary.signals())
    return df.select("site", "canonical_email", F.size("s").alias("signals"), F.aggregate(
        "s", F.lit(0), lambda t, x: t + x["contribution"]).alias("total"))


@register("pri6_ordered_evidence", PRIMARY + """
SELECT site, canonical_email, source_url, snippet, CAST(row_number() OVER (
  PARTITION BY site, canonical_email ORDER BY page_score DESC, source_url, snippet) AS INTEGER)
  AS evidence_rank FROM site_evidence QUALIFY evidence_rank <= 3""")
def _(spark, sf):
    return primary.ordered_evidence(doc_evidence(spark, sf), "site", 3).select(
        "site", "canonical_email", "source_url", "snippet", "evidence_rank")


@register("pri7_primary_addresses", PRIMARY + """
SELECT site, canonical_email, CAST(score AS INTEGER) AS score, domain_affinity FROM scored
QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier, score DESC, canonical_email) = 1""")
def _(spark, sf):
    return contacts(spark, sf).primary.select(
        "site", "canonical_email", "score", "domain_affinity")


# --- the same chain from markup: one contact per registrable domain of the stored pages -------
_PAGE_CTES = {**VISIBLE, **_candidates("visible", "page_id", "vtext"), **_FINDINGS, **_EVIDENCE}
PAGE_PRIMARY = views(**_PAGE_CTES, **_PRIMARY)


def page_contacts(spark, sf):
    pages = with_source(read_table(spark, sf, "pages")).select(
        "page_id", "url", "html", F.col("source_registrable_domain").alias("site"))
    return site_contacts(pages, site="site", content="html")


@register("eml12_page_findings", views(**_PAGE_CTES) + """
SELECT page_id, canonical_email, raw_candidate, snippet, domain_affinity, category FROM findings""")
def _(spark, sf):
    return X.page_findings(page_rows(spark, sf)).select(
        "page_id", "canonical_email", "raw_candidate", "snippet", "domain_affinity", "category")


@register("eml13_page_evidence", PAGE_PRIMARY + """
SELECT page_id, canonical_email, source_kind, snippet, raw_candidate, page_score FROM evidence""")
def _(spark, sf):
    return page_contacts(spark, sf).evidence.select(
        "page_id", "canonical_email", "source_kind", "snippet", "raw_candidate", "page_score")


@register("eml19_page_site_findings", PAGE_PRIMARY + """
SELECT site, canonical_email, raw_candidate, snippet, evidence_count, max_page_score
FROM site_findings""")
def _(spark, sf):
    return page_contacts(spark, sf).findings.select(
        "site", "canonical_email", "raw_candidate", "snippet", "evidence_count",
        "max_page_score")


@register("pri4_page_scores", PAGE_PRIMARY + """
SELECT site, canonical_email, CAST(score AS INTEGER) AS score, evidence_count FROM scored""")
def _(spark, sf):
    return page_contacts(spark, sf).scored.select(
        "site", "canonical_email", "score", "evidence_count")


@register("pri7_page_contacts", PAGE_PRIMARY + """
SELECT site, canonical_email, CAST(score AS INTEGER) AS score, domain_affinity FROM scored
QUALIFY row_number() OVER (PARTITION BY site ORDER BY tier, score DESC, canonical_email) = 1""")
def _(spark, sf):
    return page_contacts(spark, sf).primary.select(
        "site", "canonical_email", "score", "domain_affinity")


@register("joi6_lookup_joins", DOC_ALL + """
SELECT category, source_kind, count(*) AS rows FROM (
  SELECT category, 'VISIBLE_TEXT' AS source_kind FROM cand) GROUP BY ALL""")
def _(spark, sf):
    return doc_rows(spark, sf).groupBy("category", "source_kind").agg(
        F.count(F.lit(1)).alias("rows"))


@register("csv1_cells", rf"""
SELECT doc_id, CASE WHEN regexp_matches(t, '^[\s\x{{a0}}]*[=+@-]') THEN '''' || t ELSE t END AS cell
FROM (SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN ' =' WHEN 1 THEN '-' ELSE '' END
  || text, '[\x00-\x1f]', ' ', 'g') AS t FROM documents)""")
def _(spark, sf):
    lead = F.when(F.col("doc_id") % 4 == 0, F.lit(" =")).when(
        F.col("doc_id") % 4 == 1, F.lit("-")).otherwise(F.lit(""))
    return read_table(spark, sf, "documents").select(
        "doc_id", csv_cell(F.concat(lead, "text")).alias("cell"))


@register("aud1_evidence_identity", DOC_ALL + r"""
SELECT page_id, canonical_email, regexp_replace(source_url, '[?#].*$', '') AS identity_url,
  left(sha256(snippet), 16) AS snippet_hash FROM evidence""")
def _(spark, sf):
    return audit.evidence_identity(doc_evidence(spark, sf)).select(
        "page_id", "canonical_email", "identity_url", "snippet_hash")


@register("agg15_digests", """
SELECT o_orderkey, left(sha256(CAST(o_orderkey AS VARCHAR)), 16) AS digest FROM orders""")
def _(spark, sf):
    return read_table(spark, sf, "orders").select(
        "o_orderkey", short_digest(F.col("o_orderkey")).alias("digest"))
