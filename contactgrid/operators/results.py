"""Result mapping, idempotent writes and checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.config import ResultCaps
from contactgrid.functions import emails, urls
from contactgrid.functions.text import csv_cell, first_chars, first_items, sanitize_text
from contactgrid.operators.jobs import error_classification
from contactgrid.operators.keyed import (
    null_safe_join,
    one_per_key,
    sequence_within,
    winner_per_key,
)
from contactgrid.operators.quality import ordered_checksum


# --- flattening a nested site result ---------------------------------------------------------
def map_pages(results: DataFrame, caps: ResultCaps = ResultCaps()) -> DataFrame:
    """Page rows of nested results (result_id, page_records array); caps, if any, apply in array order."""
    records = results.select(
        "result_id", F.posexplode(first_items(
            F.col("page_records"), caps.max_pages)).alias("seq", "p"))
    requested = urls.storage_url(F.col("p.requested_url"))
    return records.select(
        "result_id", "seq", requested.alias("normalized_url"),
        F.when(F.col("p.final_url").isNotNull(), urls.storage_url(F.col("p.final_url"))
               ).otherwise(requested).alias("final_url"),
        "p.depth", "p.outcome", "p.fetch_outcome", "p.status_code",
        sanitize_text(F.col("p.content_type"), caps.max_content_type_length).alias("content_type"),
        F.coalesce("p.page_score", F.lit(0)).alias("page_score"),
        F.lit(ref.RANKING_VERSION).alias("ranking_version"),
        "p.robots_decision", "p.links_discovered_count", "p.emails_found_count")


def map_findings(results: DataFrame, caps: ResultCaps = ResultCaps()) -> DataFrame:
    rows = results.select("result_id", F.posexplode(
        first_items(F.col("email_findings"), caps.max_findings)).alias("seq", "f"))
    mapped = rows.select(
        "result_id", "seq", F.lower(F.trim("f.canonical_email")).alias("canonical_email"),
        F.lower(F.trim("f.domain")).alias("email_domain"),
        F.col("f.category").alias("classification"),
        (F.col("f.category") == "ROLE_BASED").alias("is_role_based"),
        F.lit("UNVERIFIED").alias("validation_status"))
    return winner_per_key(mapped, ["result_id", "canonical_email"], [F.col("seq")]).drop("seq")


def map_evidence(results: DataFrame, caps: ResultCaps = ResultCaps()) -> DataFrame:
    found = results.select("result_id", F.explode(
        first_items(F.col("email_findings"), caps.max_findings)).alias("f"))
    own = F.array(F.struct(
        F.col("f.source_url").alias("source_url"), F.col("f.source_kind").alias("source_kind"),
        F.col("f.raw_candidate").alias("raw_candidate"), F.col("f.snippet").alias("snippet")))
    records = F.when(F.size("f.evidence") > 0, F.transform("f.evidence", lambda e: F.struct(
        *[e[n].alias(n) for n in ("source_url", "source_kind", "raw_candidate", "snippet")]))
    ).otherwise(own)
    rows = found.select(
        "result_id", F.lower(F.trim("f.canonical_email")).alias("canonical_email"),
        F.explode(records).alias("e"))
    whole = sanitize_text(F.col("e.snippet"))
    snippet = first_chars(whole, caps.max_snippet_length)
    return rows.select(
        "result_id", "canonical_email", urls.storage_url(F.col("e.source_url")).alias("page_url"),
        F.col("e.source_kind").alias("source_type"),
        sanitize_text(F.col("e.raw_candidate"), caps.max_candidate_length).alias("raw_candidate"),
        snippet.alias("snippet"), F.lit(1.0).alias("confidence"),
        emails.candidate_hash(F.col("canonical_email"), whole).alias("candidate_hash"))


def map_rejected(results: DataFrame, caps: ResultCaps = ResultCaps()) -> DataFrame:
    rows = results.select("result_id", F.posexplode(
        first_items(F.col("rejected_candidates"), caps.max_rejected)).alias("seq", "r"))
    mapped = rows.select(
        "result_id", "seq", emails.candidate_hash(F.col("r.raw_candidate")).alias(
            "candidate_hash"),
        F.col("r.rejection_code").alias("rejection_code"),
        emails.mask_candidate(F.col("r.raw_candidate")).alias("masked_candidate"),
        F.col("r.source_kind").alias("source_type"),
        F.when(F.col("r.source_url") != "", urls.storage_url(F.col("r.source_url"))).alias(
            "normalized_page_url"))
    return winner_per_key(
        mapped, ["result_id", "candidate_hash", "rejection_code"], [F.col("seq")]).drop("seq")


def map_attempts(results: DataFrame, caps: ResultCaps = ResultCaps()) -> DataFrame:
    """Attempt row per result: sanitized addresses, retryability, histories."""
    pages = results.select(
        "result_id", "outcome", F.posexplode_outer("page_records").alias("page_seq", "p")
    ).select("result_id", "page_seq", F.col("outcome").alias("site"),
             F.col("p.outcome").alias("page_outcome"), "p.fetch_outcome", "p.status_code")
    rated = error_classification(pages, ["result_id"], "page_seq", "site")
    first = F.try_element_at(F.col("page_records"), F.lit(1))
    failed = F.col("outcome").isin("FAILED", "PARTIAL")
    requested = urls.storage_url(F.col("starting_url"))
    redirects = F.transform(
        first_items(first["redirect_history"], caps.max_redirect_hops), lambda h: F.struct(
            urls.storage_url(h["url"]).alias("url"), h["status_code"].alias("status_code"),
            urls.storage_url(h["location"]).alias("location")))
    return results.join(rated, "result_id").select(
        "result_id", "attempt_number", "outcome",
        (failed & F.col("retryable")).alias("retryable"), requested.alias("requested_url"),
        F.when(first["final_url"].isNotNull(), urls.storage_url(first["final_url"])
               ).otherwise(requested).alias("final_url"),
        first["status_code"].alias("status_code"),
        F.when(F.size(redirects) > 0, F.to_json(redirects)).alias("redirect_history"))


def result_checksum(
    results: DataFrame, caps: ResultCaps = ResultCaps()
) -> DataFrame:
    """Checksum per result over its mapped parts, each in the order of its lines' hashes.

    A part enters as the tree digest of its lines, so a result with any number of findings is never
    held by one task. Lines start alike (depth, scheme, host); their hashes do not, so that ranges
    of hashes are even buckets.
    """
    def part(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
        line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit(r"\N"))
                                     for c in columns])
        numbered = sequence_within(
            rows.select("result_id", line.alias("line"), F.md5(line).alias("hash")),
            ["result_id"], [F.col("hash"), F.col("line")], F.substring("hash", 1, 3), "number")
        return ordered_checksum(numbered, ["result_id"], "number", F.col("line")
                                ).withColumnRenamed("checksum", name)

    parts = [
        part(map_pages(results, caps),
             ["depth", "normalized_url", "seq", "final_url", "outcome", "status_code",
              "content_type", "page_score", "robots_decision", "links_discovered_count",
              "emails_found_count"], "pages"),
        part(map_findings(results, caps),
             ["canonical_email", "classification", "is_role_based"], "findings"),
        part(map_evidence(results, caps),
             ["canonical_email", "source_type", "candidate_hash", "page_url", "confidence"],
             "evidence"),
        part(map_rejected(results, caps),
             ["candidate_hash", "rejection_code", "source_type"], "rejected"),
    ]
    df = results.select(
        "result_id", "attempt_number", "outcome",
        urls.storage_url(F.col("starting_url")).alias("starting_url"))
    for one in parts:
        df = df.join(one, "result_id", "left")
    names = ["pages", "findings", "evidence", "rejected"]
    body = F.to_json(F.struct(
        F.lit("v1").alias("schema_version"),
        F.lit(ref.SELECTION_VERSION).alias("selection_version"), "starting_url",
        "attempt_number", "outcome", *[F.coalesce(n, F.lit("")).alias(n) for n in names]))
    return df.select("result_id", F.sha2(body, 256).alias("result_checksum"))


def transient_checksum(attempts: DataFrame) -> DataFrame:
    """Checksum of an attempt that failed before it had results."""
    body = F.to_json(F.struct(
        F.lit("v1").alias("schema_version"), F.col("scan_url_id").cast("string").alias(
            "scan_url_id"), "attempt_number", "outcome", "error_code", "retryable",
        urls.storage_url(F.col("requested_url")).alias("requested_url")))
    return attempts.withColumn("result_checksum", F.sha2(body, 256))


def replay_status(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NEW, REPLAY or CONFLICT per incoming attempt; `stored` has one row per key."""
    known = stored.select(*keys, F.col("result_checksum").alias("__stored"))
    status = _replay(F.col("__stored").isNull(), F.col("__stored") == F.col("result_checksum"))
    return incoming.join(known, list(keys), "left").withColumn("replay_status", status).drop(
        "__stored")


def later_replays(
    attempts: DataFrame, keys: Sequence[str], order: str, content: str, stored: Column
) -> DataFrame:
    """`replay_status` of every attempt of a key after its first one by `order`, which is unique.

    The first one counts as stored where `stored`, a condition on the keys, holds; checksums are
    those of `content`. Attempts are shuffled once, and checksums not at all.
    """
    first = attempts.groupBy(*keys).agg(
        F.min(order).alias("__first"), F.min_by(content, order).alias("__content"))
    later = null_safe_join(attempts, first, keys, "inner").filter(
        F.col(order) != F.col("__first"))
    same = F.sha2("__content", 256) == F.sha2(content, 256)
    return later.withColumn("replay_status", _replay(~stored, same)).drop(
        "__first", "__content")


def _replay(new: Column, same: Column) -> Column:
    return F.when(new, F.lit("NEW")).when(same, F.lit("REPLAY")).otherwise(F.lit("CONFLICT"))


# --- idempotent writes -----------------------------------------------------------------------
def upsert_findings(
    state: DataFrame, delta: DataFrame, keys: Sequence[str], now: Column
) -> DataFrame:
    """New snapshot of findings with `change`: NEW, REFRESHED or KEPT.

    Keys already stored keep everything but `last_found_at`, also their first address when the
    key is the URL alone. The first row of a key in the
    delta wins (by `delta_order` when the delta has that column, else the smallest).
    """
    fresh = one_per_key(delta, keys) if "delta_order" not in delta.columns else (
        winner_per_key(delta, list(keys), [F.col("delta_order")]).drop("delta_order"))
    fields = [c for c in state.columns
              if c not in (*keys, "first_found_at", "last_found_at")]
    incoming = fresh.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in fields],
                            F.lit(True).alias("__seen"))
    stored = state.withColumn("__stored", F.lit(True))
    merged = stored.join(incoming, list(keys), "full_outer")
    old, seen = F.col("__stored").isNotNull(), F.col("__seen").isNotNull()
    return merged.select(
        *keys,
        *[F.when(old, F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c) for c in fields],
        F.when(old, F.col("first_found_at")).otherwise(now).alias("first_found_at"),
        F.when(seen, now).otherwise(F.col("last_found_at")).alias("last_found_at"),
        F.when(~old, F.lit("NEW")).when(seen, F.lit("REFRESHED")).otherwise(
            F.lit("KEPT")).alias("change"))


def new_and_existing(delta: DataFrame, state: DataFrame, keys: Sequence[str]
                     ) -> tuple[DataFrame, DataFrame]:
    """Delta rows whose key is unknown, and those whose key is stored."""
    known = state.select(*keys)
    return (delta.join(known, list(keys), "left_anti"),
            delta.join(known, list(keys), "left_semi"))


def append_evidence(
    incoming: DataFrame, findings: DataFrame, pages: DataFrame, stored: DataFrame
) -> DataFrame:
    """Evidence rows to append: known finding and page, one per identity, not stored yet."""
    resolved = incoming.join(
        findings.select("canonical_email", "finding_id"), "canonical_email").join(
        pages.select(F.col("normalized_url").alias("page_url"), F.col("page_id")), "page_url")
    identity = ["finding_id", "page_id", "source_type", "candidate_hash"]
    return one_per_key(resolved, identity).join(stored.select(*identity), identity, "left_anti")


def append_rejected(incoming: DataFrame, pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Rejected rows to append, one per (job, hash, code); the page is optional."""
    identity = ["job_id", "candidate_hash", "rejection_code"]
    located = incoming.join(
        pages.select(F.col("normalized_url").alias("normalized_page_url"), "page_id"),
        "normalized_page_url", "left")
    return one_per_key(located, identity).join(stored.select(*identity), identity, "left_anti")


def append_events(
    stored: DataFrame, fresh: DataFrame, job: str, order: Sequence[Column], bucket: Column
) -> DataFrame:
    """New events with the next sequence numbers of their job."""
    last = stored.groupBy(job).agg(F.max("sequence_number").alias("__last"))
    numbered = sequence_within(fresh, [job], order, bucket, "__n")
    return null_safe_join(numbered, last, [job], "left").withColumn(
        "sequence_number", F.coalesce("__last", F.lit(0)) + F.col("__n")).drop("__last", "__n")


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages once per (attempt, address) with a stable key column."""
    return one_per_key(pages, ["attempt_id", "normalized_url"]).withColumn(
        "page_key", F.xxhash64("attempt_id", "normalized_url"))


# --- export ----------------------------------------------------------------------------------
def export_guard(jobs: DataFrame, findings: DataFrame, limit: int | None = None
                 ) -> DataFrame:
    """Per job: may its findings be exported, and if not, why. A limit is the caller's."""
    counts = findings.groupBy("job_id").agg(F.count(F.lit(1)).alias("rows"))
    df = jobs.select("job_id", "status").join(counts, "job_id", "left").fillna(0, ["rows"])
    refusal = F.when(
        ~F.col("status").isin(*ref.TERMINAL_JOB_STATUSES), F.lit("INVALID_STATE_TRANSITION"))
    if limit is not None:
        refusal = refusal.when(F.col("rows") > limit, F.lit("EXPORT_TOO_LARGE"))
    return df.withColumn("refusal", refusal)


def export_rows(findings: DataFrame) -> DataFrame:
    """The ten export columns as guarded text cells, with the sort key kept for the writer."""
    def stamp(name: str) -> Column:
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")

    cells = {
        "scan_url_id": F.col("scan_url_id"), "target_url": F.col("target_url"),
        "canonical_email": F.col("canonical_email"), "email_domain": F.col("email_domain"),
        "classification": F.col("classification"),
        "is_role_based": F.initcap(F.col("is_role_based").cast("string")),
        "validation_status": F.col("validation_status"),
        "evidence_count": F.col("evidence_count"),
        "first_found_at": stamp("first_found_at"), "last_found_at": stamp("last_found_at"),
    }
    return findings.select(
        "job_id", F.col("canonical_email").alias("sort_email"),
        F.col("finding_id").alias("sort_id"),
        *[csv_cell(cells[name]).alias(name) for name in ref.EXPORT_COLUMNS])
