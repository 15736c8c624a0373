"""Consistency of repeated runs and parity of run modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid.functions import urls
from contactgrid.operators.keyed import null_safe_join

SCHEMA_VERSION = "consistency-audit-v1"


def evidence_identity(evidence: DataFrame) -> DataFrame:
    """Identity of an evidence record: e-mail, address without query, kind, text hash."""
    return evidence.withColumns({
        "identity_url": F.coalesce(urls.audit_url(F.col("source_url")), F.lit("")),
        "snippet_hash": F.substring(F.sha2(F.col("snippet"), 256), 1, 16)})


def logical_checksum(fields: Sequence[str]) -> Column:
    """Digest over logical fields in name order; null and missing are the same."""
    return F.sha2(F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(f) for f in sorted(fields)])), 256)


def item_checksums(items: DataFrame, evidence: DataFrame, keys: Sequence[str],
                   fields: Sequence[str]) -> DataFrame:
    """Checksum per item over its logical fields and its sorted evidence identities.

    `evidence` holds the identities of the one selected address of an item, a bounded list.
    """
    identity = F.struct("canonical_email", "identity_url", "source_kind", "snippet_hash")
    sets = evidence_identity(evidence).groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(identity))).alias("evidence_identity"))
    joined = items.join(sets, list(keys), "left").fillna({"evidence_identity": "[]"})
    return joined.withColumn(
        "logical_checksum", logical_checksum([*fields, "evidence_identity"])
    ).drop("evidence_identity")


def compare_repeats(
    repeats: DataFrame, item: str = "item", order: str = "repeat_index",
    fields: Sequence[str] = ("outcome", "failure_code", "selected_email", "logical_checksum"),
) -> DataFrame:
    """Every repeat against the first of its item: which fields differ, null-safe."""
    names = {"outcome": "Outcome", "failure_code": "Failure code", "selected_email": "Email",
             "logical_checksum": "Checksum"}
    first = repeats.groupBy(item).agg(
        F.min_by(F.struct(*fields), order).alias("__first"), F.min(order).alias("__at"))
    df = null_safe_join(repeats, first, [item], "inner").filter(F.col(order) > F.col("__at"))

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    reasons = F.array_compact(F.array(*[
        F.when(~F.col(f).eqNullSafe(F.col("__first")[f]), F.concat(
            F.lit(f"{names.get(f, f)} mismatch: "), shown(F.col("__first")[f]), F.lit(" vs "),
            shown(F.col(f)))) for f in fields]))
    return df.withColumn("reasons", reasons).drop("__first", "__at")


def item_consistency(repeats: DataFrame, compared: DataFrame, item: str = "item") -> DataFrame:
    """One row per item: number of repeats, number of mismatches, verdict."""
    mismatches = compared.groupBy(item).agg(F.sum(F.size("reasons")).alias("mismatches"))
    counts = repeats.groupBy(item).agg(F.count(F.lit(1)).alias("repeats"))
    df = counts.join(mismatches, item, "left").fillna(0, ["mismatches"])
    return df.withColumn("is_consistent", F.col("mismatches") == 0)


def consistency_report(items: DataFrame) -> DataFrame:
    """Totals and the share of consistent items; 100 when there are none."""
    stats = items.agg(
        F.count(F.lit(1)).alias("items"), F.count_if("is_consistent").alias("consistent"))
    return stats.withColumns({
        "mismatched": F.col("items") - F.col("consistent"),
        "consistency_percentage": F.when(F.col("items") > 0, F.round(
            F.col("consistent") / F.col("items") * 100.0, 2)).otherwise(F.lit(100.0))})


def distributions(repeats: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Count per value for each field, nulls left out, in one grouped pass."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
                       for f in fields])
    long = repeats.select(F.inline(listed)).filter(F.col("value").isNotNull())
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def mode_parity(runs: DataFrame, mode: str, keys: Sequence[str], fields: Sequence[str]
                ) -> DataFrame:
    """Per item: number of modes and whether all of them gave the same logical fields."""
    marked = runs.withColumn("__sum", logical_checksum(fields))
    return marked.groupBy(*keys).agg(
        F.count_distinct(mode).alias("modes"),
        (F.count_distinct("__sum") == 1).alias("parity"))
