"""Tenant analytics: totals, rates, zero-filled distributions, daily timeline, recent scans.

Every report is grouped by tenant, so one job serves all tenants; filter the result (or the jobs)
for a single one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.operators.keyed import top_per_key
from contactgrid.operators.paging import in_period, period_bounds


def job_totals(jobs: DataFrame) -> DataFrame:
    """Counts and null-safe sums per tenant with the success rate."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    sums = jobs.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_scans"),
        total("valid_input_count").alias("websites_submitted"),
        total("completed_count").alias("websites_completed"),
        total("failed_count").alias("websites_failed"),
        total("email_finding_count").alias("emails_discovered"))
    processed = F.col("websites_completed") + F.col("websites_failed")
    rate = F.when(processed > 0, F.round(
        F.col("websites_completed") / processed * 100.0, 2)).otherwise(F.lit(0.0))
    return sums.withColumns({
        "websites_processed": processed, "successful_processing_rate": rate})


def active_jobs(jobs: DataFrame) -> DataFrame:
    active = F.col("status").isin(*ref.ACTIVE_ANALYTICS_STATUSES)
    return jobs.groupBy("org_id").agg(F.count_if(active).alias("active_scans"))


def zero_filled(
    df: DataFrame, tenants: DataFrame, column: str, known: Sequence[str]
) -> DataFrame:
    """Count per tenant and known value; missing values count 0, unknown values are dropped."""
    counts = df.filter(F.col(column).isin(*known)).groupBy("org_id", column).agg(
        F.count(F.lit(1)).alias("__n"))
    frame = tenants.select("org_id").distinct().select(
        "org_id", F.explode(F.array(*map(F.lit, known))).alias(column))
    return frame.join(counts, ["org_id", column], "left").select(
        "org_id", column, F.coalesce("__n", F.lit(0)).alias("count"))


def findings_by(findings: DataFrame, jobs: DataFrame, column: str, known: Sequence[str]
                ) -> DataFrame:
    """Zero-filled finding counts of the given jobs by one finding column."""
    owned = findings.select("job_id", column).join(jobs.select("job_id", "org_id"), "job_id")
    return zero_filled(owned, jobs, column, known)


def shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value in whole percent, halves rounded up."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    # the window runs over one row per value, not over the table
    total = F.sum("count").over(W.partitionBy(F.lit(0)))
    percent = F.floor(F.col("count") / F.col("total") * 100 + 0.5).cast("bigint")
    return counts.withColumn("total", total).select(column, "count", percent.alias("percent"))


def timeline(
    jobs: DataFrame, findings: DataFrame, now: Column, period: str = "all",
    max_days: int | None = None,
) -> DataFrame:
    """Daily jobs created and addresses found per tenant on a dense calendar.

    Addresses are bucketed by their own first date but selected by the job's creation date. The
    calendar of "all" starts at the tenant's first job and ends with `now`; `max_days` lists only the
    first days.
    """
    selected = in_period(jobs, "created_at", now, period)
    day = F.date_format("created_at", "yyyy-MM-dd")
    created = selected.groupBy("org_id", day.alias("date")).agg(
        F.count(F.lit(1)).alias("scans_created"))
    found = findings.select("job_id", "first_found_at").join(
        selected.select("job_id", "org_id"), "job_id").groupBy(
        "org_id", F.date_format("first_found_at", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("emails_found"))
    start, end = period_bounds(now, period)
    first = jobs.groupBy("org_id").agg(F.to_date(F.min("created_at")).alias("__first"))
    if start is not None:
        first = first.withColumn("__first", F.to_date(start))
    last = F.to_date(end)
    if max_days is not None:
        last = F.least(last, F.date_add("__first", max_days - 1))
    days = first.filter(F.col("__first") <= F.to_date(end)).select(
        "org_id", F.explode(F.sequence("__first", last)).alias("day"))
    calendar = days.select("org_id", F.date_format("day", "yyyy-MM-dd").alias("date"))
    return calendar.join(created, ["org_id", "date"], "left").join(
        found, ["org_id", "date"], "left").fillna(0, ["scans_created", "emails_found"])


def recent_completed(jobs: DataFrame, k: int = 5) -> DataFrame:
    """The latest finished jobs per tenant."""
    done = jobs.filter(F.col("status").isin("COMPLETED", "COMPLETED_WITH_ERRORS"))
    return top_per_key(
        done, ["org_id"], [F.col("completed_at").desc_nulls_last(), F.col("job_id").desc()], k,
        "position")
