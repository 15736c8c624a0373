"""Fair work picks, politeness schedules and burst checks.

Times are integer microseconds, so schedules are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid.operators.keyed import null_safe_join, top_per_key

HOUR = 3_600_000_000


def fair_jobs(jobs: DataFrame, per_tenant: int = 2, overall: int = 10) -> DataFrame:
    """Jobs to serve next: least recently served first, a few per tenant."""
    open_jobs = jobs.filter(
        F.col("status").isin("QUEUED", "RUNNING")
        & (F.col("completed_count") + F.col("failed_count") < F.col("valid_input_count")))
    order = [F.col("last_claimed_at").asc_nulls_first(), F.col("created_at"), F.col("job_id")]
    ranked = top_per_key(open_jobs, ["org_id"], order, per_tenant, "tenant_rank")
    return ranked.orderBy(*order).limit(overall)


def fair_urls(
    urls: DataFrame, picked: DataFrame, now: Column, prefer_retry: bool = False,
    per_job: int = 5, overall: int = 50,
) -> DataFrame:
    """URLs to serve next from the picked jobs, interleaved by rank within the job.

    Queued and due-retry URLs are two classes; the second class is used only when the preferred
    one is empty. `picked` is the output of `fair_jobs` (at most `overall` jobs), so it is small.
    """
    queued = F.col("status") == "QUEUED"
    due = (F.col("status") == "RETRY_WAIT") & (F.col("next_retry_at") <= now)
    first, second = (due, queued) if prefer_retry else (queued, due)
    heads = picked.select("job_id", "last_claimed_at")
    waiting = urls.filter((queued | due) & (F.col("attempt_count") < F.col("max_attempts")))
    candidates = waiting.withColumn(
        "class_rank", F.when(first, F.lit(0)).when(second, F.lit(1))
    ).join(heads, "job_id")
    ranked = top_per_key(
        candidates, ["class_rank", "job_id"], [F.col("created_at"), F.col("url_id")], per_job,
        "job_rank")
    order = [F.col("last_claimed_at").asc_nulls_first(), F.col("job_rank"),
             F.col("created_at"), F.col("url_id")]
    # at most `overall` rows remain when the class is decided
    best = ranked.orderBy("class_rank", *order).limit(overall)
    chosen = F.min("class_rank").over(W.partitionBy(F.lit(0)))
    return best.withColumn("__class", chosen).filter(
        F.col("class_rank") == F.col("__class")).drop("__class").withColumn(
        "position", F.row_number().over(W.partitionBy("class_rank").orderBy(*order)))


def _split(df: DataFrame, key: str, time: str, slice_size: int) -> DataFrame:
    return df.withColumn("__slice", F.floor(F.col(time) / slice_size))


def effective_intervals(
    requests: DataFrame, key: str = "domain", time: str = "arrival", tie: str = "seq",
    default: int = 1_000_000, learned: str = "learned", slice_size: int = HOUR,
) -> DataFrame:
    """Interval in force at every request: the largest delay learned so far, never smaller.

    The running maximum is taken inside time slices; slice maxima carry over.
    """
    df = _split(requests, key, time, slice_size)
    inside = W.partitionBy(key, "__slice").orderBy(time, tie)
    floor_value = F.greatest(F.coalesce(F.col(learned), F.lit(default)), F.lit(default))
    local = df.withColumn("__local", F.max(floor_value).over(inside))
    tops = df.groupBy(key, "__slice").agg(F.max(floor_value).alias("__top"))
    before = W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(key, "__slice", F.max("__top").over(before).alias("__before"))
    joined = null_safe_join(local, carried, [key, "__slice"], "inner")
    return joined.withColumn(
        "effective_interval", F.greatest("__local", F.coalesce("__before", F.lit(default)))
    ).drop("__slice", "__local", "__before")


def politeness_schedule(
    requests: DataFrame, key: str = "domain", time: str = "arrival", tie: str = "seq",
    interval: str = "interval", slice_size: int = HOUR,
) -> DataFrame:
    """Start time of every request: its arrival, or the previous start plus its interval.

    Closed form: with S the sum of all earlier intervals of the domain, the start is
    S + max(arrival - S) over the requests so far. Sums and maxima are taken inside time slices
    and carried over slice by slice, so a busy domain is spread over many tasks.
    """
    df = _split(requests, key, time, slice_size)
    inside = W.partitionBy(key, "__slice").orderBy(time, tie)
    local_sum = F.coalesce(F.sum(interval).over(
        inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = df.withColumn("__sum", local_sum)
    local = local.withColumn("__slack", F.max(F.col(time) - F.col("__sum")).over(inside))
    slices = local.groupBy(key, "__slice").agg(
        F.max(F.col("__sum") + F.col(interval)).alias("__total"),
        F.max("__slack").alias("__top"))
    before = W.partitionBy(key).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offset = slices.withColumn(
        "__offset", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    carried = offset.select(
        key, "__slice", "__offset",
        F.max(F.col("__top") - F.col("__offset")).over(before).alias("__before"))
    joined = null_safe_join(local, carried, [key, "__slice"], "inner")
    slack = F.greatest(F.col("__slack") - F.col("__offset"), F.col("__before"))
    return joined.withColumn(
        "scheduled", F.col("__offset") + F.col("__sum") + slack
    ).drop("__slice", "__sum", "__slack", "__offset", "__before")


def burst_audit(
    attempts: DataFrame, key: str, time: str, limit: int = 10, window: int = 60_000_000,
    slice_size: int = HOUR,
) -> DataFrame:
    """Attempts of the same key in the trailing window, for every attempt.

    A window shorter than a slice touches two slices at most: rows near the end of a slice are
    also sent to the next one, and each (key, slice) is counted on its own.
    """
    df = _split(attempts, key, time, slice_size)
    late = F.col(time) >= (F.col("__slice") + 1) * slice_size - window
    homes = F.when(late, F.array(F.col("__slice"), F.col("__slice") + 1)).otherwise(
        F.array(F.col("__slice")))
    spread = df.withColumn("__home", F.explode(homes))
    span = W.partitionBy(key, "__home").orderBy(time).rangeBetween(-(window - 1), 0)
    counted = spread.withColumn("attempts_in_window", F.count(F.lit(1)).over(span))
    return counted.filter(F.col("__home") == F.col("__slice")).withColumn(
        "over_limit", F.col("attempts_in_window") > limit).drop("__slice", "__home")
