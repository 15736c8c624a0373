"""Percentiles, run metrics, baselines, duplicates, invariants, constraints, checksums."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.operators.keyed import (
    CROWD,
    null_safe_join,
    sequence_within,
    split_crowded,
    spread,
)


#: Parts into which a range of values is cut when a rank is looked for.
PARTS = 1024


def values_at_ranks(
    df: DataFrame, value: str, by: Sequence[str], ranks: Callable[[Column], Column],
    rounds: int = 2, crowd: int = CROWD,
) -> DataFrame:
    """Values at given positions (from zero) of the sorted values of each group.

    `ranks` maps the group size to an array of (name, rank). Groups of up to `crowd` values are
    sorted in one task each. For the others, each round cuts the range of values that holds a rank
    into `PARTS` equal parts, counts them, and goes on with the part that holds the rank, narrowed
    to its own least and greatest value: first the group's whole range, then that part. Only the
    values of the last part are ordered. Widths follow from the data, so values in microseconds and
    in seconds are cut alike.
    """
    df = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("__value"))
    plain, crowded = split_crowded(df, by, crowd)
    group = W.partitionBy(*by)
    placed = spread(plain, by, df.count()).select(
        *by, "__value", F.count(F.lit(1)).over(group).alias("n"),
        (F.row_number().over(group.orderBy("__value")) - 1).alias("__place"))
    found = placed.select(*by, "__value", "n", "__place", F.inline(ranks(F.col("n")))).filter(
        F.col("rank") == F.col("__place"))
    return found.select(*by, "n", "name", "rank", F.col("__value").alias(value)).unionByName(
        _values_by_parts(crowded, value, by, ranks, rounds))


def _values_by_parts(
    df: DataFrame, value: str, by: Sequence[str], ranks: Callable[[Column], Column], rounds: int
) -> DataFrame:
    """`values_at_ranks` of few large groups: what is sought is sent to the values."""
    keys = [*by, "__low", "__high"]
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__value").alias("__low"),
                                F.max("__value").alias("__high"))
    wanted = stats.select(*keys, "n", F.lit(0).cast("long").alias("__before"),
                          F.inline(ranks(F.col("n"))))

    def inside(wanted: DataFrame) -> DataFrame:
        ranges = F.broadcast(wanted.select(*keys).distinct())
        return null_safe_join(df, ranges, by, "inner").filter(
            F.col("__value").between(F.col("__low"), F.col("__high")))

    for _ in range(rounds):
        low, high = F.col("__low").cast("double"), F.col("__high").cast("double")
        share = (F.col("__value").cast("double") - low) / F.nullif(high - low, F.lit(0.0))
        part = F.least(F.coalesce(F.floor(share * PARTS), F.lit(0)), F.lit(PARTS - 1))
        counts = inside(wanted).groupBy(*keys, part.alias("__part")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__value").alias("__from"),
            F.max("__value").alias("__to"))
        earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("__less", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        offset = F.col("rank") - F.col("__before")
        wanted = null_safe_join(wanted, placed, keys, "inner").filter(
            (F.col("__less") <= offset) & (offset < F.col("__less") + F.col("__n"))).select(
            *by, F.col("__from").alias("__low"), F.col("__to").alias("__high"), "n",
            (F.col("__before") + F.col("__less")).alias("__before"), "name", "rank")
    last = inside(wanted).groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy("__value"))
    offset = F.col("rank") - F.col("__before")
    return null_safe_join(wanted, last.withColumn("__upto", upto), keys, "inner").filter(
        (F.col("__upto") - F.col("__c") <= offset) & (offset < F.col("__upto"))
    ).select(*by, "n", "name", "rank", F.col("__value").alias(value))


PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_percentiles(
    df: DataFrame, value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Exact p50, p95 and p99 with linear interpolation; 0 for an empty input."""
    keys = list(by) or ["__all"]
    df = df if by else df.withColumn("__all", F.lit(0))

    def ranks(n: Column) -> Column:
        entries = []
        for name, level in PERCENTILES.items():
            low = F.floor((n - 1) * level)
            for side, rank in (("low", low), ("high", F.least(low + 1, n - 1))):
                entries.append(F.struct(
                    F.lit(f"{name}_{side}").alias("name"), rank.alias("rank")))
        return F.array(*entries)

    found = values_at_ranks(df.select(*keys, value), value, keys, ranks)

    def at(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col(value)))

    def interpolated(name: str, level: float) -> Column:
        position = (F.max("n") - 1) * level
        low = F.floor(position)
        mixed = at(f"{name}_low") * (low + 1 - position) + at(f"{name}_high") * (position - low)
        return F.coalesce(F.when(position == low, at(f"{name}_low")).otherwise(mixed),
                          F.lit(0.0)).cast("double").alias(name)

    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(*[interpolated(name, level) for name, level in PERCENTILES.items()])


def upper_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Element n // 2 (from zero) of the sorted values of each group."""
    found = values_at_ranks(
        df.select(*by, value), value, by,
        lambda n: F.array(F.struct(F.lit("median").alias("name"), F.floor(n / 2).alias("rank"))))
    return found.select(*by, F.col(value).alias("median"), "n")


def run_metrics(urls: DataFrame, by: Sequence[str], seconds: str) -> DataFrame:
    """Success, failure and retry counts with rates per group."""
    status = F.col("status")
    stats = urls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(status.isin("COMPLETED", "NO_EMAIL")).alias("success_count"),
        F.count_if(status == "FAILED").alias("failure_count"),
        F.coalesce(F.sum("retry_count"), F.lit(0)).cast("bigint").alias("retry_total"),
        F.sum(seconds).alias("elapsed_seconds"))
    return stats.withColumn("urls_per_second", F.when(
        F.col("elapsed_seconds") > 0, F.col("size") / F.col("elapsed_seconds")).otherwise(
        F.lit(0.0)))


def compare_baseline(
    current: DataFrame, baseline: DataFrame, key: str, metrics: Sequence[str]
) -> DataFrame:
    """Difference and percent change per (scenario, metric) against a positive baseline."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            [key], list(metrics), "metric", name)

    both = long(current, "current").join(long(baseline, "baseline"), [key, "metric"])
    usable = both.filter((F.col("baseline") > 0) & F.col("current").isNotNull())
    diff = F.col("current") - F.col("baseline")
    return usable.withColumns({
        "diff": diff, "pct_change": F.round(diff / F.col("baseline") * 100.0, 2)})


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter(F.col("copies") > 1)


def phase_summary(df: DataFrame, phases: Mapping[str, Column], by: Sequence[str] = ()
                  ) -> DataFrame:
    """Mean, maximum and exact p95 per phase, long form."""
    listed = F.array(*[
        F.struct(F.lit(name).alias("phase"), value.cast("double").alias("seconds"))
        for name, value in phases.items()])
    long = df.select(*by, F.inline(listed)).filter(F.col("seconds").isNotNull())
    keys = [*by, "phase"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"))
    p95 = latency_percentiles(long, "seconds", keys).select(
        *keys, F.col("p95").alias("p95_seconds"))
    return stats.join(p95, keys)


def constraint_rules() -> dict[str, Column]:
    """Row rules of the job table; a rule that is null for a row holds for it."""
    c = F.col
    counts = ("total_input_count", "valid_input_count", "duplicate_input_count", "queued_count",
              "running_count", "completed_count", "failed_count", "email_finding_count")
    rules = {"status_allowed": c("status").isin(*ref.JOB_STATUSES)}
    rules |= {f"{name}_nonnegative": c(name) >= 0 for name in counts}
    rules |= {
        "valid_le_total": c("valid_input_count") <= c("total_input_count"),
        "duplicate_le_total": c("duplicate_input_count") <= c("total_input_count"),
        "valid_dup_le_total": c("valid_input_count") + c("duplicate_input_count")
        <= c("total_input_count"),
        "processed_le_valid": c("queued_count") + c("running_count") + c("completed_count")
        + c("failed_count") <= c("valid_input_count"),
    }
    return rules


def url_constraint_rules() -> dict[str, Column]:
    c = F.col
    return {
        "status_allowed": c("status").isin(*ref.URL_STATUSES),
        "index_nonnegative": c("original_index") >= 0,
        "attempts_nonnegative": c("attempt_count") >= 0,
        "attempts_le_max": c("attempt_count") <= c("max_attempts"),
        "duration_nonnegative": c("total_duration_seconds") >= 0,
        "retry_count_nonnegative": c("retry_count") >= 0,
    }


def constraint_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule: all rules are counted in one pass over the table."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def uniqueness_audit(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Groups that break each uniqueness rule."""
    found = None
    for name, columns in keys.items():
        one = duplicate_groups(df, columns).agg(
            F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
        found = one if found is None else found.unionByName(one)
    return found


def load_invariants(
    jobs: DataFrame, urls: DataFrame, attempts: DataFrame, findings: DataFrame
) -> DataFrame:
    """Data checks of a finished load, one row per job with the list of violations.

    Expected: every URL succeeded with one attempt numbered 1 and one finding, nothing is open or
    leased, no duplicates, and the job's counters agree.
    """
    def totals(df: DataFrame, **values: Column) -> DataFrame:
        return df.groupBy("job_id").agg(*[v.alias(n) for n, v in values.items()])

    status = F.col("status")
    parts = [
        totals(urls,
               url_rows=F.count(F.lit(1)),
               success=F.count_if(status.isin("COMPLETED", "NO_EMAIL")),
               failure=F.count_if(status == "FAILED"),
               open_rows=F.count_if(~status.isin(*ref.TERMINAL_URL_STATUSES)),
               uncleared=F.count_if(F.col("lease_expires_at").isNotNull())),
        totals(attempts, attempt_rows=F.count(F.lit(1)),
               other_numbers=F.count_if(F.col("attempt_number") != 1)),
        totals(findings, finding_rows=F.count(F.lit(1))),
        totals(duplicate_groups(attempts, ["job_id", "url_id", "attempt_number"]),
               duplicate_attempts=F.count(F.lit(1))),
        totals(duplicate_groups(findings, ["job_id", "canonical_email"]),
               duplicate_findings=F.count(F.lit(1))),
    ]
    df = jobs
    added: list[str] = []
    for part in parts:
        added += [c for c in part.columns if c != "job_id"]
        df = df.join(part, "job_id", "left")
    df = df.fillna(0, added)
    size = F.col("valid_input_count")
    checks = {
        "success_total": F.col("success") == size,
        "failure_total": F.col("failure") == 0,
        "attempt_rows": F.col("attempt_rows") == size,
        "finding_rows": F.col("finding_rows") == size,
        "duplicate_attempts": F.col("duplicate_attempts") == 0,
        "duplicate_findings": F.col("duplicate_findings") == 0,
        "sequential_attempts": F.col("other_numbers") == 0,
        "nonterminal_rows": F.col("open_rows") == 0,
        "uncleared_claims": F.col("uncleared") == 0,
        "job_counters": (F.col("queued_count") == 0) & (F.col("running_count") == 0)
        & (F.col("completed_count") == size) & (F.col("failed_count") == 0)
        & (F.col("email_finding_count") == size),
    }
    broken = F.array_compact(F.array(*[
        F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.select("job_id", *[ok.alias(name) for name, ok in checks.items()],
                     F.size(broken).alias("violations"),
                     F.array_join(broken, ",").alias("violated"))


def attempt_numbering(attempts: DataFrame, number: str, bucket: Column) -> DataFrame:
    """Attempts whose number is not their position (unique and contiguous from 1) per URL."""
    placed = sequence_within(
        attempts, ["url_id"], [F.col(number)], bucket, "expected_number")
    return placed.filter(F.col(number) != F.col("expected_number"))


def ordered_checksum(
    df: DataFrame, by: Sequence[str], index: str, line: Column, chunk: int = 1_000
) -> DataFrame:
    """Digest of the lines of each group in index order, without gathering the group.

    Lines are hashed in chunks of consecutive indexes, the chunk digests in chunks again, and the
    few remaining digests once more. Equal groups give equal digests; the form is our own.
    """
    level = df.select(*by, F.col(index).cast("bigint").alias("__at"), line.alias("__line"))
    for _ in range(3):
        level = level.withColumn("__chunk", F.floor(F.col("__at") / chunk)).groupBy(
            *by, "__chunk").agg(_digest("__at", "__line").alias("__line")).select(
            *by, F.col("__chunk").alias("__at"), "__line")
    return level.groupBy(*by).agg(_digest("__at", "__line").alias("checksum"))


def _digest(at: str, text: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(text))))
    return F.sha2(F.array_join(F.transform(items, lambda i: i[text]), "\n"), 256)
