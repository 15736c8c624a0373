"""Per-key work that stays parallel when one key holds a large share of the rows.

`row_number` and running aggregates over a plain `partitionBy(key)` put a whole key into one
task. The helpers here split every key by a bucket of its ordering column: rows are ranked or
accumulated inside (key, bucket), and the small per-bucket totals carry the state across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that a task sorts or groups at once, about.
PARTITION_ROWS = 1 << 20
#: A key with more rows is crowded: its rows do not meet in one task.
CROWD = 1 << 17


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match; `right` must not share other column names."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        clause = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = clause if condition is None else condition & clause
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def with_group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Attach aggregates of each key to all of its rows.

    The grouped side has one row per key and is combined map-side; the join back is one the
    skew-join rule can split, which a window over the key is not.
    """
    grouped = df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    return null_safe_join(df, grouped, keys, "inner")


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """`df`, of at most `rows` rows, dealt by `keys` for work that sorts or groups by them.

    The partitions grow in number with the rows, so that a task's memory does not; where the
    session's own partitions are small enough, Spark shuffles as usual.
    """
    parts = -(-rows // PARTITION_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts > usual else df


def split_crowded(
    df: DataFrame, keys: Sequence[str], crowd: int = CROWD
) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with at most `crowd` rows, and those of the others.

    The crowded keys are broadcast: there is at most one of them for every `crowd` rows.
    """
    crowded = F.broadcast(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).filter(
        F.col("__size") > crowd).select(*keys))
    return (null_safe_join(df, crowded, keys, "left_anti"),
            null_safe_join(df, crowded, keys, "left_semi"))


def sequence_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str,
    wider: Sequence[Column] = (), rows: int | None = None, crowd: int = CROWD,
) -> DataFrame:
    """Exact `row_number() over (partition by keys order by order)`.

    Keys of up to `crowd` rows are numbered in one task each. The others are cut by `bucket`, which
    must be non-decreasing in `order` (a time slice, an index range): only the row counts of the
    buckets meet in one task per key. Where even these are many, `wider` names groups of buckets,
    each a function of the bucket that does not decrease, the widest first: then only the counts
    inside one group, and those of the widest groups, meet in a task. `rows` is the size of `df`,
    if it is known.
    """
    plain, crowded = split_crowded(df, keys, crowd)
    numbered = spread(plain, keys, rows or 0).withColumn(
        name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return numbered.unionByName(_sequence_in_buckets(crowded, keys, order, bucket, name, wider))


def _sequence_in_buckets(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str,
    wider: Sequence[Column],
) -> DataFrame:
    levels = [*(f"__wide{i}" for i in range(len(wider))), "__bucket"]
    df = df.withColumns(dict(zip(levels, [*wider, bucket])))
    local = df.withColumn(
        "__local", F.row_number().over(W.partitionBy(*keys, "__bucket").orderBy(*order)))
    counts = df.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = _rows_before(counts, keys, levels).select(*keys, "__bucket", "__before")
    joined = null_safe_join(local, offsets, [*keys, "__bucket"], "inner")
    return joined.withColumn(name, (F.col("__before") + F.col("__local")).cast("bigint")).drop(
        *levels, "__local", "__before")


def _rows_before(counts: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """`__before`: the rows of a key in all earlier buckets, added up level by level."""
    *wide, finest = levels
    before = F.sum("__rows").over(
        W.partitionBy(*keys, *wide).orderBy(F.col(finest).asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, -1))
    placed = counts.withColumn("__before", F.coalesce(before, F.lit(0)))
    if wide:
        totals = counts.groupBy(*keys, *wide).agg(F.sum("__rows").alias("__rows"))
        ahead = _rows_before(totals, keys, wide).select(
            *keys, *wide, F.col("__before").alias("__ahead"))
        placed = null_safe_join(placed, ahead, [*keys, *wide], "inner").withColumn(
            "__before", F.col("__before") + F.col("__ahead")).drop("__ahead")
    return placed


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str
) -> DataFrame:
    """First `k` rows per key. The rank filter is pushed below the shuffle (group limit), so each
    map task sends at most `k` rows of a key."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def winner_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The first row per key by `order` as one map-side combined aggregate (no sort).

    `order` may use `desc()`-free columns only: negate numbers for a descending order.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*rest), rank).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by its other columns: the same one on every run."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    least = F.min(F.struct(*rest)).alias("__least")
    return df.groupBy(*keys).agg(least).select(*keys, "__least.*")
