"""Tenant scope, filters, keyset pages, cursors and reporting periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURSOR_VERSION = 1
PERIOD_DAYS = {"7d": 7, "30d": 30, "90d": 90}


def tenant_scope(df: DataFrame, jobs: DataFrame, org_id: object | None = None) -> DataFrame:
    """Rows of `df` with the tenant they belong to, through their job; one tenant if given.

    The tenant predicate sits on the jobs side and reaches its scan.
    """
    owners = jobs.select("job_id", "org_id")
    if org_id is not None:
        owners = owners.filter(F.col("org_id") == org_id)
    return df.join(owners, "job_id")


def optional_filters(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters for the values that are not None."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def prefix_search(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Literal prefix search; `%` and `_` have no special meaning and the scan can use it."""
    if not 2 <= len(prefix) <= 50:
        raise ValueError("search prefix must have 2 to 50 characters")
    return df.filter(F.col(column).startswith(prefix))


def keyset_page(
    df: DataFrame,
    order: Sequence[str],
    limit: int,
    after: Sequence[object] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Rows after the cursor `after` in the order of `order`, with `has_more`.

    One extra row is fetched to know whether another page follows; the plan is a filter and a
    top-k (no full sort), whatever the page number.
    """
    if after is not None:
        before = None
        for depth in range(len(order)):
            clause = (F.col(order[depth]) < F.lit(after[depth])) if descending else (
                F.col(order[depth]) > F.lit(after[depth]))
            for name, value in zip(order[:depth], after[:depth], strict=True):
                clause = clause & (F.col(name) == F.lit(value))
            before = clause if before is None else before | clause
        # the plain bound on the leading column is what the scan can use
        lead = F.col(order[0])
        df = df.filter(lead <= F.lit(after[0]) if descending else lead >= F.lit(after[0]))
        df = df.filter(before)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    window = df.orderBy(*keys).limit(limit + 1)
    rows = F.array_sort(F.collect_list(F.struct(*[
        F.struct(*[F.col(c) for c in order]).alias("key"), F.struct(*df.columns).alias("row")])))
    page = window.agg(rows.alias("rows"))
    shown = F.slice(F.reverse("rows"), 1, limit) if descending else F.slice("rows", 1, limit)
    flat = page.select((F.size("rows") > limit).alias("has_more"),
                       F.posexplode(shown).alias("at", "r"))
    return flat.select("r.row.*", (F.col("at") + 1).alias("position"), "has_more")


def encode_cursor(resource: str, values: Sequence[Column]) -> Column:
    """Cursor token for a row: URL-safe base64 of a small JSON document, without padding."""
    body = F.to_json(F.struct(
        F.lit(CURSOR_VERSION).alias("version"), F.lit(resource).alias("resource"),
        F.array(*[v.cast("string") for v in values]).alias("values")))
    token = F.base64(F.encode(body, "UTF-8"))
    return F.rtrim(F.translate(F.regexp_replace(token, r"\s", ""), "+/", "-_"), F.lit("="))


def decode_cursor(
    token: Column, resource: str, size: int, max_bytes: int | None = None
) -> Column:
    """Values of a cursor token, null when the token does not fit version, resource or size."""
    well_formed = token.rlike("^[A-Za-z0-9_-]+$")
    if max_bytes is not None:
        well_formed = well_formed & (F.octet_length(token) <= max_bytes)
    padded = F.rpad(
        F.translate(token, "-_", "+/"),
        (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    text = F.when(well_formed, F.try_to_binary(padded, F.lit("base64"))).cast("string")
    body = F.from_json(text, "version int, resource string, values array<string>")
    fits = (body["version"] == CURSOR_VERSION) & (body["resource"] == resource) & (
        F.size(body["values"]) == size)
    return F.when(fits, body["values"])


def period_bounds(now: Column, period: str) -> tuple[Column | None, Column]:
    """Start (midnight of the first day, inclusive) and end (exclusive) of a reporting period."""
    if period == "all":
        return None, now
    days = PERIOD_DAYS[period]
    return F.date_trunc("day", now) - F.expr(f"interval {days - 1} days"), now


def in_period(df: DataFrame, column: str, now: Column, period: str) -> DataFrame:
    start, end = period_bounds(now, period)
    if start is None:
        return df
    return df.filter((F.col(column) >= start) & (F.col(column) < end))
