"""Writers: CSV export, JSON report, table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactgrid import reference_data as ref


def write_csv_export(rows: DataFrame, path: str, single_file: bool = False) -> None:
    """Findings of one export as CSV with CRLF and minimal quoting, ordered by (e-mail, id).

    The order is global: files in name order form the export. One file is written only on
    request, for exports that one task can write.
    """
    ordered = rows.orderBy("sort_email", "sort_id").select(*ref.EXPORT_COLUMNS)
    if single_file:
        ordered = ordered.coalesce(1)
    (ordered.write.mode("overwrite").option("header", True).option("lineSep", "\r\n")
     .option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path))


def report_json(df: DataFrame, key: list[str]) -> DataFrame:
    """One JSON document per row, fields in name order."""
    fields = sorted(c for c in df.columns)
    return df.select(*key, F.to_json(F.struct(*fields)).alias("document"))


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a new table version beside the old one; the caller switches readers over."""
    df.write.mode("errorifexists").parquet(path)
