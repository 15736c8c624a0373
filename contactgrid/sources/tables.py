"""Stored tables with declared schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double,"
              " props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double,"
                " c_mktsegment string",
    "scan_jobs": "id string, organization_id string, created_by_user_id string, name string,"
                 " status string, source_type string, scanner_version string,"
                 " normalization_version string, ranking_version string,"
                 " configuration_snapshot string, idempotency_key string,"
                 " request_fingerprint string, next_event_sequence int, total_input_count int,"
                 " valid_input_count int, duplicate_input_count int, queued_count int,"
                 " running_count int, completed_count int, failed_count int,"
                 " email_finding_count int, started_at timestamp, completed_at timestamp,"
                 " cancellation_requested_at timestamp, last_claimed_at timestamp,"
                 " created_at timestamp, updated_at timestamp",
    "scan_urls": "id string, scan_job_id string, original_index int, original_input string,"
                 " normalized_url string, normalized_domain string, status string,"
                 " duplicate_of_scan_url_id string, attempt_count int, max_attempts int,"
                 " last_error_code string, last_error_message string, next_retry_at timestamp,"
                 " lease_expires_at timestamp, started_at timestamp, completed_at timestamp,"
                 " total_duration_seconds double, pages_attempted int, pages_fetched int,"
                 " retry_count int, last_failure_code string, created_at timestamp",
    "crawl_attempts": "id string, scan_url_id string, attempt_number int, outcome string,"
                      " retryable boolean, requested_url string, final_url string,"
                      " status_code int, error_code string, error_message string,"
                      " failure_code string, redirect_history string,"
                      " connection_attempts string, started_at timestamp,"
                      " completed_at timestamp, elapsed_seconds double,"
                      " dns_duration_seconds double, gate_wait_seconds double,"
                      " robots_duration_seconds double, http_duration_seconds double,"
                      " parse_duration_seconds double, result_checksum string,"
                      " created_at timestamp",
    "crawled_pages": "id string, crawl_attempt_id string, scan_url_id string,"
                     " normalized_url string, final_url string, depth int, outcome string,"
                     " status_code int, content_type string, content_sha256 string,"
                     " page_score int, ranking_version string, robots_decision string,"
                     " links_discovered_count int, emails_found_count int,"
                     " fetched_at timestamp, created_at timestamp",
    "email_findings": "id string, scan_job_id string, scan_url_id string,"
                      " canonical_email string, email_domain string, classification string,"
                      " is_role_based boolean, validation_status string,"
                      " first_found_at timestamp, last_found_at timestamp, evidence_count int,"
                      " created_at timestamp, updated_at timestamp",
    "email_evidence": "id string, email_finding_id string, crawled_page_id string,"
                      " source_type string, raw_candidate string, snippet string,"
                      " page_url string, confidence double, candidate_hash string,"
                      " created_at timestamp",
    "rejected_email_candidates": "id string, scan_job_id string, scan_url_id string,"
                                 " crawled_page_id string, candidate_hash string,"
                                 " masked_candidate string, rejection_code string,"
                                 " source_type string, created_at timestamp",
    "job_events": "id string, scan_job_id string, scan_url_id string, event_type string,"
                  " sequence_number int, payload string, created_at timestamp",
    "audit_logs": "id string, organization_id string, actor_user_id string, action string,"
                  " target_type string, target_id string, request_id string,"
                  " before_values string, after_values string, metadata string,"
                  " created_at timestamp",
}
REDIRECT_HISTORY = "array<struct<url:string,status_code:int,location:string>>"
CONNECTION_ATTEMPTS = (
    "array<struct<target_host:string,target_port:int,attempted_ip:string,success:boolean,"
    "error_message:string>>")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table `name` below `folder` with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
    **options: str,
) -> DataFrame:
    """Relational source split over `parts` ranges of a numeric key."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options).load())


def parse_json(column: str | Column, schema: str) -> Column:
    """JSON text column to a typed value; malformed text gives null."""
    return F.from_json(column, schema)


def redirect_hops(attempts: DataFrame) -> DataFrame:
    """One row per redirect of an attempt, in hop order."""
    history = parse_json("redirect_history", REDIRECT_HISTORY)
    return attempts.select("id", F.posexplode(history).alias("hop", "redirect")).select(
        "id", "hop", "redirect.*")


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event log in per-job order; the order is a column, not a row order."""
    return read_table(spark, folder, "job_events")


def struct_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])
