"""Job, URL, finding, evidence, request and presence tables derived from the test tables.

The definitions are those of FIXTURES.md. `NOW_ORDERS` and `NOW_EVENTS` are the explicit clocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.operators.keyed import sequence_within
from contactgrid.sources.tables import read_table

NOW_ORDERS = "2001-08-02 00:00:00"
NOW_EVENTS = "2024-01-31 00:00:00"


def clock(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return read_table(spark, folder, name)


def _choose(key: Column, values: dict[object, str]) -> Column:
    choice = None
    for match, value in values.items():
        test = key == match
        choice = F.when(test, F.lit(value)) if choice is None else choice.when(test, F.lit(value))
    return choice


def urls(spark: SparkSession, folder: str, numbered: bool = False) -> DataFrame:
    """URL rows. `numbered` adds the columns that need a position inside the job."""
    items = _load(spark, folder, "lineitem")
    ship = F.col("l_shipdate").cast("timestamp")
    status = _choose(F.concat("l_returnflag", "l_linestatus"), {
        "AF": "COMPLETED", "AO": "NO_EMAIL", "NF": "FAILED", "NO": "QUEUED", "RF": "SCANNING",
        "RO": "RETRY_WAIT"})
    day = F.expr("interval 1 day")
    failure = _choose(F.col("l_suppkey") % 5, {
        0: "TRANSPORT_ERROR", 1: "GENERIC_TIMEOUT", 2: "HTTP_ERROR", 3: "DNS_RESOLUTION_FAILED",
        4: "UNSAFE_HOST"})
    if numbered:
        order = [F.col(c) for c in items.columns if c != "l_orderkey"]
        items = sequence_within(
            items, ["l_orderkey"], order, bucket=F.floor(F.col("l_partkey") / 4096), name="rn",
            rows=items.count())
    columns = {
        "job_id": F.col("l_orderkey"),
        "status": status,
        "created_at": ship - F.expr("interval 3 days"),
        "completed_at": F.when(status.isin("COMPLETED", "NO_EMAIL", "FAILED"), ship),
        "lease_expires_at": F.when(status == "SCANNING", ship + day),
        "next_retry_at": F.when(status == "RETRY_WAIT", ship + F.expr("interval 2 days")),
        "max_attempts": F.lit(3),
        "last_failure_code": F.when(status == "FAILED", failure),
        "fetch_outcome": _choose(F.col("l_partkey") % 4, {
            0: "TIMEOUT", 1: "TRANSPORT_ERROR", 2: "HTTP_ERROR", 3: "SUCCESS"}),
        "status_code": F.element_at(
            F.array(F.lit(503), F.lit(404), F.lit(429), F.lit(200)),
            (F.col("l_suppkey") % 4 + 1).cast("int")),
        "total_duration_seconds": F.col("l_quantity") / 10,
        "l_partkey": F.col("l_partkey"),
        "l_suppkey": F.col("l_suppkey"),
    }
    if numbered:
        columns |= {
            "rn": F.col("rn"),
            "url_id": F.col("l_orderkey") * 1000 + F.col("rn"),
            "original_index": F.col("rn") - 1,
            "attempt_count": (F.col("rn") % 4).cast("int"),
            "retry_count": (F.col("rn") % 4).cast("int"),
        }
    return items.select(*[value.alias(name) for name, value in columns.items()])


def url_counters(url_rows: DataFrame) -> DataFrame:
    status = F.col("status")
    return url_rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("valid_input_count"),
        F.count_if(status.isin("COMPLETED", "NO_EMAIL")).alias("completed_count"),
        F.count_if(status == "FAILED").alias("failed_count"),
        F.count_if(status.isin("QUEUED", "RETRY_WAIT")).alias("derived_queued"),
        F.count_if(status == "SCANNING").alias("running_count"),
        F.count_if(status == "COMPLETED").alias("email_finding_count"))


def job_status() -> Column:
    state, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        F.when((state == "F") & (priority == "1-URGENT"), F.lit("FAILED"))
        .when(state == "F", F.lit("COMPLETED"))
        .when(state == "P", F.lit("COMPLETED_WITH_ERRORS"))
        .when(priority == "1-URGENT", F.lit("QUEUED"))
        .when(priority == "5-LOW", F.lit("CANCELLING")).otherwise(F.lit("RUNNING")))


def job_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Job columns that need no counters."""
    orders = _load(spark, folder, "orders")
    created = F.col("o_orderdate").cast("timestamp")
    terminal = F.col("status").isin("FAILED", "COMPLETED", "COMPLETED_WITH_ERRORS")
    return orders.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 10).alias("org_id"),
        job_status().alias("status"), created.alias("created_at"),
        F.col("o_custkey").alias("o_custkey"), F.col("o_orderpriority"), F.col("o_totalprice"),
    ).withColumns({
        "completed_at": F.when(terminal, F.col("created_at") + F.expr("interval 2 days")),
        "last_claimed_at": F.when(F.col("job_id") % 3 != 0, F.col("created_at") + F.expr(
            "make_interval(0, 0, 0, 0, cast(job_id % 7 as int))")),
    })


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    counters = url_counters(urls(spark, folder))
    heads = job_heads(spark, folder).join(counters, "job_id", "left").fillna(0, [
        "valid_input_count", "completed_count", "failed_count", "derived_queued",
        "running_count", "email_finding_count"])
    extra = F.col("job_id") % 3
    return heads.withColumns({
        "queued_count": F.col("derived_queued") + F.when(
            F.col("job_id") % 17 == 0, F.lit(1)).otherwise(F.lit(0)),
        "total_input_count": F.col("valid_input_count") + extra,
        "duplicate_input_count": F.when(extra >= 1, F.col("job_id") % 2).otherwise(F.lit(0)),
    }).drop("derived_queued")


def findings(spark: SparkSession, folder: str) -> DataFrame:
    orders = _load(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = _load(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    domain = F.concat(F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("")), F.lit(".com"))
    found = F.col("o_orderdate").cast("timestamp")
    return joined.select(
        F.col("o_orderkey").alias("finding_id"), F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), domain).alias(
            "canonical_email"),
        domain.alias("email_domain"),
        _choose(F.col("c_custkey") % 3, {
            0: "ROLE_BASED", 1: "PERSONAL_OR_NAMED", 2: "UNKNOWN"}).alias("classification"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("VALID")).otherwise(
            F.lit("UNVERIFIED")).alias("validation_status"),
        (found + F.expr("interval 1 hour")).alias("first_found_at"),
        (found + F.expr("interval 1 day")).alias("last_found_at"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = urls(spark, folder, numbered=True)
    return rows.select(
        F.col("job_id").alias("finding_id"), F.col("url_id").alias("evidence_id"),
        (F.col("created_at") + F.expr("interval 3 days")).alias("created_at"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = _load(spark, folder, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests per domain in integer microseconds, with the crawl delay learned so far."""
    learned = F.from_json("props", "k int")["k"]
    return events(spark, folder).select(
        F.concat(F.lit("site-"), (F.col("user_id") % 20).cast("string")).alias("domain"),
        F.col("event_id").alias("seq"), F.unix_micros("ts").alias("arrival"),
        ((F.col("user_id") % 3 + 1) * 1_000_000).alias("interval"),
        (learned.cast("bigint") * 1_000_000).alias("learned"))


def presence(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.col("user_id").alias("instance"), F.col("event_type").alias("state"),
        F.col("ts").alias("last_seen"), F.col("event_id").alias("seq"))


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select(
        F.floor(F.col("event_id") / 3).alias("item"),
        (F.col("event_id") % 3 + 1).cast("int").alias("repeat_index"),
        F.col("event_type").alias("outcome"),
        F.when(F.col("event_type") == "error", F.concat(
            F.lit("E"), (F.col("user_id") % 4).cast("string"))).alias("failure_code"),
        F.when(F.col("event_type") == "purchase", F.concat(
            F.lit("u"), (F.col("user_id") % 5).cast("string"), F.lit("@shop.com"))).alias(
            "selected_email"))


def address_list(spark: SparkSession, folder: str) -> DataFrame:
    """Raw addresses derived from the page corpus: every kind of input a list can hold."""
    pages = _load(spark, folder, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 12
    raw = (
        F.when(kind == 1, F.concat(F.lit("https://www.google.com/search?q="), number))
        .when(kind == 2, F.concat(F.lit("https://accounts.google.com"), path))
        .when(kind == 3, F.concat(F.lit("http://127.0.0."), (F.col("page_id") % 250).cast(
            "string")))
        .when(kind == 4, F.concat(F.lit("http://93.184."), (F.col("page_id") % 3).cast("string"),
                                  F.lit(".34"), path))
        .when(kind == 5, F.concat(F.lit("ftp://"), host))
        .when(kind == 6, F.concat(F.lit("https://google.com."), host, path))
        .when(kind == 7, F.concat(F.lit("WWW."), host, F.lit(":443/?utm_source=x&b=2&a=1#top")))
        .when(kind == 8, F.concat(F.lit("https://user:pw@"), host))
        .when(kind == 9, F.concat(F.lit("https://"), host, F.lit(":8443"), path))
        .when(kind == 10, F.concat(F.lit("not-a-valid-url-format-"), number))
        .when(kind == 11, F.concat(F.lit("  https://"), host, F.lit("//  ")))
        .otherwise(F.col("url")))
    return pages.select(F.col("page_id").alias("original_index"), raw.alias("original_input"))


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages of sites: the site is the source, the address depends on the id."""
    docs = _load(spark, folder, "documents").select("doc_id", "text", "source")
    number = F.col("doc_id")
    host = F.when(number % 3 == 0, F.concat("source", F.lit(".org"))).otherwise(
        F.concat(F.lit("mail"), (number % 10).cast("string"), F.lit(".example.com")))
    section = F.element_at(
        F.array(*map(F.lit, ("/contact", "/about", "/team", "/doc"))),
        (number % 4 + 1).cast("int"))
    return docs.select(
        number.alias("page_id"), F.col("source").alias("site"),
        F.concat(F.lit("https://"), host, section, F.lit("/"), number.cast("string")).alias(
            "url"),
        "text")
