"""SQL fragments shared by the reference formulations (DuckDB dialect)."""

from __future__ import annotations

from contactgrid import reference_data as ref

SPACE = (
    r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# fixed values: public suffixes that the hosts of the test tables can have; the engine reads the
# whole public list instead
SUFFIX_RULES = (
    # generic
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero",
    "coop", "museum", "jobs", "mobi", "travel", "app", "dev", "page", "blog", "cloud",
    "online", "site", "shop", "store", "tech", "agency", "studio", "design", "digital",
    "media", "email", "group", "company", "solutions", "services", "world", "life", "live",
    "news", "xyz", "top", "club", "homes", "build", "construction",
    # countries
    "us", "uk", "ca", "de", "fr", "es", "it", "nl", "be", "ch", "at", "dk", "se", "no", "fi",
    "is", "ie", "pt", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "ru", "ua", "eu", "tr", "il",
    "ae", "sa", "in", "pk", "lk", "cn", "hk", "tw", "jp", "kr", "sg", "my", "th", "vn", "id",
    "ph", "au", "nz", "za", "ng", "ke", "eg", "ma", "mx", "br", "ar", "cl", "co", "pe", "uy",
    "io", "ai", "me", "tv", "cc", "to", "ly", "lu", "li", "lt", "lv", "ee", "hr", "si", "rs",
    # second level
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "com.au", "net.au",
    "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "net.nz", "co.za", "org.za", "com.br",
    "net.br", "org.br", "com.mx", "org.mx", "com.ar", "com.pk", "org.pk", "co.in", "net.in",
    "org.in", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "com.cn", "com.hk", "com.sg",
    "com.my", "com.tr", "co.il", "com.tw", "co.id", "com.ph", "com.vn", "co.th", "com.eg",
    "com.ng", "co.ke", "com.co", "com.pe", "com.ua",
    # wildcard and exception rules
    "*.ck", "!www.ck", "*.bd", "*.kawasaki.jp", "!city.kawasaki.jp",
)
NOW_ORDERS = "TIMESTAMP '2001-08-02 00:00:00'"
NOW_EVENTS = "TIMESTAMP '2024-01-31 00:00:00'"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def suffix_alternatives() -> str:
    rules = [r for r in SUFFIX_RULES if not r.startswith("!")]
    return "|".join(
        r.replace("*.", "[^.]+.").replace(".", r"\.").replace(r"[^\.]", "[^.]") for r in rules)


def registrable(host: str) -> str:
    return (rf"nullif(regexp_extract({host}, '^(?:[^.]+\.)*?([^.]+\.(?:{suffix_alternatives()}))$',"
            " 1), '')")


VIEWS = {
    "urls": """
      SELECT *, job_id * 1000 + rn AS url_id, rn - 1 AS original_index,
        CASE WHEN status IN ('COMPLETED','NO_EMAIL','FAILED') THEN ship END AS completed_at,
        CASE WHEN status = 'SCANNING' THEN ship + INTERVAL 1 DAY END AS lease_expires_at,
        CASE WHEN status = 'RETRY_WAIT' THEN ship + INTERVAL 2 DAY END AS next_retry_at,
        ship - INTERVAL 3 DAY AS created_at, CAST(rn % 4 AS INTEGER) AS attempt_count,
        3 AS max_attempts, CAST(rn % 4 AS INTEGER) AS retry_count,
        CASE WHEN status = 'FAILED' THEN
          CASE l_suppkey % 5 WHEN 0 THEN 'TRANSPORT_ERROR' WHEN 1 THEN 'GENERIC_TIMEOUT'
            WHEN 2 THEN 'HTTP_ERROR' WHEN 3 THEN 'DNS_RESOLUTION_FAILED' ELSE 'UNSAFE_HOST' END
        END AS last_failure_code,
        CASE l_partkey % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'TRANSPORT_ERROR'
          WHEN 2 THEN 'HTTP_ERROR' ELSE 'SUCCESS' END AS fetch_outcome,
        CASE l_suppkey % 4 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 429 ELSE 200 END
          AS status_code
      FROM (SELECT l_orderkey AS job_id, l_partkey, l_suppkey, l_shipdate AS ship,
              l_quantity / 10 AS total_duration_seconds,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey,
                l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
                l_linestatus, l_shipdate) AS rn,
              CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'COMPLETED' WHEN 'AO' THEN
                'NO_EMAIL' WHEN 'NF' THEN 'FAILED' WHEN 'NO' THEN 'QUEUED' WHEN 'RF' THEN
                'SCANNING' WHEN 'RO' THEN 'RETRY_WAIT' END AS status
            FROM lineitem)""",
    "counters": """
      SELECT job_id, count(*) AS valid_input_count,
        count(*) FILTER (status IN ('COMPLETED','NO_EMAIL')) AS completed_count,
        count(*) FILTER (status = 'FAILED') AS failed_count,
        count(*) FILTER (status IN ('QUEUED','RETRY_WAIT')) AS derived_queued,
        count(*) FILTER (status = 'SCANNING') AS running_count,
        count(*) FILTER (status = 'COMPLETED') AS email_finding_count
      FROM urls GROUP BY job_id""",
    "jobs": """
      SELECT o_orderkey AS job_id, o_custkey % 10 AS org_id, o_custkey, o_orderpriority,
        o_totalprice, status, o_orderdate AS created_at,
        CASE WHEN status IN ('FAILED','COMPLETED','COMPLETED_WITH_ERRORS')
          THEN o_orderdate + INTERVAL 2 DAY END AS completed_at,
        CASE WHEN o_orderkey % 3 <> 0
          THEN o_orderdate + to_hours(CAST(o_orderkey % 7 AS INTEGER)) END AS last_claimed_at,
        coalesce(valid_input_count, 0) AS valid_input_count,
        coalesce(completed_count, 0) AS completed_count, coalesce(failed_count, 0) AS failed_count,
        coalesce(derived_queued, 0) + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END
          AS queued_count,
        coalesce(running_count, 0) AS running_count,
        coalesce(email_finding_count, 0) AS email_finding_count,
        coalesce(valid_input_count, 0) + o_orderkey % 3 AS total_input_count,
        CASE WHEN o_orderkey % 3 >= 1 THEN o_orderkey % 2 ELSE 0 END AS duplicate_input_count
      FROM (SELECT *, CASE
              WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'FAILED'
              WHEN o_orderstatus = 'F' THEN 'COMPLETED'
              WHEN o_orderstatus = 'P' THEN 'COMPLETED_WITH_ERRORS'
              WHEN o_orderpriority = '1-URGENT' THEN 'QUEUED'
              WHEN o_orderpriority = '5-LOW' THEN 'CANCELLING' ELSE 'RUNNING' END AS status
            FROM orders) LEFT JOIN counters ON job_id = o_orderkey""",
    "findings": """
      SELECT o_orderkey AS finding_id, o_orderkey AS job_id,
        'c' || c_custkey || '@' || replace(lower(c_mktsegment), ' ', '') || '.com'
          AS canonical_email,
        replace(lower(c_mktsegment), ' ', '') || '.com' AS email_domain,
        CASE c_custkey % 3 WHEN 0 THEN 'ROLE_BASED' WHEN 1 THEN 'PERSONAL_OR_NAMED'
          ELSE 'UNKNOWN' END AS classification,
        CASE WHEN c_custkey % 5 = 0 THEN 'VALID' ELSE 'UNVERIFIED' END AS validation_status,
        o_orderdate + INTERVAL 1 HOUR AS first_found_at,
        o_orderdate + INTERVAL 1 DAY AS last_found_at
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "evidence": "SELECT job_id AS finding_id, url_id AS evidence_id, ship AS created_at FROM urls",
    "requests": """
      SELECT 'site-' || (user_id % 20) AS domain, event_id AS seq, epoch_us(ts) AS arrival,
        (user_id % 3 + 1) * 1000000 AS interval_us,
        CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000000 AS learned
      FROM events""",
    "repeats": """
      SELECT event_id // 3 AS item, CAST(event_id % 3 + 1 AS INTEGER) AS repeat_index,
        event_type AS outcome,
        CASE WHEN event_type = 'error' THEN 'E' || (user_id % 4) END AS failure_code,
        CASE WHEN event_type = 'purchase' THEN 'u' || (user_id % 5) || '@shop.com' END
          AS selected_email
      FROM events""",
    "address_list": r"""
      SELECT page_id AS original_index, CASE page_id % 12
        WHEN 1 THEN 'https://www.google.com/search?q=' || page_id
        WHEN 2 THEN 'https://accounts.google.com' || path
        WHEN 3 THEN 'http://127.0.0.' || (page_id % 250)
        WHEN 4 THEN 'http://93.184.' || (page_id % 3) || '.34' || path
        WHEN 5 THEN 'ftp://' || host
        WHEN 6 THEN 'https://google.com.' || host || path
        WHEN 7 THEN 'WWW.' || host || ':443/?utm_source=x&b=2&a=1#top'
        WHEN 8 THEN 'https://user:pw@' || host
        WHEN 9 THEN 'https://' || host || ':8443' || path
        WHEN 10 THEN 'not-a-valid-url-format-' || page_id
        WHEN 11 THEN '  https://' || host || '//  '
        ELSE url END AS original_input
      FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
              regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""",
    "document_pages": """
      SELECT doc_id AS page_id, source AS site, text,
        'https://' || CASE WHEN doc_id % 3 = 0 THEN source || '.org'
          ELSE 'mail' || (doc_id % 10) || '.example.com' END ||
        CASE doc_id % 4 WHEN 0 THEN '/contact' WHEN 1 THEN '/about' WHEN 2 THEN '/team'
          ELSE '/doc' END || '/' || doc_id AS url
      FROM documents""",
}
NEEDS = {"counters": ("urls",), "jobs": ("counters",), "evidence": ("urls",)}


def parsed(name: str, source: str, key: str, raw: str) -> dict[str, str]:
    """CTE `name`: rows of `source` with the parsed address in column `raw`."""
    return {
        f"{name}_a": rf"""
      SELECT *, regexp_replace(CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN t
        ELSE 'https://' || t END, '[\t\r\n]', '', 'g') AS v
      FROM (SELECT *, regexp_replace({raw}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS t
            FROM {source})""",
        f"{name}_b": rf"""
      SELECT *, regexp_replace(lower(regexp_extract(authority, '^([^:]*)', 1)), '\.+$', '') AS h,
        regexp_extract(authority, '^[^:]*:(.*)$', 1) AS port_text
      FROM (SELECT *, lower(regexp_extract(v, '^([^:]+)://', 1)) AS s,
              regexp_extract(v, '^[^:]+://([^/?#]*)', 1) AS authority,
              regexp_extract(v, '^[^:]+://[^/?#]*([^?#]*)', 1) AS raw_path,
              regexp_extract(v, '^[^?#]*\?([^#]*)', 1) AS q FROM {name}_a)""",
        f"{name}_c": rf"""
      SELECT *, CASE WHEN t = '' THEN 'EMPTY_INPUT'
        WHEN s NOT IN ('http', 'https') THEN 'UNSUPPORTED_SCHEME'
        WHEN contains(authority, '@') THEN 'CREDENTIALS_NOT_ALLOWED'
        WHEN h = '' THEN 'MISSING_HOST'
        WHEN NOT regexp_matches(h, '^([^.]{{1,63}}\.)*[^.]{{0,63}}$') THEN 'INVALID_URL'
        WHEN port_text <> '' AND (NOT regexp_matches(port_text, '^[0-9]+$')
          OR TRY_CAST(port_text AS BIGINT) > 65535) THEN 'INVALID_PORT' END AS error_code,
        regexp_matches(h, '^(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{{2}}|[1-9]?[0-9])){{3}}$')
          AS is_v4,
        CASE WHEN (s = 'http' AND TRY_CAST(port_text AS BIGINT) = 80)
          OR (s = 'https' AND TRY_CAST(port_text AS BIGINT) = 443) THEN NULL
          ELSE TRY_CAST(port_text AS INTEGER) END AS p
      FROM {name}_b""",
        name: rf"""
      SELECT *, CASE WHEN ok THEN s END AS scheme, CASE WHEN ok THEN h END AS hostname,
        CASE WHEN ok THEN p END AS port, CASE WHEN ok THEN full_path END AS path,
        CASE WHEN ok THEN q END AS query,
        CASE WHEN ok THEN CASE WHEN is_v4 THEN 'IPV4' ELSE 'DOMAIN' END END AS host_type,
        CASE WHEN ok AND NOT is_v4 THEN {registrable('h')} END AS registrable_domain,
        CASE WHEN ok THEN s || '://' || h || coalesce(':' || p, '') || full_path
          || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS normalized_url
      FROM (SELECT *, error_code IS NULL AS ok,
              CASE WHEN raw_path = '' THEN '/' ELSE raw_path END AS full_path
            FROM {name}_c)""",
    }


def views(*names: str, **ctes: str) -> str:
    """`WITH` clause for the named views (and what they need) plus further CTEs in order."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        ordered[name] = VIEWS[name]

    for name in names:
        add(name)
    ordered |= ctes
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ordered.items()) + "\n"


def page_score(path: str, text: str) -> str:
    """Sum of the active signal weights over SQL expressions for the path and the text."""
    terms = []
    for name, (weight, words) in ref.PAGE_SIGNALS.items():
        if name == "HOME_PAGE":
            test = f"{path} IN ({quoted(ref.HOME_PATHS)})"
        else:
            test = " OR ".join(f"contains({text}, '{w}')" for w in words)
        terms.append(f"CASE WHEN {test} THEN {weight} ELSE 0 END")
    return "CAST(" + " + ".join(terms) + " AS INTEGER)"


def page_signals(path: str, text: str) -> str:
    parts = []
    for name in sorted(ref.PAGE_SIGNALS):
        words = ref.PAGE_SIGNALS[name][1]
        test = (f"{path} IN ({quoted(ref.HOME_PATHS)})" if name == "HOME_PAGE"
                else " OR ".join(f"contains({text}, '{w}')" for w in words))
        parts.append(f"CASE WHEN {test} THEN '{name}' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"
