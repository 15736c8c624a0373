"""Address normalization as staged column derivations."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.functions.hosts import ascii_host, is_ipv4, is_ipv6
from contactgrid.functions.stages import Getter, Stage
from contactgrid.functions.suffixes import (
    DEFAULT_RULES,
    SuffixRules,
    domain_under_suffix,
    suffix_size,
)
from contactgrid.functions.text import is_ascii, sanitize_text, strip_space

# characters whose compatibility form contains one of / ? # @ : (fixed values)
_DELIMITER_LOOKALIKES = (
    r"\x{2100}\x{2101}\x{2105}\x{2106}\x{2a74}\x{fe13}\x{fe16}\x{fe55}\x{fe56}\x{fe5f}\x{fe6b}"
    r"\x{ff03}\x{ff0f}\x{ff1a}\x{ff1f}\x{ff20}"
)
URL_FIELDS = (
    "normalized_url", "scheme", "hostname", "port", "path", "query", "host_type",
    "registrable_domain", "error_code",
)


@lru_cache(maxsize=None)
def normalization_stages(
    rules: SuffixRules = DEFAULT_RULES, max_length: int | None = None
) -> tuple[Stage, ...]:
    """Stages from `raw` to the fields of `URL_FIELDS` (plus working values)."""

    def whole(c: Getter) -> dict[str, Column]:
        trimmed = strip_space(F.coalesce(c("raw"), F.lit("")))
        return {"trimmed": trimmed}

    def with_scheme(c: Getter) -> dict[str, Column]:
        text = c("trimmed")
        explicit = text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*+://")
        full = F.when(explicit, text).otherwise(F.concat(F.lit("https://"), text))
        return {"full": F.translate(full, "\t\r\n", "")}

    # plain byte-level string functions from here on: they are several times cheaper than
    # regular expressions, which convert every value to a JVM string and back
    def split(c: Getter) -> dict[str, Column]:
        scheme = F.substring_index(c("full"), "://", 1)
        return {"scheme": F.lower(scheme), "rest": F.substring_index(
            F.substr(c("full"), F.length(scheme) + 4), "#", 1)}

    def split_query(c: Getter) -> dict[str, Column]:
        before = F.substring_index(c("rest"), "?", 1)
        return {"before_query": before, "query": F.substr(c("rest"), F.length(before) + 2)}

    def split_path(c: Getter) -> dict[str, Column]:
        authority = F.substring_index(c("before_query"), "/", 1)
        return {"authority": authority, "address": F.substring_index(authority, "@", -1),
                "raw_path": F.substr(c("before_query"), F.length(authority) + 1)}

    def host_and_port(c: Getter) -> dict[str, Column]:
        address = c("address")
        bracketed = address.startswith("[")
        host = F.when(bracketed, F.regexp_extract(address, r"^\[([^\]]*+)\]", 1)).otherwise(
            F.substring_index(address, ":", 1))
        port = F.when(bracketed, F.regexp_extract(address, r"^\[[^\]]*+\]:(.*)$", 1)).otherwise(
            F.substr(address, F.length(F.substring_index(address, ":", 1)) + 2))
        broken = (address.contains("[") | address.contains("]")) & ~address.rlike(
            r"^\[[^\[\]]*+\](?::.*)?$")
        return {
            "raw_host": F.lower(host),
            "port_text": port,
            "bracketed": bracketed,
            "broken": broken | (~is_ascii(c("authority")) & c("authority").rlike(
                f"[{_DELIMITER_LOOKALIKES}]")),
        }

    def host(c: Getter) -> dict[str, Column]:
        return {"bare_host": F.rtrim(c("raw_host"), F.lit("."))}

    def host_kind(c: Getter) -> dict[str, Column]:
        name = c("bare_host")
        return {"is_v4": is_ipv4(name), "is_v6": is_ipv6(name)}

    def encoded(c: Getter) -> dict[str, Column]:
        name = c("bare_host")
        literal = c("is_v4") | c("is_v6")
        port = c("port_text").try_cast("bigint")
        default = ((c("scheme") == "http") & (port == 80)) | (
            (c("scheme") == "https") & (port == 443))
        good_port = (c("port_text") != "") & c("port_text").rlike("^[0-9]+$") & (port <= 65535)
        return {
            "hostname": F.when(literal, name).otherwise(ascii_host(name)),
            "port": F.when(good_port & ~default, port.cast("int")),
            "bad_port": (c("port_text") != "") & ~F.coalesce(good_port, F.lit(False)),
        }

    def suffix(c: Getter) -> dict[str, Column]:
        return {"suffix_size": suffix_size(c("hostname"), rules)}

    def verdict(c: Getter) -> dict[str, Column]:
        text = c("trimmed")
        bad_bracket_host = c("bracketed") & ~c("is_v6") & ~c("bare_host").rlike(
            r"^v[0-9a-f]+\..+$")
        too_long = F.lit(False) if max_length is None else F.length(text) > max_length
        code = (
            F.when(text == "", F.lit("EMPTY_INPUT"))
            .when(too_long, F.lit("INPUT_TOO_LONG"))
            .when(c("broken") | bad_bracket_host, F.lit("INVALID_URL"))
            .when(~c("scheme").isin("http", "https"), F.lit("UNSUPPORTED_SCHEME"))
            .when(c("authority").contains("@"), F.lit("CREDENTIALS_NOT_ALLOWED"))
            .when(c("raw_host") == "", F.lit("MISSING_HOST"))
            .when(c("hostname").isNull(), F.lit("INVALID_URL"))
            .when(c("hostname") == "", F.lit("MISSING_HOST"))
            .when(c("bad_port"), F.lit("INVALID_PORT"))
        )
        return {"error_code": code}

    def assembled(c: Getter) -> dict[str, Column]:
        valid = c("error_code").isNull()
        path = F.when(c("raw_path") == "", F.lit("/")).otherwise(c("raw_path"))
        netloc = F.when(c("is_v6"), F.concat(F.lit("["), c("hostname"), F.lit("]"))).otherwise(
            c("hostname"))
        netloc = F.when(
            c("port").isNotNull(), F.concat(netloc, F.lit(":"), c("port").cast("string"))
        ).otherwise(netloc)
        query = F.when(c("query") == "", F.lit("")).otherwise(
            F.concat(F.lit("?"), c("query")))
        domain = valid & ~c("is_v4") & ~c("is_v6")
        return {
            "normalized_url": F.when(
                valid, F.concat(c("scheme"), F.lit("://"), netloc, path, query)),
            "host_type": F.when(valid, F.when(c("is_v4"), F.lit("IPV4")).when(
                c("is_v6"), F.lit("IPV6")).otherwise(F.lit("DOMAIN"))),
            "registrable_domain": F.when(domain, domain_under_suffix(c("hostname"), c("suffix_size"))),
            "path": F.when(valid, path),
            "scheme": F.when(valid, c("scheme")),
            "hostname": F.when(valid, c("hostname")),
            "port": F.when(valid, c("port")),
            "query": F.when(valid, c("query")),
        }

    return (whole, with_scheme, split, split_query, split_path, host_and_port, host, host_kind,
            encoded, suffix, verdict, assembled)


def error_message(code: Column, hostname_known: Column) -> Column:
    """Message of a normalization error code."""
    message = F.when(
        (code == "INVALID_URL") & hostname_known, F.lit(ref.BAD_HOST_MESSAGE))
    for name, text in ref.NORMALIZATION_MESSAGES.items():
        message = message.when(code == name, F.lit(text))
    return message


_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*+):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*+:)?//([^/?#]*+)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*+:)?(?://[^/?#]*+)?([^?#]*+)"


def _staged(url: Column, *stages: Callable[[Column], dict[str, Column]]) -> Column:
    """The value `result` of the last stage; every value of the stages is computed once a row.

    Written as one expression, the later values would hold copies of the earlier ones, dozens of
    regular expressions a row.
    """
    names = ["url"]

    def extend_with(stage: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
        def extend(one: Column) -> Column:
            values = stage(one)
            kept = [one[name].alias(name) for name in names]
            names.extend(values)
            return F.struct(*kept, *[value.alias(name) for name, value in values.items()])

        return extend

    step = F.array(F.struct(url.alias("url")))
    for stage in stages:
        step = F.transform(step, extend_with(stage))
    return F.get(step, F.lit(0))["result"]


def _split_netloc(c: Column) -> dict[str, Column]:
    host, port = _host_port(c["netloc"])
    return {"host": host, "port": port, "broken": _broken_port(c["netloc"])}


def storage_url(url: Column) -> Column:
    """Stored form: no user info, query, fragment or default port; blank when there is nothing."""
    def text(c: Column) -> dict[str, Column]:
        return {"text": strip_space(F.coalesce(c["url"], F.lit("")))}

    def parts(c: Column) -> dict[str, Column]:
        return {"scheme": F.lower(F.regexp_extract(c["text"], _SCHEME, 1)),
                "netloc": F.regexp_extract(c["text"], _NETLOC, 1),
                "path": F.regexp_extract(c["text"], _PATH, 1)}

    def result(c: Column) -> dict[str, Column]:
        scheme, host, port, path = c["scheme"], c["host"], c["port"], c["path"]
        default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
        shown = F.when(
            port.isNotNull() & ~default, F.concat(host, F.lit(":"), port.cast("string")))
        clean = F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.lit("//"),
            F.coalesce(shown, host),
            F.when(path == "", F.lit("/")).otherwise(path))
        return {"result": (
            F.when(c["text"] == "", F.lit(""))
            .when(c["broken"], F.coalesce(sanitize_text(c["url"]), F.lit("")))
            .when(host == "", strip_space(path))
            .otherwise(clean)
        )}

    return _staged(url, text, parts, _split_netloc, result)


def audit_url(url: Column) -> Column:
    """Audit form: no user info, query or fragment; the port stays as given."""
    def parts(c: Column) -> dict[str, Column]:
        return {"scheme": F.lower(F.regexp_extract(c["url"], _SCHEME, 1)),
                "netloc": F.regexp_extract(c["url"], _NETLOC, 1),
                "path": F.regexp_extract(c["url"], _PATH, 1)}

    def result(c: Column) -> dict[str, Column]:
        scheme, host, port = c["scheme"], c["host"], c["port"]
        shown = F.when(port > 0, F.concat(host, F.lit(":"), port.cast("string"))).otherwise(host)
        clean = F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
            F.when(c["netloc"] != "", F.concat(F.lit("//"), shown)).otherwise(F.lit("")),
            c["path"])
        plain = F.substring_index(F.substring_index(c["url"], "?", 1), "#", 1)
        empty = c["url"].isNull() | (c["url"] == "")
        return {"result": F.when(empty, F.lit(None).cast("string")).when(
            c["broken"], plain).otherwise(clean)}

    return _staged(url, parts, _split_netloc, result)


def _host_port(netloc: Column) -> tuple[Column, Column]:
    address = F.substring_index(netloc, "@", -1)
    bracketed = address.startswith("[")
    host = F.when(bracketed, F.regexp_extract(address, r"^\[([^\]]*+)\]", 1)).otherwise(
        F.substring_index(address, ":", 1))
    port = F.regexp_extract(address, r":([0-9]+)$", 1)
    # a failed cast costs more than all the rest: most addresses name no port
    given = address.contains(":") & ~address.endswith("]")
    return F.lower(host), F.when(given, port.try_cast("int"))


def _broken_port(netloc: Column) -> Column:
    address = F.substring_index(netloc, "@", -1)
    port = F.when(
        address.startswith("["), F.regexp_extract(address, r"^\[[^\]]*+\]:(.*)$", 1)
    ).otherwise(F.regexp_extract(address, r"^[^:]*+:(.*)$", 1))
    number = port.try_cast("bigint")
    return (port != "") & ~F.coalesce(
        port.rlike("^[0-9]+$") & (number <= 65535), F.lit(False))


def decode_form(text: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stays as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"))


def decode_percent(text: Column) -> Column:
    """Percent decoding outside forms, where a plus sign is just a plus sign."""
    return decode_form(F.replace(text, F.lit("+"), F.lit("%2B")))


def parse_query(query: Column) -> Column:
    """Array of (key, value) pairs of a query string, decoded; blank values are kept."""
    present = F.filter(F.split(query, "&"), lambda item: item != "")

    def pair(item: Column) -> Column:
        has_value = item.contains("=")
        key = F.substring_index(item, "=", 1)
        value = F.when(has_value, F.substr(item, F.length(key) + 2)).otherwise(F.lit(""))
        return F.struct(decode_form(key).alias("key"), decode_form(value).alias("value"))

    return F.transform(present, pair)


def encode_form(text: Column) -> Column:
    """Form encoding; the JVM encoder escapes `~` and keeps `*`, form encoding does the reverse."""
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(query: Column, on_platform: Column) -> Column:
    """Query without tracking parameters, order kept, re-encoded."""

    def wanted(pair: Column) -> Column:
        key = F.lower(pair["key"])
        return ~key.isin(*ref.TRACKING_PARAMETERS) & ~(on_platform & (key == "ved"))

    kept = F.filter(parse_query(query), wanted)
    parts = F.transform(
        kept, lambda p: F.concat(encode_form(p["key"]), F.lit("="), encode_form(p["value"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(parts, "&"))
