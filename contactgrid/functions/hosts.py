"""Literal address handling: recognition, numeric forms, special-purpose blocks, policy."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactgrid import reference_data as ref
from contactgrid.functions.stages import Getter, Stage
from contactgrid.functions.text import is_ascii

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_TEXT = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4_PATTERN = rf"^{IPV4_TEXT}$"


def _ipv6_pattern() -> str:
    """All legal groupings of an IPv6 address, with an optional dotted tail and zone."""
    group = "[0-9a-fA-F]{1,4}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{IPV4_TEXT}"]
    for left in range(8):
        head = rf"{group}(?::{group}){{{left - 1}}}" if left else ""
        room = 7 - left
        tail = rf"(?:{group}(?::{group}){{0,{room - 1}}})?" if room else ""
        forms.append(rf"{head}::{tail}")
        if room >= 2:
            dotted = rf"(?:{group}:){{0,{room - 2}}}{IPV4_TEXT}"
            forms.append(rf"{head}::{dotted}")
    return r"^(?:" + "|".join(forms) + r")(?:%[^%]+)?$"


IPV6_PATTERN = _ipv6_pattern()


def is_ipv4(host: Column) -> Column:
    # only names that end in a digit reach the pattern
    return F.substring(host, -1, 1).between("0", "9") & host.rlike(IPV4_PATTERN)


def is_ipv6(host: Column) -> Column:
    return host.contains(":") & host.rlike(IPV6_PATTERN)


def ipv4_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return sum(
        (F.get(parts, F.lit(i)).cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
        F.get(parts, F.lit(0)).cast("bigint") * 256**3,
    )


def _groups(text: Column) -> Column:
    present = F.filter(F.split(text, ":"), lambda g: g != "")
    return F.transform(present, lambda g: F.lpad(g, 4, "0"))


@lru_cache(maxsize=None)
def address_stages(source: str, prefix: str) -> tuple[Stage, ...]:
    """Stages from the address text in `source` to the flags of `prefix + ..`.

    `is_v4`, `is_v6`, `number` (IPv4, also the one mapped into IPv6), `digits` (the 128 bits of
    IPv6 as 32 hex digits, so that every block is a plain string range), `private`, `unsafe`
    (private, loopback, link-local, reserved or unspecified) and `is_global` (null when the text
    is no address).
    """

    def kind(c: Getter) -> dict[str, Column]:
        return {prefix + "is_v4": is_ipv4(c(source)), prefix + "is_v6": is_ipv6(c(source))}

    def dotted_tail(c: Getter) -> dict[str, Column]:
        address = F.lower(F.substring_index(c(source), "%", 1))
        dotted = F.regexp_extract(address, rf":({IPV4_TEXT})$", 1)
        digits = F.lpad(F.lower(F.hex(ipv4_number(dotted))), 8, "0")
        return {
            prefix + "head": F.when(dotted == "", address).otherwise(
                F.regexp_replace(address, rf"{IPV4_TEXT}$", "")),
            prefix + "tail": F.when(dotted == "", F.lit("")).otherwise(F.concat(
                F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4))),
        }

    def groups(c: Getter) -> dict[str, Column]:
        text = F.concat(c(prefix + "head"), c(prefix + "tail"))
        open_form = text.contains("::")
        return {
            prefix + "left": _groups(F.substring_index(text, "::", 1)),
            prefix + "right": F.when(open_form, _groups(F.substring_index(text, "::", -1))
                                     ).otherwise(F.array().cast("array<string>")),
        }

    def bits(c: Getter) -> dict[str, Column]:
        left, right = c(prefix + "left"), c(prefix + "right")
        zeros = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right))
        return {prefix + "digits": F.when(
            c(prefix + "is_v6"), F.array_join(F.concat(left, zeros, right), ""))}

    def numbers(c: Getter) -> dict[str, Column]:
        digits = c(prefix + "digits")
        mapped = F.substring(digits, 1, 24) == "0" * 20 + "ffff"
        return {prefix + "number": F.when(c(prefix + "is_v4"), ipv4_number(c(source))).when(
            mapped, F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"))}

    def private(c: Getter) -> dict[str, Column]:
        number, digits = c(prefix + "number"), c(prefix + "digits")
        ipv4 = _in_ipv4(number, ref.IPV4_PRIVATE) & ~_in_ipv4(number, ref.IPV4_PRIVATE_EXCEPTIONS)
        ipv6 = _in_ipv6(digits, ref.IPV6_PRIVATE) & ~_in_ipv6(digits, ref.IPV6_PRIVATE_EXCEPTIONS)
        return {prefix + "private": F.when(number.isNotNull(), ipv4).when(
            c(prefix + "is_v6"), ipv6)}

    def verdict(c: Getter) -> dict[str, Column]:
        number = c(prefix + "number")
        reserved = number.isNull() & _in_ipv6(c(prefix + "digits"), ref.IPV6_RESERVED)
        shared = number.isNotNull() & _in_ipv4(number, ref.IPV4_SHARED)
        return {
            prefix + "unsafe": F.coalesce(c(prefix + "private") | reserved, F.lit(False)),
            prefix + "is_global": ~c(prefix + "private") & ~shared,
        }

    return (kind, dotted_tail, groups, bits, numbers, private, verdict)


def _in_ipv4(number: Column, blocks: Iterable[str]) -> Column:
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        low, high = int(block.network_address), int(block.broadcast_address)
        hit = hit | number.between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
    return hit


def _in_ipv6(digits: Column, blocks: Iterable[str]) -> Column:
    hit = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        low, high = int(block.network_address), int(block.broadcast_address)
        hit = hit | digits.between(F.lit(f"{low:032x}"), F.lit(f"{high:032x}"))
    return hit


def is_blocked_hostname(host: Column) -> Column:
    name = F.rtrim(F.lower(host), F.lit("."))
    hit = name.isin(*ref.BLOCKED_HOSTNAMES)
    for suffix in ref.BLOCKED_HOST_SUFFIXES:
        hit = hit | name.endswith(suffix)
    return hit


def ascii_host(host: Column) -> Column:
    """IDNA 2003 form of a host, null when the name cannot be encoded.

    ASCII names only get the label length checks. Others go through the JVM's own IDNA 2003
    codec; `when` keeps that call off the ASCII rows, and no Python worker is involved.
    """
    labels_fit = ~host.startswith(".") & ~host.contains("..") & (
        (F.length(host) <= 63) | host.rlike(r"^(?:[^.]{1,63}\.)*+[^.]{0,63}$"))
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(is_ascii(host), F.when(labels_fit, host)).otherwise(encoded)
