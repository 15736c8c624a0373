"""Public-host policy over resolved addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactgrid.functions import hosts
from contactgrid.functions.stages import run_on_columns
from contactgrid.operators.prefixes import rules_of_prefixes


def classify_addresses(addresses: DataFrame, column: str = "address") -> DataFrame:
    """Add `is_v4`, `is_v6`, `number`, `digits` and `is_global` for literal addresses."""
    return run_on_columns(
        addresses, {"address": F.col(column)}, hosts.address_stages("address", ""),
        ["is_v4", "is_v6", "number", "digits", "unsafe", "is_global"])


def host_policy(names: DataFrame, resolved: DataFrame) -> DataFrame:
    """Verdict and ordered public addresses per host.

    `names` has (hostname, host_type); `resolved` has (hostname, address) for domain names. One
    unsafe address blocks the host. Address lists are the answers of one name lookup and are
    de-duplicated before they are gathered.
    """
    literals = names.filter(F.col("host_type") != "DOMAIN").select(
        "hostname", F.col("hostname").alias("address"))
    domains = resolved.join(
        names.filter(F.col("host_type") == "DOMAIN").select("hostname"), "hostname", "left_semi")
    rated = classify_addresses(literals.unionByName(
        domains.select("hostname", "address")).distinct())
    entry = F.struct(
        F.when(F.col("is_v4"), F.lit(4)).otherwise(F.lit(6)).alias("version"),
        F.when(F.col("is_v4"), F.lpad(F.lower(F.hex("number")), 32, "0")).otherwise(
            F.col("digits")).alias("value"), "address")
    per_host = rated.groupBy("hostname").agg(
        F.count_if(F.col("is_global").isNull()).alias("bad"),
        F.count_if(~F.col("is_global")).alias("private"),
        F.array_sort(F.collect_set(entry)).alias("ordered"))
    df = names.join(per_host, "hostname", "left")
    code = (
        F.when(hosts.is_blocked_hostname(F.col("hostname")), F.lit("BLOCKED_HOSTNAME"))
        .when(F.col("ordered").isNull(), F.lit("NO_RESOLVED_ADDRESSES"))
        .when(F.col("bad") > 0, F.lit("INVALID_IP_ADDRESS"))
        .when(F.col("private") > 0, F.lit("NON_PUBLIC_IP_ADDRESS")))
    return df.select(
        "hostname", "host_type", code.alias("block_code"),
        F.when(code.isNull(), F.transform("ordered", lambda e: e["address"])).alias("addresses"))


def _bits(is_v4: Column) -> Column:
    """The address as text: a sign of its version, then its 32 or 128 bits."""
    groups = [F.lpad(F.conv(F.substring("digits", 4 * i + 1, 4), 16, 2), 16, "0")
              for i in range(8)]
    return F.when(is_v4, F.concat(F.lit("4"), F.lpad(F.bin("number"), 32, "0"))).when(
        F.col("is_v6"), F.concat(F.lit("6"), *groups))


def block_prefixes(blocks: DataFrame, column: str = "block") -> DataFrame:
    """(prefix, block) of the valid blocks `address/size`, one row per network.

    Bits beyond the size are ignored, and without a size the block is one address. A block of
    mapped IPv4 addresses with a size of 96 or more is the IPv4 block. Of several texts of one
    network the smallest stays. Texts that are no block, and null, are left out.
    """
    parts = F.split(F.col(column), "/")
    rows = blocks.select(F.col(column).alias("block"), F.get(parts, F.lit(0)).alias("address"),
                         F.get(parts, F.lit(1)).alias("given"), F.size(parts).alias("parts"))
    rated = classify_addresses(rows)
    width = F.when(F.col("is_v4"), F.lit(32)).otherwise(F.lit(128))
    size = F.when(F.col("parts") == 1, width).when(
        (F.col("parts") == 2) & F.col("given").rlike("^[0-9]{1,3}$"), F.col("given").cast("int"))
    mapped = F.col("is_v6") & F.col("number").isNotNull() & (size >= 96)
    cut = rated.filter(size <= width).select(
        "block", _bits(F.col("is_v4") | mapped).alias("bits"),
        F.when(mapped, size - 96).otherwise(size).alias("size"))
    prefix = F.substr(F.col("bits"), F.lit(1), F.col("size") + 1)
    return cut.select(prefix.alias("prefix"), "block").filter(
        F.col("prefix").isNotNull()).groupBy("prefix").agg(F.min("block").alias("block"))


def with_block(addresses: DataFrame, blocks: DataFrame, column: str = "address") -> DataFrame:
    """`addresses` with `matched_block`, the narrowest of `blocks` (column `block`) that holds it.

    The block table may have any size: an address is cut at the sizes that occur, of which there
    are at most 162 (the only values that reach the driver), and joined by equality. An IPv4 address
    mapped into IPv6 is looked up as the IPv4 address. Texts that are no address, and null, have no
    block.
    """
    prefixes = block_prefixes(blocks)
    sizes = [(row.sign, row.size) for row in prefixes.select(
        F.substring("prefix", 1, 1).alias("sign"), F.length("prefix").alias("size")
    ).distinct().collect()]
    lengths = {sign: F.array(*[F.lit(size) for kind, size in sizes if kind == sign]).cast(
        "array<int>") for sign in "46"}
    texts = classify_addresses(
        addresses.select(F.col(column).alias("address")).distinct()).select(
        "address", _bits(F.col("number").isNotNull()).alias("bits"))
    found = rules_of_prefixes(
        texts, prefixes, [], "bits", "prefix",
        F.when(F.col("bits").startswith("4"), lengths["4"]).otherwise(lengths["6"]),
        matched_block=F.max_by("block", F.length("__cut")))
    blocked = texts.join(found, "bits").select(
        F.col("address").alias("__address"), "matched_block")
    return addresses.join(
        blocked, F.col(column) == F.col("__address"), "left").drop("__address")
