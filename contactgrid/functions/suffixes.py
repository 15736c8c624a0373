"""Registrable domain under the public suffix list, without a join.

The rules become one literal array of buckets: a host's last n labels hash to a bucket, and the
bucket's few rules are searched as text. A host costs a handful of such look-ups, and the plan holds
one literal however many rules there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The public list as Spark's HTTP client carries it on the class path.
PUBLIC_LIST = "/mozilla/public-suffix-list.txt"
BUCKETS = 4096
PLAIN, WILDCARD, EXCEPTION = "=", "*", "!"


def _ascii(name: str) -> str:
    return ".".join(label if label.isascii() else label.encode("idna").decode()
                    for label in name.split("."))


def public_rules() -> list[str]:
    """The rules of the list's section of registries."""
    jvm = SparkSession.active()._jvm
    text = jvm.org.apache.commons.io.IOUtils.resourceToString(
        PUBLIC_LIST, jvm.java.nio.charset.StandardCharsets.UTF_8)
    section = text.partition("===BEGIN ICANN DOMAINS===")[2].partition("===END ICANN DOMAINS===")[0]
    lines = (line.strip() for line in section.splitlines())
    return [line for line in lines if line and not line.startswith("//")]


class SuffixRules:
    """Public-suffix rules: plain, wildcard parents (`*.x`), exceptions (`!x`).

    Without `rules` it is the public list, read when it is first needed.
    """

    def __init__(self, rules: Iterable[str] | None = None):
        self._given = None if rules is None else tuple(rules)

    @staticmethod
    def parse(rules: Iterable[str]) -> SuffixRules:
        return SuffixRules(rules)

    @cached_property
    def _table(self) -> tuple[int, str]:
        """Most labels of a rule, and the buckets as lines."""
        buckets: dict[int, list[str]] = {}
        labels = 0
        for rule in public_rules() if self._given is None else self._given:
            rule = rule.strip().lower()
            kind, name = PLAIN, rule
            if rule.startswith("!"):
                kind, name = EXCEPTION, rule[1:]
            elif rule.startswith("*."):
                kind, name = WILDCARD, rule[2:]
            name = _ascii(name)
            labels = max(labels, name.count(".") + 1)
            buckets.setdefault(zlib.crc32(name.encode()) % BUCKETS, []).append(kind + name)
        return labels, "\n".join(
            " " + " ".join(buckets.get(place, ())) + " " for place in range(BUCKETS))

    @property
    def labels(self) -> int:
        return self._table[0]

    def bucket(self, name: Column) -> Column:
        """The rules that share the bucket of `name`, as text."""
        place = F.pmod(F.crc32(name.cast("binary")), F.lit(BUCKETS)).cast("int")
        return F.get(F.split(F.lit(self._table[1]), "\n"), place)


DEFAULT_RULES = SuffixRules()


def load_suffix_rules(spark: SparkSession, path: str, max_rules: int | None = None) -> SuffixRules:
    """Read a public-suffix file; with `max_rules`, a longer one is refused."""
    lines = spark.read.text(path).select(F.trim("value").alias("rule"))
    rules = lines.filter((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    rows = (rules if max_rules is None else rules.limit(max_rules + 1)).collect()
    if max_rules is not None and len(rows) > max_rules:
        raise ValueError(f"suffix file has more than {max_rules} rules")
    return SuffixRules.parse(row.rule for row in rows)


def suffix_size(host: Column, rules: SuffixRules = DEFAULT_RULES) -> Column:
    """Number of labels in the public suffix of `host`, 0 when no rule matches."""
    exceptions, matches = [], [F.lit(0)]
    for size in range(1, rules.labels + 1):
        tail = F.substring_index(host, ".", -size)
        found = rules.bucket(tail)

        def holds(kind: str, tail: Column = tail, found: Column = found) -> Column:
            return found.contains(F.concat(F.lit(" " + kind), tail, F.lit(" ")))

        exceptions.append(F.when(holds(EXCEPTION), F.lit(size - 1)))
        matches.append(F.when(holds(PLAIN), F.lit(size)))
        matches.append(F.when(holds(WILDCARD) & (tail != host), F.lit(size + 1)))
    return F.coalesce(*exceptions, F.greatest(*matches))


def domain_under_suffix(host: Column, size: Column) -> Column:
    """One label below a public suffix of `size` labels, or null."""
    labels = F.split(host, r"\.")
    return F.when((size > 0) & (F.size(labels) > size), F.array_join(
        F.slice(labels, -(size + 1), size + 1), "."))


def name_label(host: Column, size: Column) -> Column:
    """The label just left of the suffix; the last label when there is no suffix."""
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > size, F.try_element_at(labels, F.size(labels) - size))


def subdomain(host: Column, size: Column) -> Column:
    """All labels left of the name label."""
    labels = F.split(host, r"\.")
    return F.array_join(
        F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - size - 1)), ".")


def registrable_domain(host: Column, rules: SuffixRules = DEFAULT_RULES) -> Column:
    """Registrable domain of a host; staged code passes the suffix size on instead."""
    return domain_under_suffix(host, suffix_size(host, rules))
