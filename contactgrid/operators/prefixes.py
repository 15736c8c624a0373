"""Rules found by prefix: equality on cut texts instead of a scan over all rules.

A text is cut at the lengths that occur among the rules, and the cuts are joined by equality. The
cost of a text grows with the number of different lengths, not with the number of rules, and the
join is an ordinary shuffled one whose hot keys the skew join can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules_of_prefixes(
    texts: DataFrame, rules: DataFrame, keys: Sequence[str], text: str, prefix: str,
    lengths: Column, **best: Column,
) -> DataFrame:
    """(keys, text, best..) of every distinct text that at least one rule starts.

    `rules` has the keys, `prefix` and what the aggregates in `best` read; it needs one row per
    keys and prefix to keep a text's matches as few as its lengths. `lengths` is the array of rule
    lengths to try for a row of `texts`. An empty prefix starts every text; null texts and null
    prefixes match nothing.
    """
    fitting = F.filter(lengths, lambda size: size <= F.length(text))
    cuts = texts.select(*keys, text, fitting.alias("__sizes")).distinct().select(
        *keys, text, F.explode("__sizes").alias("__size"))
    cuts = cuts.withColumn("__cut", F.substr(F.col(text), F.lit(1), F.col("__size")))
    found = cuts.join(rules.withColumnRenamed(prefix, "__cut"), [*keys, "__cut"])
    return found.groupBy(*keys, text).agg(*[value.alias(name) for name, value in best.items()])
