"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A document stays if it passes the base rules and every rule of the cascade. The order of the
cascade cannot change that; it decides how much work rejected documents cost. `order_rules`
measures each rule on a bounded sample (share rejected, seconds spent) and puts the rule with the
most rejections per second first; a CASE expression then stops at the first rule that rejects.

Edge cases: a null, empty or blank text has no words and fails the base rules; equal rows are
judged each; an empty table gives no rows and the written order of the rules; very long texts are
judged whole; other columns of the input are kept by `keep_good` and not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.words import HAS_WORD, words_of
from contactgrid.sources.tables import read_table

MIN_WORDS = 50
#: Rows on which cost and selectivity are estimated; they decide an order, never a verdict.
SAMPLE_ROWS = 2000
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """`rejects` may use the columns of `measure` by name."""

    name: str
    rejects: Callable[[], Column]


def _share(pattern: str, but: str | None = None) -> Column:
    """Words that match `pattern` and not `but`."""
    def wanted(word: Column) -> Column:
        found = word.rlike(pattern)
        return found & ~word.rlike(but) if but else found

    return F.size(F.filter("q_words", wanted))


RULES = (
    Rule("symbols", lambda: F.col("n_symbols") * 10 > F.col("n_words")),
    Rule("word_length", lambda: ~F.col("word_chars").between(
        F.col("n_words") * 3, F.col("n_words") * 10)),
    Rule("repeated_lines", lambda: F.col("n_dup_lines") * 10 > F.col("q_lines") * 3),
    Rule("few_letters", lambda: _share(r"\p{L}") * 10 < F.col("n_words") * 6),
    Rule("capitals", lambda: _share(r"\p{Lu}", r"\p{Ll}") * 10 > F.col("n_words") * 3),
    Rule("shouting", lambda: F.regexp_count("q_text", F.lit("[!?]")) * 2 > F.col("n_words")),
)


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and
    helper columns q_*.

    Repeated windows are found per document: hashes of three words, sorted with their places, and
    kept where a neighbour is equal. Documents whose hashes are all distinct skip the sort.
    """
    named = ("q_text", "q_words", "q_lines", "q_hashes", "q_sorted", "n_words", "word_chars",
             "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in named]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("q_text"), "\n", -1), lambda line: line.rlike(HAS_WORD))
    step = docs.select(*kept, text.alias("q_text"))
    step = step.select("*", words_of(F.col("q_text")).alias("q_words"), lines.alias("q_kept"))
    step = step.select(
        *step.columns[:-1],
        F.size("q_words").cast("long").alias("n_words"),
        F.aggregate("q_words", F.lit(0).cast("long"), lambda total, word:
                    total + F.length(word)).alias("word_chars"),
        F.regexp_count("q_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("q_kept").cast("long").alias("q_lines"),
        (F.size("q_kept") - F.size(F.array_distinct("q_kept"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("q_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("q_words") - 3), lambda place: F.xxhash64(
                F.get("q_words", place), F.get("q_words", place + 1),
                F.get("q_words", place + 2)))).otherwise(
                    F.array().cast("array<bigint>")).alias("q_hashes"))
    repeats = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    step = step.select("*", F.when(repeats, F.sort_array(F.transform(
        "q_hashes", lambda value, place: F.struct(value.alias("h"), place.alias("i"))))).alias(
            "q_sorted"))

    def twin(entry: Column, place: Column) -> Column:
        before, after = F.get("q_sorted", place - 1), F.get("q_sorted", place + 1)
        return F.coalesce(entry["h"] == before["h"], F.lit(False)) | F.coalesce(
            entry["h"] == after["h"], F.lit(False))

    places = F.sort_array(F.transform(F.filter("q_sorted", twin), lambda entry: entry["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total")),
        lambda seen, place: F.struct(place.alias("last"), (
            seen["total"] + F.least(F.lit(3), place - seen["last"])).alias("total")),
        lambda seen: seen["total"])
    repeated = F.coalesce(covered, F.lit(0).cast("long"))
    step = step.select(
        *[c for c in step.columns if c not in ("q_hashes", "q_sorted")],
        repeated.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    step = step.withColumn("base_failed", failed)
    # a one-row inline: a filter above must not be rewritten into copies of all this
    made = [c for c in step.columns if c in named]
    return step.select(*kept, F.inline(F.array(F.struct(*made))))


def verdict(rules: tuple[Rule, ...]) -> Column:
    """Whether a measured document stays; evaluation stops at the first rule that rejects it."""
    checks = F.when(F.col("base_failed"), False)
    for rule in rules:
        checks = checks.when(rule.rejects(), False)
    return checks.otherwise(True)


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
) -> tuple[Rule, ...]:
    """`rules` by rejections per second on a sample of about `sample_rows` documents."""
    total = docs.count()
    if not total:
        return rules
    work = Workspace(docs.sparkSession)
    part = docs.select("text").sample(min(1.0, sample_rows / total), 7)
    sample = work.keep(measure(part).where(~F.col("base_failed")), "quality-sample")

    def timed(expression: Column) -> tuple[float, int]:
        best, found = float("inf"), 0
        for _ in range(2):
            begin = time.perf_counter()
            found = sample.agg(F.count_if(expression)).first()[0]
            best = min(best, time.perf_counter() - begin)
        return best, found

    idle, _ = timed(F.col("n_words") < 0)
    gains = {}
    for rule in rules:
        spent, rejected = timed(rule.rejects())
        gains[rule.name] = rejected / max(spent - idle, 1e-3)
    work.drop(sample)
    return tuple(sorted(rules, key=lambda rule: -gains[rule.name]))


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Measures of each document and `kept`."""
    rules = order_rules(docs, RULES, sample_rows)
    return measure(docs).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass, with the columns of `docs`."""
    rules = order_rules(docs, RULES, sample_rows)
    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return measure(packed).where(verdict(rules)).select("row.*")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
spots AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3),
windows AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, ws[p], ws[p + 1], ws[p + 2]) AS n FROM spots),
repeats AS (
  SELECT rid, count(DISTINCT q) AS n
  FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM windows WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{Lu}')
                                  AND NOT regexp_matches(x, '\p{Ll}'))) AS n_capitals,
    length(regexp_replace(t, '[^!?]', '', 'g')) AS n_shouts
  FROM w LEFT JOIN repeats r USING (rid)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_letters < 6 * n_words
    OR 10 * n_capitals > 3 * n_words OR 2 * n_shouts > n_words) AS kept
FROM b
"""


@register("op5_quality_rules", SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
