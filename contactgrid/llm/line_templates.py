"""Line dedup by a template tree of fixed depth, in DataFrame expressions only.

A line is parsed to words; words with a digit become `<*>`. The tree's first level is the number of
words, the next ones are the first `LEAD` words; a leaf collects the lines that agree on these. In a
leaf, a word that fewer than `min_docs` documents have at its place becomes `<*>` too, which turns
the lines of one pattern into one template. A template recurs, and its lines are dropped, if enough
of it is constant and at least `min_docs` different documents hold it.

Different documents are counted absolutely, however many copies there are besides: copies of a text
are one, and a document differs from its near copies by its own lines, those that fewer than
`min_docs` texts hold. If they are long enough for that (`OWN`), the smallest hash among them is the
document's sign, and if not, the smallest among its other lines, which near copies share. A template
recurs if its documents have at least `min_docs` signs.

Rules for the constant part: at least 3 constant words; with generalised places at least 5 constant
words and four fifths of all.

Edge cases: a document made of recurring lines only keeps its text (it is a copy, not boilerplate
in a document); lines without a word stay and separate nothing; equal lines of a document go or
stay together; a null text stays null; an empty table gives no rows; equal rows are treated alike;
a null doc_id is kept; very long lines are parsed whole. `drop_templates` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.words import HAS_WORD
from contactgrid.sources.tables import read_table

LEAD = 3
MIN_DOCS = 10
#: Own characters that set a document apart, as a share of the others: an eighth of k shared ones
#: on both sides is a similarity of k / (k + 2k/8), which is 0.8.
OWN = 8
WILD = "<*>"
#: Parts into which the rows of one line are dealt where they meet what is known of it.
SALTS = 16
#: A word with a digit, from its first character; possessive, so long words cost linear time.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def hashed(value: Column) -> Column:
    """60-bit number from a digest that other engines can compute too."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def masked(line: Column) -> Column:
    """A line with variable words replaced; most lines hold no digit and skip the search."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, WILD)).otherwise(line)


def single_spaced(line: Column) -> Column:
    """A line with blanks inside made single and those around it removed."""
    return F.trim(F.when(line.rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace(
        line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))


def lines_of(text: Column) -> Column:
    """Masked lines of a text, in order; lines without a word are empty."""
    return F.transform(F.transform(F.split(text, "\n", -1), masked), single_spaced)


def leaf_of(line: Column) -> Column:
    """The tree path of a masked line: number of words, then the first words."""
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.concat_ws(" ", (blanks + 1).cast("string"), F.substring_index(line, " ", LEAD))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, tie, branch, hash, line: one row per document and distinct masked line.

    `branch` is the hash of the line's tree path, `tie` that of the whole text.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.array_distinct(F.filter(lines_of(text), lambda line: line != ""))
    step = docs.select("doc_id", F.xxhash64(text).alias("tie"), F.explode(lines).alias("line"))
    return step.select("doc_id", "tie", F.xxhash64(leaf_of(F.col("line"))).alias("branch"),
                       hashed(F.col("line")).alias("hash"), "line")


def meet_lines(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """`rows` (tie, hash, ..) joined with one row per hash, a line's rows in `SALTS` parts."""
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    salted = rows.withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int"))
    return salted.join(known.withColumn("salt", salts), ["hash", "salt"], how).drop("salt")


def text_signs(once: DataFrame, held: DataFrame) -> DataFrame:
    """(tie, sign) of every text, from its lines and those that enough texts hold."""
    parts = meet_lines(once.select("tie", "hash", "chars"),
                       held.select("hash", F.lit(True).alias("held")), "left")
    own, other = F.col("held").isNull(), F.col("held").isNotNull()
    signs = parts.groupBy("tie").agg(
        F.sum(F.when(own, F.col("chars")).otherwise(0)).alias("own"),
        F.sum(F.when(other, F.col("chars")).otherwise(0)).alias("other"),
        F.min(F.when(own, F.col("hash"))).alias("own_sign"),
        F.min(F.when(other, F.col("hash"))).alias("other_sign"))
    return signs.select("tie", F.when(
        F.col("own") * OWN > F.col("other"), F.col("own_sign")).otherwise(
            F.col("other_sign")).alias("sign"))


def recurring_lines(work: Workspace, lines: DataFrame, min_docs: int) -> DataFrame:
    """`hash` of every line whose template recurs.

    Signs are counted on hashes alone. Branches below `min_docs` texts cannot hold a template and
    go before any text is shuffled; what is left is distinct lines before words are compared.
    """
    once = work.keep(lines.select("tie", "branch", "hash", F.length("line").alias("chars"))
                     .dropDuplicates(["tie", "hash"]), "text-lines")
    held = work.keep(once.groupBy("hash").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_docs).select("hash"), "held-lines")
    signs = work.keep(text_signs(once, held), "signs")
    branches = work.keep(once.groupBy("branch").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_docs).select("branch"), "branches")
    signed = work.keep(once.join(branches, "branch", "left_semi").join(signs, "tie").select(
        "hash", "sign").distinct(), "signed-lines")
    texts = lines.select("branch", "hash", "line").join(branches, "branch", "left_semi").select(
        "hash", "line").distinct()
    varied = signed.groupBy("hash").agg(F.count("*").alias("varied"))
    distinct = work.keep(texts.join(varied, "hash").select(
        leaf_of(F.col("line")).alias("leaf"), "hash", "line", "varied"), "distinct-lines")
    work.drop(once, held, signs, branches)
    placed = distinct.select("leaf", "hash", "varied", F.posexplode(
        F.split("line", " ", -1)).alias("place", "word"))
    common = placed.groupBy("leaf", "place", "word").agg(F.sum("varied").alias("n")).where(
        F.col("n") >= min_docs).select("leaf", "place", "word", F.lit(True).alias("common"))
    judged = placed.join(common, ["leaf", "place", "word"], "left").select(
        "leaf", "hash", "place", "word", F.coalesce("common", F.lit(False)).alias("common"))
    shape = F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "word", "common"))),
        lambda entry: F.when(entry["common"], entry["word"]).otherwise(WILD)), " ")
    templates = judged.groupBy("leaf", "hash").agg(
        shape.alias("template"),
        F.count_if(F.col("common") & (F.col("word") != WILD)).alias("constant"),
        F.count_if(~F.col("common") & (F.col("word") != WILD)).alias("wild"),
        F.count("*").alias("words"))
    fixed = (F.col("constant") >= 3) & ((F.col("wild") == 0) | (
        (F.col("constant") >= 5) & (F.col("constant") * 5 >= F.col("words") * 4)))
    kept = work.keep(templates.where(fixed).select("leaf", "hash", "template"), "templates")
    counted = signed.join(kept, "hash").select("leaf", "template", "sign").distinct()
    recurring = counted.groupBy("leaf", "template").agg(F.count("*").alias("varied")).where(
        F.col("varied") >= min_docs)
    return kept.join(recurring, ["leaf", "template"], "left_semi").select("hash").distinct()


def mark_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """row (struct of all columns), gone: `docs` with the hashes of its recurring lines."""
    work = Workspace(docs.sparkSession)
    lines = work.keep(line_table(docs), "lines")
    found = work.keep(recurring_lines(work, lines, min_docs), "recurring")
    gone = meet_lines(lines.select("doc_id", "tie", "hash"), found, "left_semi").groupBy(
        "doc_id", "tie").agg(F.collect_set("hash").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    return rows.join(gone, F.col("key").eqNullSafe(F.col("gone_id")) & (
        F.col("tie") == F.col("gone_tie")), "left").select("row", "gone")


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """row, text (without recurring lines), n_lines, n_dropped."""
    raw, text = F.col("row.text"), F.coalesce("row.text", F.lit(""))
    paired = F.when(F.col("gone").isNotNull(), F.arrays_zip(
        F.split(text, "\n", -1).alias("raw"), lines_of(text).alias("line")))
    step = mark_lines(docs, min_docs).select(
        "row", "gone", F.inline(F.array(F.struct(paired.alias("pairs")))))
    stay = F.filter("pairs", lambda pair: (pair["line"] == "") | ~F.array_contains(
        "gone", hashed(pair["line"])))
    step = step.select("row", "pairs", stay.alias("stay"))
    left = F.exists("stay", lambda pair: pair["line"] != "")
    cut = F.col("pairs").isNotNull() & left
    return step.select(
        "row",
        F.when(cut, F.array_join(F.col("stay")["raw"], "\n")).otherwise(raw).alias("text"),
        F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(HAS_WORD))).cast(
            "long").alias("n_lines"),
        F.when(cut, F.size("pairs") - F.size("stay")).otherwise(0).cast("long").alias(
            "n_dropped"))


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` without lines that enough different documents hold, columns as before."""
    fields = [F.col("text") if name == "text" else F.col(f"row.`{name}`")
              for name in docs.columns]
    return cleaned(docs, min_docs).select(*fields)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
raw AS (SELECT rid, unnest(string_split(text, chr(10))) AS raw_line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (
  SELECT rid, pos, raw_line, trim(regexp_replace(regexp_replace(
    raw_line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '{WILD}', 'g'),
    '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM raw),
u AS (SELECT min(rid) AS rid FROM d GROUP BY coalesce(text, '')),
h AS (
  SELECT DISTINCT rid, line, string_split(line, ' ') AS ws,
    ('0x' || substr(md5(line), 1, 15))::BIGINT AS hash
  FROM l SEMI JOIN u USING (rid) WHERE line <> ''),
o AS (SELECT *, count(*) OVER (PARTITION BY line) < {MIN_DOCS} AS own FROM h),
signs AS (
  SELECT rid, CASE
    WHEN coalesce(sum(length(line)) FILTER (own), 0) * {OWN}
      > coalesce(sum(length(line)) FILTER (NOT own), 0)
    THEN min(hash) FILTER (own) ELSE min(hash) FILTER (NOT own) END AS sign
  FROM o GROUP BY rid),
s AS (
  SELECT h.*, sign, len(ws)::VARCHAR || ' ' || array_to_string(ws[1:{LEAD}], ' ') AS leaf
  FROM h JOIN signs USING (rid)),
busy AS (SELECT leaf FROM s GROUP BY leaf HAVING count(*) >= {MIN_DOCS}),
lines AS (
  SELECT leaf, line, ws, count(DISTINCT sign) AS varied
  FROM s SEMI JOIN busy USING (leaf) GROUP BY ALL),
p AS (
  SELECT leaf, line, varied, unnest(ws) AS word, generate_subscripts(ws, 1) AS place
  FROM lines),
j AS (SELECT *, sum(varied) OVER (PARTITION BY leaf, place, word) >= {MIN_DOCS} AS common FROM p),
t AS (
  SELECT leaf, line,
    string_agg(CASE WHEN common THEN word ELSE '{WILD}' END, ' ' ORDER BY place) AS template,
    count(*) FILTER (common AND word <> '{WILD}') AS constant,
    count(*) FILTER (NOT common AND word <> '{WILD}') AS wild, count(*) AS words
  FROM j GROUP BY leaf, line),
f AS (SELECT * FROM t WHERE constant >= 3
        AND (wild = 0 OR (constant >= 5 AND constant * 5 >= words * 4))),
r AS (
  SELECT leaf, template FROM f JOIN s USING (leaf, line) GROUP BY leaf, template
  HAVING count(DISTINCT sign) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT line FROM f SEMI JOIN r USING (leaf, template)),
m AS (SELECT l.*, g.line IS NOT NULL AS gone FROM l LEFT JOIN gone g ON l.line = g.line),
per AS (
  SELECT rid, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_gone,
    bool_or(line <> '' AND NOT gone) AS lasting,
    string_agg(raw_line, chr(10) ORDER BY pos) FILTER (NOT gone) AS rest
  FROM m GROUP BY rid)
SELECT doc_id, CASE WHEN n_gone > 0 AND lasting THEN rest ELSE text END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(CASE WHEN lasting THEN n_gone ELSE 0 END, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN per USING (rid)
"""


@register("op6_line_templates", SQL)
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    return cleaned(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "text", "n_lines", "n_dropped")
