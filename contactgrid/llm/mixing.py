"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: the mix has `share` of all words; sources get it by weight, none more than `repeats`
   times its size, and what one cannot take is shared among the others by weight.
2. Schedule: slot n lies at the n-th point of the golden-ratio sequence; the source whose interval
   of the cumulative targets holds the point owns the slot. Any stretch of slots then has the
   sources near their targets. A source whose interval no point meets gets one slot at the end.
3. A source's slots are ranked; its documents, in an order given by a hash, form one long text that
   repeats; the target's words of that text are cut into as many equal blocks as the source has
   slots, and the slot of rank r takes block r.

Ranks and running sums inside a source come from totals per (source, chunk), with about as many
chunks as a chunk has rows: no source, however large, meets in one task. Sources have one row each
in a table that single-task windows sort.

Edge cases: a null or empty text has size 0 and nothing is taken; a null source is a source of its
own, last in order; equal rows take their own places; a null doc_id is kept; an empty table gives
no rows; very long documents span several blocks; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.words import words_of
from contactgrid.sources.tables import read_table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 1024
#: A prime and its golden section: multiples modulo the prime are the golden-ratio points.
POINTS, STEP = 2147483647, 1327217885
#: Equal parts of the unit interval through which points meet source intervals.
CELLS = 4096


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """`sizes` (source, source_size) with place, target, below (the targets of earlier sources).

    The level at which sources share evenly by weight follows from the sources sorted by how soon
    they are full: it is where the rest, spread over the remaining weights, fills none of them.
    """
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(by_name) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    step = sizes.withColumn("place", place).withColumn("weight", weight).withColumn(
        "full", (F.col("source_size") * repeats).cast("double"))
    step = step.withColumn("when_full", F.col("full") / F.col("weight")).withColumn(
        "words", F.sum("source_size").over(everyone) * F.lit(share))
    by_full = Window.orderBy("when_full", "place")
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    after = by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = step.withColumn("level", (
        F.col("words") - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") <= F.col("when_full"), F.col("level"))).over(everyone)
    target = F.least("full", F.coalesce(F.col("even") * F.col("weight"), F.col("full")))
    step = step.withColumn("even", level).withColumn("target", target)
    below = F.sum("target").over(Window.orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1))
    return step.select("source", "source_size", "place", "target",
                       F.coalesce(below, F.lit(0.0)).alias("below"))


def running(rows: DataFrame, amount: str, order: list[str], name: str) -> DataFrame:
    """`rows` with `name`: the sum of `amount` over earlier rows of the same `place`.

    `chunk` must grow with the order; a window holds one chunk of one place.
    """
    chunks = rows.groupBy("place", "chunk").agg(F.sum(amount).alias("chunk_sum"))
    earlier = Window.partitionBy("place").orderBy("chunk")
    bases = chunks.select("place", "chunk", (
        F.sum("chunk_sum").over(earlier) - F.col("chunk_sum")).alias("base"))
    inside = Window.partitionBy("place", "chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("inside", F.sum(amount).over(inside) - F.col(amount))
            .join(bases, ["place", "chunk"])
            .withColumn(name, F.col("base") + F.col("inside"))
            .drop("inside", "base", "chunk"))


def chunks_for(rows: int) -> int:
    """Chunks that hold about as many rows each as there are chunks."""
    return max(1, math.isqrt(rows) // 2)


def schedule_slots(spark: SparkSession, targets: DataFrame, words: float,
                   block_words: int) -> DataFrame:
    """slot, place, rank: which source each slot belongs to, and the slot's rank in it."""
    slots = max(1, math.ceil(words / block_words))
    point = (F.col("id") % POINTS * STEP % POINTS + F.lit(0.5)) / POINTS
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    low = F.col("below") / F.lit(words)
    high = (F.col("below") + F.col("target")) / F.lit(words)
    spans = targets.where("target > 0").select("place", low.alias("low"), high.alias("high"))
    cells = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    owned = points.join(cells, "cell").where("point >= low AND point < high").select(
        "slot", "place")
    chunk = F.floor(F.col("slot") / F.lit(-(-slots // chunks_for(slots))))
    ranked = running(owned.withColumn("one", F.lit(1).cast("long")).withColumn("chunk", chunk),
                     "one", ["slot"], "rank").select("slot", "place", "rank")
    unmet = spans.select("place").join(owned, "place", "left_anti").select(
        (F.col("place") + F.lit(slots)).alias("slot"), "place",
        F.lit(0).cast("long").alias("rank"))
    return ranked.union(unmet)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    repeats: int = REPEATS, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The documents' places and the mix.

    Places: doc_id, tie, source, size, place, source_size, target, at (words of the source before
    the document). Mix: slot, place, at, round, begin, end: each slot takes the words begin .. end
    of the document at (place, at), in the given round over the source.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    text = F.coalesce("text", F.lit(""))
    sized = work.keep(docs.select(
        "doc_id", F.xxhash64(text).alias("tie"), "source",
        F.size(words_of(text)).cast("long").alias("size")), "sizes")
    targets = work.keep(source_targets(sized.groupBy("source").agg(
        F.sum("size").alias("source_size")), weights, share, repeats), "targets")
    rows = sized.count()
    words = float(targets.agg(F.sum("target")).first()[0] or 0.0)
    order = F.xxhash64("doc_id", "tie", F.lit("order"))
    chunk = F.floor(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) * chunks_for(rows))
    shuffled = (sized.withColumn("order", order).withColumn("chunk", chunk)
                .join(targets.select(F.col("source").alias("name"), "place", "source_size",
                                     "target"), F.col("source").eqNullSafe(F.col("name")))
                .drop("name"))
    # unsigned order inside a chunk follows the chunk's own numbering
    places = work.keep(running(shuffled.withColumn(
        "order", F.shiftrightunsigned("order", 11)), "size", ["order", "doc_id", "tie"], "at")
        .drop("order"), "places")
    if not words:
        empty = "slot long, place int, at long, round long, begin long, end long"
        return places, spark.createDataFrame([], empty)
    slots = work.keep(schedule_slots(spark, targets, words, block_words), "slots")
    blocks = slots.groupBy("place").agg(F.count("*").alias("blocks"))
    goal = F.round("target").cast("long")
    turns = (places.where("size > 0").join(blocks, "place").withColumn("goal", goal)
             .withColumn("round", F.explode(F.array(*[
                 F.lit(turn).cast("long") for turn in range(math.ceil(repeats))]))))
    first = F.col("round") * F.col("source_size") + F.col("at")
    turns = turns.withColumn("first", first).withColumn(
        "last", F.least(F.col("first") + F.col("size"), "goal")).where("first < last")

    def bound(block: Column) -> Column:
        return F.when(block >= F.col("blocks"), F.col("goal")).otherwise(
            F.floor(block * (F.col("goal") / F.col("blocks"))))

    def block_of(word: Column) -> Column:
        near = F.floor(word / (F.col("goal") / F.col("blocks")))
        return F.when(bound(near + 1) <= word, near + 1).when(bound(near) > word, near - 1
                                                              ).otherwise(near)

    cut = turns.withColumn("rank", F.explode(F.sequence(
        block_of(F.col("first")), block_of(F.col("last") - 1))))
    spans = cut.select(
        "place", "rank", "at", "round",
        (F.greatest("first", bound(F.col("rank"))) - F.col("first")).alias("begin"),
        (F.least("last", bound(F.col("rank") + 1)) - F.col("first")).alias("end"))
    return places, spans.join(slots, ["place", "rank"]).select(
        "slot", "place", "at", "round", "begin", "end")


def taken_words(places: DataFrame, mixed: DataFrame) -> DataFrame:
    """`places` with the number of words that the mix takes from each document."""
    taken = mixed.groupBy("place", "at").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    with_words = places.where("size > 0").join(taken, ["place", "at"], "left")
    return with_words.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).unionByName(
        places.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of `docs`: one row per document and round.

    A document whose words are all taken keeps its text; one that the target's end cuts keeps its
    first words, single-spaced.
    """
    work = Workspace(docs.sparkSession)
    places, mixed = mix(docs)
    rounds = mixed.groupBy("place", "at", "round").agg(F.max("end").alias("words"))
    takes = work.keep(places.where("size > 0").join(rounds, ["place", "at"]).select(
        F.col("doc_id").alias("take_id"), F.col("tie").alias("take_tie"),
        F.col("source").alias("take_source"), "size", "words"), "takes")
    # rows equal in id, text and source are interchangeable: one of them stands for their takes
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"),
                        F.col("source").alias("from"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    whole = whole.dropDuplicates(["key", "tie", "from"])
    joined = whole.join(takes, F.col("key").eqNullSafe(F.col("take_id")) & (
        F.col("tie") == F.col("take_tie")) & F.col("from").eqNullSafe(F.col("take_source")))
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(
        words_of(F.col("row.text")), F.lit(1), F.col("words").cast("int")), " ")).otherwise(
            F.col("row.text"))
    fields = [text.alias("text") if name == "text" else F.col(f"row.`{name}`")
              for name in docs.columns]
    return joined.select(*fields)


@register("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from every document."""
    places, mixed = mix(read_table(spark, sf_dir, "documents"))
    return taken_words(places, mixed).select("doc_id", "size", "source_size", "target", "taken")
