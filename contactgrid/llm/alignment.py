"""Alignment of two tokenizers' tokens of one text, by coalescing byte intervals.

A text's tokens by vocabulary A (byte-level) and by B (pieces with byte fallback) are intervals of
the same bytes. All intervals are sorted by start; a running maximum of their ends shows where
groups break: where a start reaches the maximum of the ends before. Inside the groups, each A token
is linked with the B tokens whose intervals overlap its own.

How often an id pair is linked is counted over the whole corpus: sums in tasks first, then one
grouping. Documents keep their distinct linked pairs; their counts are looked up in a sorted array
that tasks share if there are at most `SHIPPED_PAIRS` of them, and joined otherwise.

Neither vocabulary joins a character with a blank or line feed after it, unless both are white
space, so a text is cut there, and an equal chunk is encoded and aligned once (a worker remembers a bounded number of
chunks). The two libraries do the encoding.

Edge cases: a null or empty text, and one whose tokens do not give its bytes back, have no tokens;
white space alone has tokens; a null doc_id is kept; equal rows have equal results; an empty table
gives no rows; very long texts are cut into chunks like others; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.wordids import byte_letters, ship_vocabulary
from contactgrid.sources.tables import read_table

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
#: White space of the vocabularies' regular expressions. Blanks and line feeds stand at the start of
#: a token only, so a text is cut before a run of white space that begins with one of them.
OTHER_SPACE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = " \n" + OTHER_SPACE
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{OTHER_SPACE}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")
#: Chunks, and characters of them, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 1 << 24
#: Characters of documents that are aligned at once; a longer document is taken alone.
TAKEN_CHARS = 1 << 20
#: Chunks whose bytes are compared with their tokens' at once, before any alone.
SPELLED = 1 << 10
#: Chunks that A's library takes as one text, and texts that it encodes at once: what it returns
#: holds far more than the ids.
JOINED, ENCODED = 1 << 6, 1 << 6
#: Pairs that a counting task holds before it sums them up.
COUNTED = 1 << 21
#: Largest number of id pairs whose counts (17 bytes each) are sent to all tasks.
SHIPPED_PAIRS = 1 << 21
#: A pair is one number: B's id times this, plus A's id.
PAIR = 1 << 20


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group of every A token, of every B token, and the linked (A token, B token) places.

    Both sides cover the same bytes without gaps.
    """
    starts, ends = np.r_[starts_a, starts_b], np.r_[ends_a, ends_b]
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.r_[True, starts[order][1:] >= reached[:-1]] if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(ends_b, starts_a, "right")
    many = np.searchsorted(starts_b, ends_a, "left") - first
    left = np.repeat(np.arange(len(starts_a)), many)
    right = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return group[:len(starts_a)], group[len(starts_a):], left, right


def sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sums of the first many[0] values, of the next many[1], and so on."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(many)
    return total[ends] - total[ends - many]


class Numbers(dict):
    """Numbers of chunks; one that is asked for first gets the next number and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.chars = 0
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self.chars += len(chunk)
        self[chunk] = number = len(self)
        return number


class Aligner:
    """Aligned chunks of texts, remembered up to a bound."""

    def __init__(self, byte_vocabulary: str, piece_model: bytes):
        self.a = Tokenizer.from_str(byte_vocabulary)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = {ord(letter): byte for byte, letter in byte_letters().items()}
        self.bytes_a: list[bytes] = [b""] * self.a.get_vocab_size(True)
        for token, number in self.a.get_vocab(True).items():
            self.bytes_a[number] = token.translate(letters).encode("latin-1") if all(
                ord(letter) in letters for letter in token) else token.encode()
        self.bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else
            piece.replace("▁", " ").encode() for number, piece in
            ((number, self.b.id_to_piece(number)) for number in range(self.b.get_piece_size()))]
        self.size_a = np.array([len(one) for one in self.bytes_a])
        self.size_b = np.array([len(one) for one in self.bytes_b])
        self.space = self.b.piece_to_id("▁")
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.words = [f"{number}{mark}" for mark in ",|;" for number in range(self.ids)]
        self.word_sizes = np.array([len(word) for word in self.words])
        self.forget()

    def forget(self) -> None:
        """Start anew with no chunks."""
        self.known = Numbers()
        #: Per chunk: its groups as the digest takes them, each with its closing mark.
        self.shown: list[bytes] = []
        #: Per chunk: sound (its tokens give it back), A tokens, B tokens, groups, links.
        self.facts = np.zeros((0, 5), np.int64)
        self.pairs = np.zeros(0, np.int64)

    def _pieces(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of chunks as they stand inside a text (the library adds a space in front)."""
        found = self.b.encode([chunk[1:] if chunk[0] == " " else chunk for chunk in chunks],
                              num_threads=1)
        for place, chunk in enumerate(chunks):
            if chunk == " ":
                found[place] = [self.space]
            elif chunk[0] != " ":
                ids = found[place]
                found[place] = ids[1:] if ids[:1] == [self.space] else []
        return found

    def _letters(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all chunks, and how many each has.

        The library takes texts of many chunks, at less than half the cost of as many texts. Those
        are cut again where the chunks' bytes end; a text whose tokens do not end there, and a chunk
        with white space at its end, which could join what follows, are encoded chunk by chunk.
        """
        alone = [chunk[0] not in " \n" or chunk[-1] in SPACE for chunk in chunks]
        texts, ends = [], []
        begin = 0
        for place in range(1, len(chunks) + 1):
            if place == len(chunks) or place - begin == JOINED or alone[place - 1] or alone[place]:
                texts.append("".join(chunks[begin:place]))
                ends.append(place)
                begin = place
        ids, many = [], []
        begin = 0
        for number, found in enumerate(self._encode(texts)):
            place, size = ends[number], self.size_a[found]
            bounds = np.searchsorted(np.cumsum(size), np.cumsum(sizes[begin:place])) + 1
            bounds = np.minimum(bounds, len(size))
            counts = np.diff(bounds, prepend=0)
            if bounds[-1] != len(size) or (sums(size, counts) != sizes[begin:place]).any():
                parts = list(self._encode(chunks[begin:place]))
                found, counts = np.concatenate(parts), np.array([len(one) for one in parts])
            ids.append(found)
            many.append(counts)
            begin = place
        return np.concatenate(ids), np.concatenate(many)

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for begin in range(0, len(texts), ENCODED):
            for found in self.a.encode_batch(
                    texts[begin:begin + ENCODED], add_special_tokens=False):
                yield np.array(found.ids, np.int64)

    def _sound(self, raws: list[bytes], sizes: np.ndarray,
               sides: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which chunks the bytes of both sides' tokens give back."""
        sound = np.ones(len(raws), bool)
        for table, table_sizes, flat, many in sides:
            ends = np.cumsum(many)
            sound &= sums(table_sizes[flat], many) == sizes
            for begin in range(0, len(raws), SPELLED):
                part = slice(begin, begin + SPELLED)
                first, last = ends[begin] - many[begin], ends[part][-1]
                spelled = b"".join(map(table.__getitem__, flat[first:last].tolist()))
                if spelled == b"".join(raws[part]):
                    continue
                for place, raw in enumerate(raws[part], begin):
                    ids = flat[ends[place] - many[place]:ends[place]].tolist()
                    sound[place] &= b"".join(map(table.__getitem__, ids)) == raw
        return sound

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks, all at once."""
        raws = [chunk.encode() for chunk in chunks]
        sizes = np.array([len(raw) for raw in raws])
        flat_a, many_a = self._letters(chunks, sizes)
        pieces = self._pieces(chunks)
        many_b = np.array([len(one) for one in pieces])
        flat_b = np.fromiter(chain.from_iterable(pieces), np.int64, many_b.sum())
        sound = self._sound(raws, sizes, [
            (self.bytes_a, self.size_a, flat_a, many_a),
            (self.bytes_b, self.size_b, flat_b, many_b)])
        if not sound.all():
            flat_a, flat_b = flat_a[np.repeat(sound, many_a)], flat_b[np.repeat(sound, many_b)]
            many_a, many_b = many_a * sound, many_b * sound
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        starts_a, starts_b = ends_a - self.size_a[flat_a], ends_b - self.size_b[flat_b]
        group_a, group_b, left, right = overlaps(starts_a, ends_a, starts_b, ends_b)
        chunk_a = np.repeat(np.arange(len(chunks)), many_a)
        groups = int(group_a[-1]) + 1 if len(group_a) else 0
        owner = np.zeros(groups, np.int64)
        owner[group_a] = chunk_a
        self.facts = np.r_[self.facts, np.stack([
            sound, many_a, many_b, np.bincount(owner, minlength=len(chunks)),
            np.bincount(chunk_a[left], minlength=len(chunks))], 1)]
        self.pairs = np.r_[self.pairs, flat_b[right] * PAIR + flat_a[left]]
        # One row of words in the digest's order: a group's A tokens, then its B tokens.
        before_b = np.searchsorted(group_b, np.arange(groups))
        upto_a = np.searchsorted(group_a, np.arange(groups), "right")
        words = np.empty(len(flat_a) + len(flat_b), np.int64)
        for flat, group, place, mark in (
                (flat_a, group_a, np.arange(len(flat_a)) + before_b[group_a], 1),
                (flat_b, group_b, np.arange(len(flat_b)) + upto_a[group_b], 2)):
            words[place] = flat + self.ids * np.where(np.diff(group, append=-1) != 0, mark, 0)
        row = "".join(map(self.words.__getitem__, words.tolist())).encode()
        lengths = np.cumsum(sums(self.word_sizes[words], many_a + many_b)).tolist()
        self.shown += [row[p:q] for p, q in zip([0, *lengths], lengths, strict=False)]

    def align(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, linked pairs, times) of each text."""
        if len(self.known) > REMEMBERED or self.known.chars > REMEMBERED_CHARS:
            self.forget()
        cut = [CHUNK.findall(" " + text) if text else [] for text in texts]
        places = [np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
                  for chunks in cut]
        if self.known.new:
            self.learn(self.known.new)
            self.known.new = []
        links = self.facts[:, 4]
        begins = np.cumsum(links) - links
        rows = []
        for place in places:
            facts = self.facts[place]
            if not len(place) or not facts[:, 0].all():
                rows.append((0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            many = facts[:, 4]
            at = np.arange(many.sum()) + np.repeat(begins[place] - np.cumsum(many) + many, many)
            shown = b"".join(map(self.shown.__getitem__, place.tolist()))[:-1]
            rows.append((*facts[:, 1:].sum(0).tolist(), hashlib.sha256(shown).hexdigest(),
                         *np.unique(self.pairs[at], return_counts=True)))
        return rows


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(byte_vocabulary, piece_model) -> Aligner:
    """This worker's aligner of the shipped vocabularies, built once a worker."""
    key = byte_vocabulary.value, piece_model.value
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long,"
           " groups_sha256 string, pairs array<long>, times array<long>")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def list_column(parts: list[np.ndarray]) -> pa.Array:
    bounds = np.r_[0, np.cumsum([len(part) for part in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(bounds, np.concatenate([*parts, np.zeros(0, np.int64)]))


def align_documents(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """`ALIGNED`: every document's counts, digest and distinct linked pairs; `row` numbers them."""
    context = docs.sparkSession.sparkContext
    shipped_a = ship_vocabulary(docs.sparkSession, byte_vocabulary)
    with open(piece_model, "rb") as file:
        shipped_b = context.broadcast(file.read())

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = size = 0
            for place in range(len(texts) + 1):
                if place == len(texts) or (size and size + len(texts[place]) > TAKEN_CHARS):
                    rows = aligner(shipped_a, shipped_b).align(texts[begin:place])
                    columns = list(zip(*rows, strict=True)) or [()] * 7
                    yield pa.record_batch([
                        pa.array(np.arange(number, number + len(rows))),
                        batch.column(0).slice(begin, len(rows)),
                        *(pa.array(column, pa.int64()) for column in columns[:4]),
                        pa.array(columns[4], pa.string()), list_column(list(columns[5])),
                        list_column(list(columns[6]))],
                        names=["row", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])
                    number += len(rows)
                    begin, size = place, 0
                if place < len(texts):
                    size += len(texts[place])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        align, ALIGNED)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair, n, best: how often each id pair is linked, and whether no other of its B id is more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ALIGNERS.clear()
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = least = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, times = (np.concatenate(part) for part in zip(*waiting, strict=True))
            names, place = np.unique(pairs, return_inverse=True)
            return names, np.bincount(place, times, len(names)).astype(np.int64)

        for batch in batches:
            waiting.append((batch.column(0).flatten().to_numpy(),
                            batch.column(1).flatten().to_numpy()))
            rows += len(waiting[-1][0])
            if rows > COUNTED + 2 * least:  # sum up once the new pairs outweigh those held
                waiting = [summed()]
                rows = least = len(waiting[0][0])
        if waiting:
            pairs, times = summed()
            yield pa.record_batch([pa.array(pairs), pa.array(times)], names=["pair", "n"])

    counts = aligned.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy(
        "pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("b", F.floor(F.col("pair") / F.lit(PAIR)))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias(
        "best"))


SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long,"
          " count_sum long, groups_sha256 string")


def look_up_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """`SCORED` by a sorted array of all pairs in every task; for a bounded number of pairs."""
    table = counts.orderBy("pair").toArrow()
    held = tuple(table.column(name).to_numpy() for name in ("pair", "n", "best"))
    shipped = aligned.sparkSession.sparkContext.broadcast(held)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ALIGNERS.clear()
        pairs, n, best = shipped.value
        for batch in batches:
            place = np.searchsorted(pairs, batch.column("pairs").flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy()
            bounds = np.r_[0, np.cumsum(pa.compute.list_value_length(
                batch.column("pairs")).to_numpy())]
            sums = [np.r_[0, np.cumsum(values)] for values in (
                np.where(best[place], times, 0), n[place] * times)]
            yield pa.record_batch([
                batch.column("doc_id"), *(batch.column(name) for name in COUNTS),
                *(pa.array(total[bounds[1:]] - total[bounds[:-1]]) for total in sums),
                batch.column("groups_sha256")],
                names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    return aligned.mapInArrow(score, SCORED)


def join_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join, for any number of pairs; hot pairs are left to the skew join."""
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = linked.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"),
        F.sum(F.col("n") * F.col("times")).alias("sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select(
        "doc_id", *COUNTS, F.coalesce("best", zero).alias("n_best"),
        F.coalesce("sum", zero).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, byte_vocabulary: str | None = None, piece_model: str | None = None,
          shipped_pairs: int = SHIPPED_PAIRS) -> DataFrame:
    """`SCORED` of every document."""
    work = Workspace(docs.sparkSession)
    aligned = work.keep(align_documents(
        docs, byte_vocabulary or public_tokenizers.path(BYTE_VOCABULARY),
        piece_model or public_tokenizers.path(PIECE_VOCABULARY)), "aligned")
    counts = work.keep(count_pairs(aligned), "pair-counts")
    score = look_up_counts if counts.count() <= shipped_pairs else join_counts
    return score(aligned, counts)


@register("op11_interval_alignment")
def op11_interval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of every document."""
    return align(read_table(spark, sf_dir, "documents"))
