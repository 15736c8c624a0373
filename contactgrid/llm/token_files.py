"""Token-id files: frequency ranks in byte-aligned variable-length coding.

Layout of a folder written by `write_token_files`:

* `ranks`: one row per vocabulary entry that occurs: rank, token_id, occurrences. The most frequent
  id has rank 0, ties go to the smaller id.
* `documents`: one row per document in ascending doc_id order: shard (the file's place in that
  order), start_in_shard, doc_id, n_tokens, control, data. `data` holds each rank in its 1 to 4 low
  bytes; `control` holds the byte counts less one, two bits a value, four values a byte, the first
  value in the low bits. Control bytes stand apart from data bytes, so that a table of 256 entries
  gives the lengths of four values at once.

Edge cases: a null or empty text holds only the end id; equal doc_ids keep all their rows, ordered
by text hash; a null doc_id sorts first; an empty table gives empty files and no rows; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.llm.wordids import encoder, forget, ship_vocabulary, vocabulary_file
from contactgrid.sources.tables import read_table

ENCODED = "doc_id long, tie long, n_tokens long, width int, ids binary"
STORED = ("shard int, start_in_shard long, doc_id long, n_tokens long, control binary,"
          " data binary")
#: Lengths of the four values that a control byte stands for.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64)


def binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a binary column's values and all their bytes."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[
        column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return bounds - bounds[0], np.frombuffer(raw or b"", np.uint8)[bounds[0]:bounds[-1]]


def binary_column(bounds: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Binary column of the pieces of `raw` between `bounds`."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bounds of each document, and the place of each value among the padded codes."""
    bounds = np.r_[0, np.cumsum(-(-counts // 4))]
    ends = np.cumsum(counts)
    return bounds, np.arange(ends[-1] if len(ends) else 0) + np.repeat(
        bounds[:-1] * 4 - ends + counts, counts)


def pack_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data columns of documents that hold `counts` of the unsigned 32-bit `ranks`."""
    values = np.ascontiguousarray(ranks, "<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    bounds, places = _padded(counts)
    padded = np.zeros(bounds[-1] * 4, np.uint8)
    padded[places] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    passed = np.r_[0, np.cumsum(codes.astype(np.int64) + 1)]
    return (binary_column(bounds, control),
            binary_column(passed[np.r_[0, np.cumsum(counts)]], data))


def unpack_ranks(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """All values again: lengths by table lookup, then one gather for each byte place."""
    lengths = LENGTHS[binary_values(control)[1]].reshape(-1)[_padded(counts)[1]]
    starts = np.cumsum(lengths) - lengths
    raw = np.r_[binary_values(data)[1], np.zeros(1, np.uint8)]
    values = raw[starts].astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
    for place in range(1, 4):
        longer = np.flatnonzero(lengths > place)
        values[longer] |= raw[starts[longer] + place].astype(np.uint32) << np.uint32(8 * place)
    return values


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, tie, n_tokens, width, ids of each document; ids are little-endian, end id last."""
    shipped = ship_vocabulary(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = encoder(shipped)
            end = end_id.to_bytes(words.width, "little")
            ids = []
            for text in batch.column(2):
                ids.append(words.encode(text.as_py()) + end)
                words.make_room()
            yield pa.record_batch([
                batch.column(0), batch.column(1),
                pa.array([len(one) // words.width for one in ids], pa.int64()),
                pa.array([words.width] * len(ids), pa.int32()),
                pa.array(ids, pa.binary())], names=["doc_id", "tie", "n_tokens", "width", "ids"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(
        encode, ENCODED)


def stored_ids(widths: pa.Array, ids: pa.Array) -> np.ndarray:
    """All ids of a batch of encoded documents."""
    return binary_values(ids)[1].view(f"<u{widths[0].as_py()}")


def count_ids(encoded: DataFrame) -> DataFrame:
    """token_id, occurrences over all documents; tasks send their sums once, at their end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                found = np.bincount(stored_ids(batch.column(0), batch.column(1)),
                                    minlength=len(total))
                found[:len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                              names=["token_id", "occurrences"])

    parts = encoded.select("width", "ids").mapInArrow(count, "token_id long, occurrences long")
    return parts.groupBy("token_id").agg(F.sum("occurrences").alias("occurrences"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1) -> None:
    """Write `docs` (doc_id, text) as token-id files below `folder`.

    Texts are encoded once, into a table in shared storage that the count and the final coding
    read. The rank table has at most one row per vocabulary entry, so the driver may hold it.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    encoded = work.keep(encode_documents(docs, vocabulary, end_id), "encoded")
    counts = count_ids(encoded).collect()
    order = sorted(counts, key=lambda row: (-row.occurrences, row.token_id))
    spark.createDataFrame(
        [(rank, row.token_id, row.occurrences) for rank, row in enumerate(order)],
        "rank long, token_id long, occurrences long").coalesce(1).write.parquet(f"{folder}/ranks")
    ranks = np.zeros(1 + max((row.token_id for row in order), default=0), np.uint32)
    for rank, row in enumerate(order):
        ranks[row.token_id] = rank

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shard, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(1).to_numpy()
                control, data = pack_ranks(ranks[stored_ids(batch.column(2), batch.column(3))],
                                           counts)
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.record_batch([
                    pa.array(np.full(len(counts), shard), pa.int32()),
                    pa.array(starts, pa.int64()), batch.column(0), batch.column(1), control, data],
                    names=["shard", "start_in_shard", "doc_id", "n_tokens", "control", "data"])

    # ranges are found from the written table's keys alone, so nothing is coded twice
    (encoded.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
     .select("doc_id", "n_tokens", "width", "ids").mapInArrow(code, STORED)
     .write.option("compression", "zstd").parquet(f"{folder}/documents"))
    work.drop(encoded)


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """doc_id, start, n_tokens, control, data of the files, and the id of each rank.

    `start` counts the ids of all documents before: the shard's base plus the place in the shard.
    """
    order = spark.read.schema("rank long, token_id long").parquet(f"{folder}/ranks").collect()
    token_ids = np.zeros(max(1, len(order)), np.uint32)
    for row in order:
        token_ids[row.rank] = row.token_id
    stored = spark.read.schema(STORED).parquet(f"{folder}/documents")
    bases = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select(
        "shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return stored.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "control",
        "data"), token_ids


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array) of every document of the files."""
    stored, token_ids = _stored(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(2).to_numpy()
            ids = token_ids[unpack_ranks(batch.column(3), batch.column(4), counts)]
            yield pa.record_batch([
                batch.column(0), batch.column(1), batch.column(2),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()),
                                         pa.array(ids.astype(np.int64)))],
                names=["doc_id", "start", "n_tokens", "ids"])

    return stored.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids array<long>")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, and the crc32 of its decoded ids as
    little-endian 32-bit integers."""
    stored, token_ids = _stored(spark, folder)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            counts = batch.column(2).to_numpy()
            ids = token_ids[unpack_ranks(batch.column(3), batch.column(4), counts)].astype("<u4")
            ends = np.cumsum(counts)
            sums = [zlib.crc32(ids[end - count:end].data) for end, count in
                    zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token-id files, read them back, and return their checksums."""
    folder = Workspace(spark).path("token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary_file())
    return read_checksums(spark, folder)
