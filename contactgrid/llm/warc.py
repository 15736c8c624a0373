"""WARC files, and metadata and plain-text records derived from their responses.

Writing: a record is its header lines, an empty line and its block; two line ends close it. Spark's
text writer puts exactly these after every row, so a table of record texts written with that line
separator is a WARC file (gzip-compressed as a whole, at most `RECORDS_PER_FILE` records each).
Reading: compressed files come through Spark's text reader, cut at empty lines, so that a task holds
a record and not a file, and files may have any size and any number of gzip members (one for each
record is usual). Uncompressed files are read whole. Records are cut by Content-Length, so a block
may hold anything; SHA-1 digests are compared with the bytes, others are not judged (null). Header
names count whatever their case, folded lines are joined, values of a repeated name are joined by
commas, bytes that are no UTF-8 are replaced, a missing or wrong Content-Length counts as 0, and
what stands between records is passed over.

Deriving: each response gives a metadata record (JSON: the response's WARC and HTTP headers, title
and counts) and a conversion record (its visible text). Both refer to the response by its record
id, keep its target, date and page id, and carry its payload digest beside their own block digest.
Record ids are name-based, so a rerun gives the same ones; equal rows share them.

Edge cases: a null page is an empty payload with both derived records; a null or empty address has
no target header; blanks and control characters in addresses are percent-encoded, so that they end
no header; a null page_id has no page header; an empty table gives no rows; equal rows are written
each; very long pages are written whole; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactgrid.llm.queries import register
from contactgrid.llm.storage import Workspace
from contactgrid.session import ship_package
from contactgrid.sources.tables import read_table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
#: Stored pages carry no fetch time; a run names the one it stands for.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.NAMESPACE_URL
RECORD = ("record_id string, type string, date string, target_uri string, refers_to string,"
          " page_id long, content_type string, content_length long, block_digest string,"
          " payload_digest string, digest_ok boolean, headers map<string,string>, block binary")
NAMES = [field.split()[0] for field in RECORD.split(", ")]
KINDS = (*[pa.string()] * 5, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
         pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary())
#: Header names that are read, as they are written.
CANONICAL = {name.lower(): name for name in (
    "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To",
    "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length", "X-Page-ID")}
HEAD = re.compile(rb"WARC/[0-9]")
WHOLE = re.compile(r"-?[0-9]{1,18}")
LENGTH = re.compile(r"[0-9]+")
#: Bytes of blocks that are passed on at once.
BATCH_BYTES = 1 << 23
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)",
                    re.I | re.S)
BLOCKS = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|"
                    r"footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|"
                    r"title|body|html|head)\b[^<>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
LINK = re.compile(r"<a\s[^<>]*?\bhref\s*=", re.I)


def digest(raw: bytes) -> str:
    """Digest as WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    """Name-based record id."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def header_value(value: str) -> str:
    """`value` without anything that could end or split a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda found: f"%{ord(found[0]):02X}", value)


def record_text(headers: list[tuple[str, str | None]], block: str) -> str:
    """A record without its closing line ends."""
    raw = block.encode()
    lines = [VERSION, *(f"{name}: {value}" for name, value in headers if value is not None),
             f"WARC-Block-Digest: {digest(raw)}", f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + END + block


def response_text(page_id: int | None, url: str | None, page: str | None, date: str) -> str:
    """Response record of a stored page."""
    body = page or ""
    raw = body.encode()
    block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                         f"Content-Length: {len(raw)}"]) + END + body
    return record_text([
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), url or "", body)),
        ("WARC-Date", date), ("WARC-Target-URI", header_value(url) if url else None),
        ("X-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Payload-Digest", digest(raw)),
        ("Content-Type", "application/http; msgtype=response")], block)


def write_responses(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """Write pages (page_id, url, html) as response records."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([response_text(page_id, url, page, date) for
                                             page_id, url, page in zip(
                *(column.to_pylist() for column in batch.columns), strict=True)], pa.string())],
                names=["value"])

    ship_package(pages.sparkSession)
    write_records(pages.select("page_id", "url", "html").mapInArrow(build, "value string"), folder)


def write_records(records: DataFrame, folder: str) -> None:
    """Write a column of record texts as WARC files, compressed for speed."""
    records.write.option("lineSep", END).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse_headers(head: bytes) -> dict[str, str]:
    """Header fields of a record by canonical name."""
    fields: list[list[str]] = []
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1][1] = f"{fields[-1][1]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            fields.append([CANONICAL.get(name.strip().lower(), name.strip()), value.strip()])
    joined: dict[str, str] = {}
    for name, value in fields:
        joined[name] = f"{joined[name]}, {value}" if name in joined else value
    return joined


def record_row(headers: dict[str, str], block: bytes) -> tuple:
    """Row of `RECORD`."""
    page, stated = headers.get("X-Page-ID", ""), headers.get("WARC-Block-Digest")
    known = stated is not None and stated[:5].lower() == "sha1:" and len(stated) == 37
    return (headers.get("WARC-Record-ID"), headers.get("WARC-Type"), headers.get("WARC-Date"),
            headers.get("WARC-Target-URI"), headers.get("WARC-Refers-To"),
            int(page) if WHOLE.fullmatch(page) else None, headers.get("Content-Type"), len(block),
            stated, headers.get("WARC-Payload-Digest"),
            stated[5:].upper() == digest(block)[5:] if known else None, list(headers.items()),
            block)


class RecordCutter:
    """Records of one file from its pieces, which empty lines (`END`) divide."""

    def __init__(self):
        self.headers: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.missing = 0

    def add(self, piece: bytes) -> Iterator[tuple]:
        """Take the next piece; gives the row that it completes, if any."""
        if self.headers is None:
            start = HEAD.search(piece)
            if start is None:
                return
            self.headers = parse_headers(piece[start.start():])
            length = self.headers.get("Content-Length", "")
            self.missing = int(length) if LENGTH.fullmatch(length) else 0
            self.parts = []
            if not self.missing:
                yield from self.close()
        else:
            self.parts.append(piece)
            self.missing -= len(piece)
            if self.missing <= 0:
                rest = self.parts[-1][len(piece) + self.missing:]
                self.parts[-1] = piece[:len(piece) + self.missing]
                yield from self.close()
                if rest:  # files that close records with fewer line ends
                    yield from self.add(rest)
            else:  # the empty line belongs to the block
                self.parts.append(END.encode()[:self.missing])
                self.missing -= len(END)
                if self.missing <= 0:
                    yield from self.close()

    def close(self) -> Iterator[tuple]:
        """The row of what has been read of a record; also at the end of a file."""
        if self.headers is not None:
            yield record_row(self.headers, b"".join(self.parts))
            self.headers = None


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of `RECORD` for every record of one file's pieces."""
    cutter = RecordCutter()
    for piece in pieces:
        yield from cutter.add(piece)
    yield from cutter.close()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(KINDS)
    return pa.record_batch([pa.array(column, kind) for column, kind in
                            zip(columns, KINDS, strict=True)], names=NAMES)


def texts_batch(texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(texts, pa.string())], names=["value"])


def in_batches(items: Iterator, size_of: Callable, made: Callable) -> Iterator[pa.RecordBatch]:
    """Batches of at most 256 items and about `BATCH_BYTES` bytes."""
    waiting, size = [], 0
    for item in items:
        waiting.append(item)
        size += size_of(item)
        if len(waiting) == 256 or size > BATCH_BYTES:
            yield made(waiting)
            waiting, size = [], 0
    yield made(waiting)


def read_files(spark: SparkSession, folder: str, schema: str,
               made: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `made` makes of the records of a folder's `.gz` and `.warc` files, task by task."""

    def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pieces = (piece for batch in batches for piece in zip(
            *(column.to_pylist() for column in batch.columns), strict=True))
        for _, same in itertools.groupby(pieces, lambda piece: piece[0]):
            yield from parse_records(piece for _, piece in same)

    def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                yield from parse_records(iter(content.as_py().split(END.encode())))

    ship_package(spark)
    packed = (spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(folder)
              .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(folder)
    return packed.mapInArrow(lambda batches: made(packed_rows(batches)), schema).union(
        plain.select("content").mapInArrow(lambda batches: made(whole_rows(batches)), schema))


def read_records(spark: SparkSession, folder: str, with_blocks: bool = True) -> DataFrame:
    """Every record of a folder's `.gz` and `.warc` files.

    Without `with_blocks`, `headers` and `block` are null.
    """
    def made(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        shown = rows if with_blocks else ((*row[:-2], None, None) for row in rows)
        return in_batches(shown, lambda row: row[7] if with_blocks else 0, as_batch)

    return read_files(spark, folder, RECORD, made)


def visible_text(page: str) -> str:
    """Text of a page: blocks on lines of their own, entities decoded, blanks made single."""
    text = TAG.sub("", BLOCKS.sub("\n", HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def derived_texts(headers: dict[str, str], block: bytes) -> tuple[str, str]:
    """The metadata and the conversion record of a response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    page = payload.decode("utf-8", "replace")
    text = visible_text(page)
    title = TITLE.search(page)
    source = headers.get("WARC-Record-ID") or record_id("unnamed", digest(block))
    summary = json.dumps({
        "warc_headers": headers, "http_status": status,
        "http_headers": dict(line.split(": ", 1) for line in lines if ": " in line),
        "title": " ".join(entities.unescape(title[1]).split()) if title else None,
        "n_links": len(LINK.findall(page)), "n_text_chars": len(text)},
        ensure_ascii=False, sort_keys=True)

    def linked(kind: str, content_type: str, body: str) -> str:
        return record_text([
            ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)),
            ("WARC-Date", headers.get("WARC-Date")),
            ("WARC-Target-URI", headers.get("WARC-Target-URI")),
            ("WARC-Refers-To", source), ("X-Page-ID", headers.get("X-Page-ID")),
            ("WARC-Payload-Digest", headers.get("WARC-Payload-Digest")),
            ("Content-Type", content_type)], body)

    return (linked("metadata", "application/json", summary),
            linked("conversion", "text/plain; charset=utf-8", text))


def derive_records(records: DataFrame) -> DataFrame:
    """`value`: texts of the metadata and conversion records of all responses of a table."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield texts_batch([text for headers, block in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for text in derived_texts(dict(headers), block)])

    ship_package(records.sparkSession)
    return records.where("type = 'response'").select("headers", "block").mapInArrow(
        derive, "value string")


def derive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same straight from a folder's files: blocks stay in the task that reads them."""

    def made(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        texts = (text for row in rows if row[1] == "response"
                 for text in derived_texts(dict(row[-2]), row[-1]))
        return in_batches(texts, len, texts_batch)

    return read_files(spark, folder, "value string", made)


@register("op7_warc_derivatives")
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as responses, read, and derived; the derived files' records."""
    work = Workspace(spark)
    responses, derived = work.path("responses"), work.path("derived")
    write_responses(read_table(spark, sf_dir, "pages"), responses)
    write_records(derive_files(spark, responses), derived)
    return read_records(spark, derived, with_blocks=False).drop("headers", "block")
