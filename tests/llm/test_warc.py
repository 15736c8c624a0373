"""WARC round trips and derived records."""

import gzip
import json

from contactgrid.llm import warc
from contactgrid.llm.storage import Workspace

PAGE = ("<html><head><title>A &amp; B</title><style>x{}</style></head><body><!-- no -->"
        "<p>One <b>two</b></p><script>var a='</p>';</script><a href='x'>three</a><br>fo&uuml;r")
PAGES = [
    (1, "http://a.example/x", PAGE, "x"), (1, "http://a.example/x", PAGE, "x"),
    (2, None, None, "x"), (3, "", "", "x"), (None, "http://b.example/ö", "<p>hi", "x"),
    (4, "http://c.example/a b\r\nWARC-Type: fake", "tricky\r\n\r\nWARC/1.1\r\nbody\r\n\r\n", "x"),
    (5, "http://d.example/", "<p>" + "long " * 60_000, "x"), (6, "http://e.example/", "< 3 <a", "x"),
]
SCHEMA = "page_id long, url string, html string, block string"


def test_responses_come_back_whole(spark):
    folder = Workspace(spark).path("responses")
    warc.write_responses(spark.createDataFrame(PAGES, SCHEMA), folder)
    rows = warc.read_records(spark, folder).collect()
    assert len(rows) == len(PAGES) and all(r.digest_ok and r.type == "response" for r in rows)
    payloads = sorted((r.page_id or 0, bytes(r.block).partition(b"\r\n\r\n")[2]) for r in rows)
    assert payloads == sorted((p[0] or 0, (p[2] or "").encode()) for p in PAGES)
    for row in rows:
        assert row.content_length == len(row.block)
        assert row.payload_digest == warc.digest(bytes(row.block).partition(b"\r\n\r\n")[2])
    targets = {r.page_id: r.target_uri for r in rows}
    assert targets[2] is None and targets[3] is None
    assert targets[4] == "http://c.example/a%20b%0D%0AWARC-Type:%20fake"


def test_derived_records_are_linked(spark):
    work = Workspace(spark)
    responses, derived = work.path("responses"), work.path("derived")
    warc.write_responses(spark.createDataFrame(PAGES, SCHEMA), responses)
    read = warc.read_records(spark, responses)
    warc.write_records(warc.derive_records(read), derived)
    sources = {r.record_id: r for r in read.collect()}
    rows = warc.read_records(spark, derived).collect()
    assert len(rows) == 2 * len(PAGES) and all(r.digest_ok for r in rows)
    for row in rows:
        source = sources[row.refers_to]
        assert (row.target_uri, row.date, row.page_id, row.payload_digest) == (
            source.target_uri, source.date, source.page_id, source.payload_digest)
        assert row.record_id not in sources
    text = {r.page_id: bytes(r.block).decode() for r in rows if r.type == "conversion"}
    assert text[1] == "A & B\nOne two\nthree\nfoür"
    assert text[2] == text[3] == "" and text[None] == "hi" and text[6] == "< 3 <a"
    assert len(text[5]) == 60_000 * 5 - 1
    facts = {r.page_id: json.loads(bytes(r.block)) for r in rows if r.type == "metadata"}
    assert facts[1]["title"] == "A & B" and facts[1]["n_links"] == 1
    assert facts[1]["warc_headers"]["WARC-Target-URI"] == "http://a.example/x"
    assert facts[1]["http_headers"]["Content-Type"] == "text/html; charset=utf-8"
    assert facts[2]["title"] is None


def test_no_pages(spark):
    folder = Workspace(spark).path("none")
    warc.write_responses(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_records(spark, folder).collect() == []
    assert warc.derive_records(warc.read_records(spark, folder)).collect() == []


def test_ids_are_stable():
    first = warc.response_text(1, "http://a.example", "x", warc.DATE)
    assert first == warc.response_text(1, "http://a.example", "x", warc.DATE)
    assert first != warc.response_text(2, "http://a.example", "x", warc.DATE)


def foreign_record(name, body, *more):
    head = [b"WARC/1.0", b"warc-type:response", b"WARC-Record-ID: " + name, *more,
            b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_foreign_files_of_many_members(spark, tmp_path):
    bodies = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x", b"", b"a\r\n\r\nb\r\n\r\n", b"\r\n\r\n",
              b"\xff\xfe\r\n\r\r\n\r\n\r\n", b"\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc",
              b"\r\n" * 50 + b"long " * 100_000]
    twice = b"WARC-Concurrent-To: <a>", b"WARC-Concurrent-To:\r\n <b>"
    with open(tmp_path / "a.warc.gz", "wb") as file:
        for n, body in enumerate(bodies):
            file.write(gzip.compress(foreign_record(b"<%d>" % n, body, *twice)))
    with open(tmp_path / "one.warc.gz", "wb") as file:
        file.write(gzip.compress(b"".join(foreign_record(b"<1%d>" % n, body)
                                          for n, body in enumerate(bodies))))
    with open(tmp_path / "b.warc", "wb") as file:
        file.write(b"\r\n" + b"".join(
            foreign_record(b"<2%d>" % n, body, b"WARC-Block-Digest: md5:x")
            for n, body in enumerate(bodies)))
    rows = {r.record_id: r for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert len(rows) == 3 * len(bodies)
    for n, body in enumerate(bodies):
        for name in (f"<{n}>", f"<1{n}>", f"<2{n}>"):
            assert bytes(rows[name].block) == body and rows[name].type == "response"
            assert rows[name].content_length == len(body) and rows[name].digest_ok is None
        assert rows[f"<{n}>"].headers["WARC-Concurrent-To"] == "<a>, <b>"
    texts = warc.derive_records(warc.read_records(spark, str(tmp_path))).collect()
    assert len(texts) == 2 * len(rows)
    direct = warc.derive_files(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in direct) == sorted(r.value for r in texts)
