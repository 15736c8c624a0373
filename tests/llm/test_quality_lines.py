"""Quality rules and line templates against direct computations."""

import random
import re

import duckdb
import pytest
from llm_cases import odd_texts

from contactgrid.llm import line_templates, quality


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, places = {}, set()
    for p in range(len(words) - 2):
        seen.setdefault(tuple(words[p:p + 3]), []).append(p)
    for spots in seen.values():
        if len(spots) > 1:
            places |= {p + k for p in spots for k in range(3)}
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(places), failed)


def test_measures_of_odd_documents(odd, none):
    rows = quality.judge(odd).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                  r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((i or 0, *measured(t)) for i, t, _ in odd_texts())
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality.judge(none).collect() == []


def test_kept_rows_keep_their_columns(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert ids == [0, 5, 5, 6, 7, 7, 9, 12]
    assert quality.keep_good(none).collect() == []


def test_each_rule_rejects(make_docs):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    junk = {
        "symbols": prose.replace(" ", "## "), "short": " ".join(f"{chr(97 + i % 26)}{i // 26}"
                                                                 for i in range(100)),
        "lines": "\n".join([*prose.split(), *["same line"] * 60]),
        "letters": " ".join(f"{i}{i + 7}" for i in range(100, 200)),
        "capitals": prose.upper(), "shouting": prose.replace(" ", "! "),
    }
    texts = [(0, prose, "a"), *((n + 1, text, "a") for n, text in enumerate(junk.values()))]
    kept = {r.doc_id for r in quality.judge(make_docs(texts)).collect() if r.kept}
    assert kept == {0}


def test_order_puts_the_best_rejecter_first(make_docs):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    docs = make_docs([(n, prose.upper() if n % 2 else prose, "a") for n in range(40)])
    assert quality.order_rules(docs)[0].name == "capitals"
    assert set(quality.order_rules(docs)) == set(quality.RULES)


BOILER = "All rights reserved by the publisher"


def template_docs():
    texts = []
    for n in range(14):
        body = [f"alpha{chr(97 + n)} beta gamma{chr(97 + n)} delta{chr(97 + n)} text",
                f"closing{chr(97 + n)} words of text {chr(97 + n)}"]
        if n < 12:  # a constant line, a line with a number, a line with a free word
            body += [BOILER, f"Page {n} of 99 printed today",
                     f"This copy belongs to our reader {chr(97 + n) * 5} since ever and forever"]
        texts.append((n, "\n".join(body), "a"))
    copy = "one copied line of prose\nanother copied line of prose\nlast copied line of it"
    return texts + [(100 + n, copy, "b") for n in range(30)]


def test_templates_go_and_copies_stay(make_docs):
    rows = {r.row.doc_id: r for r in line_templates.cleaned(make_docs(template_docs())).collect()}
    for n in range(12):
        assert rows[n].n_dropped == 3 and rows[n].n_lines == 5
        assert rows[n].text.count("\n") == 1 and BOILER not in rows[n].text
    assert rows[13].n_dropped == 0
    assert all(rows[100 + n].n_dropped == 0 for n in range(30))


def words_line(rng, many=8):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(many))


def test_copies_of_a_document_do_not_protect_a_template(make_docs):
    rng = random.Random(5)
    texts = [(n, "\n".join([words_line(rng), words_line(rng), BOILER]), "a") for n in range(14)]
    near = [words_line(rng) for _ in range(20)]
    for n in range(80):  # exact copies, then near ones, of two documents with the line
        texts.append((100 + n, texts[3][1], "b"))
        other = list(near)
        other[n % 20] = words_line(rng)
        texts.append((200 + n, "\n".join([*other, BOILER]), "b"))
    rows = {r.doc_id: r.text for r in line_templates.drop_templates(make_docs(texts)).collect()}
    for doc, text, _ in texts:
        assert rows[doc] == text.removesuffix(f"\n{BOILER}")


def test_three_hundred_copies_do_not_keep_a_line_in_the_query(make_docs):
    rng = random.Random(8)
    texts = [(n, "\n".join([words_line(rng), words_line(rng), BOILER]), "a") for n in range(20)]
    texts += [(100 + n, texts[3][1], "b") for n in range(300)]
    rows = line_templates.cleaned(make_docs(texts)).collect()
    assert len(rows) == 320
    assert all(r.n_dropped == 1 and BOILER not in r.text for r in rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [t[:2] for t in texts])
    assert sorted((r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows) == sorted(
        con.sql(line_templates.SQL).fetchall())


def test_a_block_of_shared_lines_goes_whole(make_docs):
    rng = random.Random(6)
    block = [words_line(rng) for _ in range(10)]
    own = ["\n".join(words_line(rng) for _ in range(5)) for _ in range(14)]
    docs = make_docs([(n, "\n".join([text, *block]), "a") for n, text in enumerate(own)])
    rows = {r.doc_id: r.text for r in line_templates.drop_templates(docs).collect()}
    assert [rows[n] for n in range(14)] == own


def test_a_template_needs_different_documents_not_lines(make_docs):
    rng = random.Random(7)
    text = "\n".join(f"this one document says over and over again {words_line(rng, 1)}"
                     for _ in range(15))
    docs = make_docs([(1, f"{text}\n{words_line(rng)}", "a"), (2, words_line(rng), "a")])
    rows = {r.doc_id: r.text for r in line_templates.drop_templates(docs).collect()}
    assert rows[1].startswith(text)


def test_a_document_of_templates_only_keeps_its_text(make_docs):
    texts = [*template_docs(), (500, f"{BOILER}\n\nPage 7 of 99 printed today", "c")]
    rows = {r.doc_id: r for r in line_templates.drop_templates(make_docs(texts)).collect()}
    assert rows[500].text == texts[-1][1]


def test_odd_documents_stay_as_they_are(odd, none):
    kept = line_templates.drop_templates(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert line_templates.drop_templates(none).collect() == []


@pytest.mark.parametrize("module,build", [
    (quality, lambda docs: quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")),
    (line_templates, lambda docs: line_templates.cleaned(docs).select(
        "row.doc_id", "text", "n_lines", "n_dropped")),
])
def test_sql_agrees_on_odd_documents(make_docs, module, build):
    texts = [*odd_texts(), *template_docs()]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [t[:2] for t in texts])
    df = build(make_docs(texts))
    expected = con.sql(module.SQL).project(", ".join(df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))
