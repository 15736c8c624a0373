"""The pipeline's stages follow each other, and its entry is registered."""

import re
from collections import Counter

import pytest
from llm_cases import odd_texts, prose

import __spark_entry__ as entry
import corpus_pipeline
from contactgrid.llm.storage import Workspace


def corpus():
    made = [(n, prose(n, 80 + n % 90), f"s{n % 4}") for n in range(60)]
    made += [(100 + n, prose(7, 300), "copies") for n in range(20)]
    made += [(200 + n, f"{prose(500 + n, 90)}\nAll rights reserved by everyone here", "lines")
             for n in range(15)]
    made += [(300 + n, prose(800 + n, 90).upper(), "loud") for n in range(5)]
    return made + odd_texts()


@pytest.fixture(scope="module")
def steps(spark, make_docs):
    work = Workspace(spark)
    docs = work.keep(make_docs(corpus()), "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = work.keep(stage(spark, docs, ""), name)
        found.append(docs)
    return found


def test_columns_stay_until_the_last_stage(steps):
    assert all(step.columns == steps[0].columns for step in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]


def test_decisions_take_effect(steps):
    ids = [Counter(r.doc_id for r in step.select("doc_id").collect()) for step in steps[:-1]]
    raw, good, lines, single, mixed = ids
    assert all(300 + n not in good for n in range(5)) and all(n in good for n in range(60))
    assert lines == good
    text = {r.doc_id: r.text for r in steps[2].collect()}
    assert all("rights" not in text[200 + n] for n in range(15))
    assert [i for i in single if i is not None and 100 <= i < 120] == [100]
    assert all(n in single for n in range(60)) and max(single.values()) <= 2
    assert set(mixed) <= set(single)


def test_sequences_hold_the_mix(steps):
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in steps[4].collect())
    rows = steps[5].collect()
    assert sum(r.length for r in rows) >= words
    filled = Counter()
    for row in rows:
        filled[row.sequence_id] += row.length
    assert max(filled.values()) <= 4096
    assert len(filled) <= -(-sum(filled.values()) // 4096) + 2


def test_no_documents(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11))
    assert entry.queries()["pipeline"](spark, "/root/testdata/sf0.001").count() > 0
