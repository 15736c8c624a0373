"""What round 3's findings asked for: the last step of the pipeline's near-dedup."""

import re

import pytest
from llm_cases import odd_texts, prose
from pyspark.sql import functions as F

from contactgrid.llm.simhash import representatives

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def joined(spark):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield spark
    spark.conf.set(THRESHOLD, before)


def rooted_by_text(docs):
    """Every text is a group of its own."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", tie.alias("tie"), tie.alias("root"))


def test_texts_are_shuffled_once(joined, make_docs):
    docs = make_docs([(n, prose(n, 30), "a") for n in range(4)])
    kept = representatives(docs, rooted_by_text(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # the groups, the ids chosen, and the rows with their texts
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3, plan
    assert kept.count() == 4


def test_one_of_equal_rows_stays_by_the_join(joined, make_docs):
    texts = odd_texts() + [(0, prose(4, 70), "c"), (None, prose(50, 40), "a"), (0, "few", "a"),
                           (None, prose(50, 40), "b"), (None, "few", "b")]
    docs = make_docs(texts)
    kept = sorted((str(r.doc_id), r.text or "") for r in
                  representatives(docs, rooted_by_text(docs)).collect())
    smallest = {}
    for doc_id, text, _ in texts:
        own = (doc_id is None, doc_id)
        smallest[text or ""] = min(smallest.get(text or "", own), own)
    assert kept == sorted((str(i), text) for text, (_, i) in smallest.items())
