"""Every registered query against its SQL formulation on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools import check_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(FOLDER)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "source_url", "rank", "url", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert check_queries.compare(df, duck, ORACLES[name]) == []
    else:
        assert df.count() > 0
