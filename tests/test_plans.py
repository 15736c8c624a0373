"""Shape of the physical plans that matter at scale."""

from pyspark.sql import functions as F

from contactgrid.operators import addresses, extraction, links, paging
from contactgrid.operators.keyed import top_per_key, winner_per_key
from contactgrid.plans import views
from contactgrid.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pages(spark):
    return read_table(spark, FOLDER, "pages")


def test_links_and_candidates_are_never_shuffled(spark):
    for df in (links.rank_pages(links.discover_links(pages(spark))),
               links.link_rows(links.discover_links(pages(spark))),
               extraction.candidate_rows(extraction.page_candidates(pages(spark))),
               extraction.page_outcomes(extraction.page_candidates(pages(spark))),
               addresses.classify_addresses(views.address_list(spark, FOLDER))):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text and "Pandas" not in text
        assert text.count("FileScan") == 1


def test_scans_are_pruned_and_filtered(spark):
    found = plan(paging.prefix_search(read_table(spark, FOLDER, "orders").select(
        "o_orderkey", "o_orderpriority"), "o_orderpriority", "1-U"))
    assert "StringStartsWith(o_orderpriority,1-U)" in found
    assert "struct<o_orderkey:bigint,o_orderpriority:string>" in found
    counts = plan(views.urls(spark, FOLDER).groupBy("status").count())
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in counts


def test_top_k_and_winners_shrink_before_the_shuffle(spark):
    rows = read_table(spark, FOLDER, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    top = plan(top_per_key(rows, ["l_orderkey"], [F.col("l_shipdate")], 3, "n"))
    assert top.index("WindowGroupLimit") < top.index("Exchange") < top.rindex("WindowGroupLimit")
    best = plan(winner_per_key(rows, ["l_orderkey"], [F.col("l_shipdate")]))
    assert "Window" not in best and "partial_min_by" in best


def test_keyset_page_is_a_top_k(spark):
    rows = read_table(spark, FOLDER, "orders").select("o_orderkey", "o_orderdate")
    text = plan(paging.keyset_page(rows, ["o_orderdate", "o_orderkey"], 10,
                                   after=[F.lit("1996-01-01").cast("timestamp_ntz"), 3]))
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(o_orderdate)" in text
