"""Every registered query against its SQL twin, and the driver contract."""

import pytest

import __spark_entry__ as entry
from crawlsift.plans import oracle, registry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"host", "pages", "links", "internal", "external", "nofollow", "max_links"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], FOLDER) == []


@pytest.mark.parametrize("name", ["links_classified", "seo_items", "asset_manifest", "jsonld_census", "page_rewrite", "inspection_report"])
def test_pages_are_lexed_once(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)[^<]++") == 1


@pytest.mark.parametrize("name", ["page_stats", "head_meta", "links_classified", "seo_items", "seo_summary", "asset_manifest", "page_rewrite",
                                  "dom_outline", "header_checks", "header_score", "cookies_masked"])
def test_page_audits_do_not_shuffle(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # a small table is spread over the cores at the scan, and that is all
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loops_or_cross_joins(spark, name):
    if name.endswith("_stream"):
        pytest.skip("runs the stream to build the result")
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
