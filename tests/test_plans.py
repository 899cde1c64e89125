"""Plan properties: pushdown / pruning at the scan, no Python in JVM-only queries."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"
# Queries whose operator needs Python inside tasks (pandas UDF / ML fit).
PYTHON_QUERIES = {"rfc2047", "rfc2047_words", "charset_guess", "topics", "mime_bodies"}
# Queries that run jobs while building (streams, checkpoints) are planned after those jobs.


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_date_filter_and_columns_reach_the_scan(spark):
    df = E.queries()["messages_per_day"](spark, SF)
    txt = df._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderdate" in txt
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in txt


def test_search_size_pushes_both_bounds(spark):
    txt = E.queries()["search_size"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in txt and "o_totalprice" in txt


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - PYTHON_QUERIES))
def test_no_python_in_plan(spark, name):
    # streams run while they are built; what they return is a read of their sinks at any size
    txt = plan_text(E.queries()[name](spark, SF_SMALL if name.startswith("stream_") else SF))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in txt, (name, node)


def test_searches_read_no_addresses(spark):
    from maillake.plans.registry import CATALOG

    for name in ("search_flag", "search_date", "search_size", "search_boolean", "since_date"):
        plan = CATALOG[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "c_name" not in plan and "s_name" not in plan, name
