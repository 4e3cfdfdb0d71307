"""Plan checks: no Python UDFs, WindowGroupLimit before ranks, pruned scans."""

import pytest

from ledgerlens.plans.catalog import QUERIES
from tests.conftest import SF001


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "ArrowAggregatePython", "ArrowWindowPython", "AggregateInPandas", "WindowInPandas",
                "PythonUDF", "PythonUDTF", "MapInPandas", "MapInArrow", "FlatMapGroupsIn", "FlatMapCoGroupsIn", "PythonMapInArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    text = plan_text(QUERIES[name](spark, SF001))
    for node in PYTHON_NODES:
        assert node not in text, f"{name} runs Python: {node}"


@pytest.mark.parametrize("name", ["first_incoming", "monthly_top_users", "monthly_funded_by"])
def test_window_group_limit(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(QUERIES[name](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in text


def test_fact_scan_is_pruned(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(QUERIES["monthly_activity"](spark, SF001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lineitem_scans = [line for line in text.splitlines() if "lineitem.parquet" in line]
    assert lineitem_scans
    for line in lineitem_scans:
        assert "l_shipdate" not in line and "l_returnflag" not in line and "l_tax" not in line


@pytest.mark.parametrize("name", ["monthly_activity", "monthly_top_users", "size_histogram", "first_incoming",
                                  "monthly_adoption", "monthly_summary", "monthly_funded_by"])
def test_facts_scanned_once(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("== Initial Plan ==")[0].splitlines()
             if "FileScan" in line and "lineitem" in line]
    assert len(scans) == 1, scans


def test_summary_has_few_exchanges(spark):
    plan = QUERIES["monthly_summary"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 6


@pytest.mark.parametrize("name", ["monthly_funded_by", "monthly_top_users"])
@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_top_lists_do_not_need_a_broadcast(spark, name, limit):
    """The same rows whether Spark may broadcast the list or has to shuffle it."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, limit)
        got = sorted(map(str, QUERIES[name](spark, SF001).collect()))
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted(map(str, QUERIES[name](spark, SF001).collect()))


def test_no_forced_broadcast_of_blocks_or_lists():
    import inspect

    from ledgerlens.operators import analyses, derive

    hinted = [line.strip() for module in (analyses, derive) for line in inspect.getsource(module).splitlines() if "F.broadcast(" in line]
    # the registry's slices, and bitmaps that are counted first
    assert all("slices" in line or "bitmaps" in line for line in hinted), hinted
