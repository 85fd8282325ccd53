"""Physical-plan properties that matter at scale (checked on sf0.001 plans)."""

import re

import pytest

from sf_paths import SF_SMALL
from fleetlens.plans.registry import all_queries

QUERIES = all_queries()
STREAMING = {"snapshot_counters_stream", "latest_metric_stream", "heartbeat_stream", "long_running_stream",
             "landing_stream"}
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_python_in_plan(spark, name):
    plan = _plan(spark, name)
    assert not any(p in plan for p in PYTHON_NODES), name


@pytest.mark.parametrize("name", ["top_tables", "top_indexes", "top_tables_mysql", "top_indexes_mysql",
                                  "top_statements_pg", "top_statements_mysql", "long_running_pg",
                                  "long_running_mysql"])
def test_top_n_limits_before_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(spark, "top_tables")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    lineitem = [s for s in schemas if "l_partkey" in s]
    assert lineitem and all("l_extendedprice" not in s and "l_orderkey" not in s for s in lineitem)


def test_filters_pushed_to_scan(spark):
    plan = _plan(spark, "heartbeat_errors")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,error\)", plan)


def test_flagship_joins_statistics_once(spark):
    fused = _plan(spark, "bloat_ratio")
    stepwise = _plan(spark, "bloat_ratio_stepwise")
    # one LEFT OUTER join with the column statistics instead of a LEFT and an INNER one
    assert fused.count("LeftOuter") < stepwise.count("LeftOuter") + stepwise.count("Inner")
    assert fused.count("Scan parquet") < stepwise.count("Scan parquet")


def test_large_limits_still_limit_before_shuffle(spark):
    from pyspark.sql import functions as F
    from fleetlens.operators import topn as T
    from fleetlens.sources import standins as V
    ts = V.pg_stat_user_tables(spark, SF_SMALL)
    top = T.top_n_per_key(ts, 10000, [F.col("n_live_tup").desc(), F.col("relid")], salt_by=["relid"])
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_schema_document_without_cross_or_self_join(spark):
    plan = _plan(spark, "schema_observation")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pages_are_ranges_of_the_order(spark):
    from pyspark.sql import functions as F
    from fleetlens.operators.observations import with_pages
    df = spark.range(25).select(F.lit("k").alias("k"), "id")
    pages = {r.page: r.ids for r in with_pages(df, ["id"], 10, ["k"]).groupBy("page").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    assert pages == {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}


def test_statistics_are_cut_to_the_target_tables_before_the_join(spark):
    plan = _plan(spark, "bloat_ratio")
    stats = plan[plan.index("attname"):]
    assert "LeftSemi" in stats and plan.count("Scan parquet") <= 12


def test_bloat_sorts_compare_what_tells_rows_apart_first(spark):
    """The snapshot key, equal in long runs of rows, comes last in the keys of large joins and groups."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(spark, "tuple_padding")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan)
    assert "relname" in joins and "attrelid" in joins and "organization_id" not in set(joins[:2])
    assert re.search(r"ObjectHashAggregate\(keys=\[(attrelid|relid)#", plan)
