"""Whole documents: halves that fail alone, pages, empty items, the metric tree, one target set."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.keys import K
from fleetlens.operators import documents as D
from fleetlens.plans.registry import all_queries
from fleetlens.sources import standins as V
from fleetlens.sources.envelopes import Item
from sf_paths import SF_SMALL

DOC_SCHEMA = "organization_id string, db_key string, observation_time timestamp_ntz"


@pytest.fixture(scope="module")
def spine(spark):
    return spark.createDataFrame([("o", d) for d in ("a", "b", None)], "organization_id string, db_key string").selectExpr(
        "organization_id", "db_key", "timestamp_ntz'2024-01-31 00:00:00' AS observation_time", "'9.6' AS version")


def _rows(spine, db, n):
    one = spine.filter(F.col("db_key").eqNullSafe(db)).drop("version")
    return one.crossJoin(spine.sparkSession.range(n).withColumnRenamed("id", "x"))


def test_halves_pages_and_empty_items(spine):
    tables = _rows(spine, "a", 5).unionByName(_rows(spine, None, 1))
    indexes = _rows(spine, "a", 2).unionByName(_rows(spine, "b", 3))
    failed = spine.filter("db_key = 'b'").select(*D.DOC, F.lit("indexes").alias("half"))
    out = D.documents({"tables": [Item("t", tables, ["x"], ["x"])], "indexes": [Item("i", indexes, ["x"], ["x"])]},
                      spine, page_rows=2, failed=failed).collect()
    got = {(r.db_key, r.page): json.loads(r.document) for r in out}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0), (None, 0)}
    assert got["a", 0]["data"] == {"t": {"columns": ["x"], "rows": [[0], [1]]}, "i": {"columns": ["x"], "rows": [[0], [1]]}}
    assert got["a", 2]["data"] == {"t": {"columns": ["x"], "rows": [[4]]}}
    # The failed half is absent and the other one whole, though it has no rows.
    assert got["b", 0]["data"] == {"t": {"columns": ["x"], "rows": []}}
    assert got[None, 0]["data"]["t"]["rows"] == [[0]] and got[None, 0]["data"]["i"]["rows"] == []
    assert got["a", 0]["summary"] == {"version": "9.6", "observation_time": 1706659200}
    assert got["a", 0]["db_key"] == "a" and got["a", 0]["organization_id"] == "o"


def test_missing_source_is_an_empty_table(spine):
    items = [Item("s", _rows(spine, "a", 1), ["x"], ["x"])]
    got = {r.db_key: json.loads(r.document)["data"]["s"] for r in D.documents({"q": items}, spine, unknown=["s"]).collect()}
    assert got == {"a": {"columns": ["x"], "rows": [[0]]}, "b": {"columns": [], "rows": []}, None: {"columns": [], "rows": []}}


def test_variants_of_an_item_keep_their_columns(spine):
    old, new = _rows(spine, "a", 1), _rows(spine, "b", 1).withColumn("query_id", F.lit(7))
    got = {r.db_key: json.loads(r.document)["data"]["s"] for r in D.documents(
        {"q": [Item("s", old, ["x"], ["x"]), Item("s", new, ["x"], ["x", "query_id"])]}, spine).collect()}
    assert got["a"]["columns"] == ["x"] and got["b"] == {"columns": ["x", "query_id"], "rows": [[0, 7]]}


def _k(spark, *dbs):
    return spark.createDataFrame([("o", d, "l") for d in dbs], "organization_id string, db_key string, "
                                 "logical_database_name string").withColumn("observation_time", F.expr("timestamp_ntz'2024-01-31 00:00:00'"))


def test_metric_tree_and_database_document(spark):
    base = _k(spark, "a")
    num = lambda v: F.lit(v).cast("variant")
    views = base.withColumns({"view": F.lit("bg"), "name": F.lit("writes"), "value": num(3)})
    local = base.withColumns({"category": F.lit("table"), "view": F.lit("t"), "key": F.lit("aggregated"),
                              "name": F.lit("scans"), "value": num(1.5)})
    local = local.unionByName(base.withColumns({"category": F.lit("process"), "view": F.lit("p"), "key": F.lit("17"),
                                                "name": F.lit("phase"), "value": num("heap")}))
    glob, tree = D.metric_tree(views, local)
    spine = _k(spark, "a", "b").withColumn("version", F.lit("14.2"))
    knobs = base.withColumns({"name": F.lit("work_mem"), "setting": F.lit("4")})
    stats = base.withColumns({"num_tables": F.lit(2), "min_row_num": F.lit(None).cast("int")})
    names = base.withColumn("name", F.explode(F.array(F.lit("z"), F.lit("m"), F.lit("z"))))
    got = {r.db_key: json.loads(r.document) for r in D.db_documents(spine, knobs, glob, tree, stats, names).collect()}
    a = got["a"]
    assert a["metrics_data"] == {"global": {"bg": {"writes": 3}}, "local": {
        "database": {}, "table": {"t": {"aggregated": {"scans": 1.5}}}, "index": {}, "process": {"p": {"17": {"phase": "heap"}}}}}
    assert a["knobs_data"] == {"global": {"global": {"work_mem": "4"}}, "local": None}
    assert a["row_num_stats"] == {"num_tables": 2, "min_row_num": None} and a["non_default_knobs"] == ["m", "z"]
    assert got["b"]["metrics_data"]["local"] == {c: {} for c in D.PG_CATEGORIES} and got["b"]["knobs_data"]["global"] == {"global": {}}


def test_mysql_document_has_no_local_metrics(spark):
    base = _k(spark, "a")
    metrics = base.withColumns({"category": F.lit("derived"), "name": F.lit("r"), "value": F.lit(2).cast("variant")})
    spine = _k(spark, "a", "b").withColumn("version", F.lit("5.7"))
    knobs = base.withColumns({"name": F.lit("k"), "setting": F.lit("v")})
    got = {r.db_key: json.loads(r.document) for r in D.db_documents(spine, knobs, D.metric_tree_mysql(metrics)).collect()}
    assert got["a"]["metrics_data"] == {"global": {c: {"r": 2} if c == "derived" else {} for c in D.MYSQL_CATEGORIES}, "local": None}
    assert got["b"]["metrics_data"]["global"] == {c: {} for c in D.MYSQL_CATEGORIES}


def test_long_values_drop_null_fields_and_render_times(spark):
    df = spark.sql("select 1 k, cast(null as int) a, true b, timestamp_ntz'2024-01-01 00:00:00.25' t")
    got = {r.name: json.loads(r.v) for r in D.long_values(df, ["k"], ["a", "b", "t"]).select("name", F.to_json("value").alias("v")).collect()}
    assert got == {"b": True, "t": "2024-01-01T00:00:00.250000"}


def test_index_half_reads_the_target_set_and_the_catalog_only(spark, tmp_path):
    paths = {}
    for name, df in (("stats", V.pg_stat_user_indexes(spark, SF_SMALL)), ("catalog", V.pg_index(spark, SF_SMALL)),
                     ("tables", V.pg_stat_user_tables(spark, SF_SMALL))):
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    read = {k: spark.read.parquet(p) for k, p in paths.items()}
    targets = D.target_tables(read["tables"], 10)
    indexes = D.target_indexes(read["stats"], targets, 20)
    items = D.index_half(indexes, read["catalog"])
    plans = [i.df._jdf.queryExecution().executedPlan().toString() for i in items]
    assert sum(p.count("Scan parquet") for p in plans) - len(items) <= 1     # one scan of the written set each, one catalog
    assert not any(paths["stats"] in p or paths["tables"] in p for p in plans)
    assert len(items[2].names(K)) == 21 and items[2].names(K)[-1] == "logical_database_name"


def test_schema_document_plan(spark):
    plan = all_queries()["schema_observation"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 12 and "CartesianProduct" not in plan
