"""Registered queries for whole documents, discovered envelopes and the shared target set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.functions import expr as X
from fleetlens.keys import K
from fleetlens.operators import activity as A
from fleetlens.operators import documents as D
from fleetlens.operators import inventory as INV
from fleetlens.operators import observations as O
from fleetlens.operators import rollups as R
from fleetlens.operators import statements as ST
from fleetlens.operators import status as SS
from fleetlens.operators import topn as T
from fleetlens.plans import queries as Q
from fleetlens.plans import queries_inventory as QI
from fleetlens.plans import queries_observations as QO
from fleetlens.plans.queries import query
from fleetlens.sources import envelopes as E
from fleetlens.sources import standins as V

DOC_PAGE_ROWS = 40
ENVELOPE_PAGE_ROWS = 500
MYSQL_VERSION, PG_VERSION = "5.7.34", "14.2"

# Items of the discovery queries: name -> (relation, order).
DISCOVERED = {
    "pg_index_all_fields": (V.pg_index, ["indexrelid"]),
    "events_statements_summary_by_digest": (V.mysql_digests, ["DIGEST", "FIRST_SEEN", "DIGEST_TEXT", "SCHEMA_NAME"]),
    "pg_stat_user_tables_all_fields": (V.pg_stat_user_tables, ["relid"]),
}


# ------------------------------------------------------- discovered envelopes --
def _landed(spark, d, *names):
    return E.pack([E.Item(n, DISCOVERED[n][0](spark, d), DISCOVERED[n][1]) for n in names], K, ENVELOPE_PAGE_ROWS)


@query("envelope_schema")
def q_envelope_schema(spark, d):
    """Columns and types found in the landed documents of three ``SELECT *`` items."""
    return E.envelope_schema(_landed(spark, d, *DISCOVERED))


def _round_trip(spark, d, name):
    docs = _landed(spark, d, name)
    return E.item_frames(docs)[name].drop("item", "page", "n_rows", "row_pos")


@query("index_catalog_round_trip")
def q_index_catalog_round_trip(spark, d):
    return _round_trip(spark, d, "pg_index_all_fields")


@query("digest_round_trip")
def q_digest_round_trip(spark, d):
    return _round_trip(spark, d, "events_statements_summary_by_digest")


@query("table_stats_round_trip")
def q_table_stats_round_trip(spark, d):
    return _round_trip(spark, d, "pg_stat_user_tables_all_fields")


# ---------------------------------------------------------------- documents ----
def _spine(frames, keys, version):
    rows = reduce(lambda a, b: a.unionByName(b), [f.select(*keys) for f in frames])
    return rows.distinct().withColumn("version", version)


def _server_version():
    """Version of the servers db0, db1, ...; PG_VERSION for the others."""
    n = F.substring("db_key", 3, 8).try_cast("int")
    listed = F.element_at(F.array(*[F.lit(v) for v in V.PG_VERSION_BY_MOD5]), (n % 5 + 1).cast("int"))
    return F.coalesce(F.when(F.col("db_key").rlike("^db[0-9]+$"), listed), F.lit(PG_VERSION))


@query("table_document")
def q_table_document(spark, d):
    """Tables and indexes of every server; the index half is missing where it failed."""
    targets = D.target_tables(V.pg_stat_user_tables(spark, d), Q.N_TABLES)
    indexes = D.target_indexes(V.pg_stat_user_indexes(spark, d), targets, Q.N_INDEXES)
    bloat = Q.QUERIES["bloat_ratio"](spark, d)
    spine = _spine([V.pg_snapshot_spine(spark, d), V.server_settings(spark, d)], D.DOC, F.lit(PG_VERSION))
    halves = {"tables": D.table_half(targets, V.pg_statio_user_tables(spark, d), V.pg_table_size_facts(spark, d), bloat),
              "indexes": D.index_half(indexes, V.pg_index(spark, d))}
    return D.documents(halves, spine, D.DOC, DOC_PAGE_ROWS, failed=V.failed_halves(spark, d))


@query("table_document_mysql")
def q_table_document_mysql(spark, d):
    targets = D.write_once(T.top_tables_mysql(V.mysql_tables(spark, d), Q.N_TABLES_MYSQL), "target_tables")
    sizes = D.write_once(T.top_indexes_mysql(V.mysql_index_stats(spark, d), targets, Q.N_INDEXES_MYSQL), "target_indexes")
    halves = {"tables": D.table_half_mysql(targets),
              "indexes": D.index_half_mysql(sizes, V.mysql_statistics(spark, d), V.mysql_index_usage(spark, d))}
    spine = _spine([V.pg_snapshot_spine(spark, d)], D.DOC, F.lit(MYSQL_VERSION))
    return D.documents(halves, spine, D.DOC, DOC_PAGE_ROWS, failed=V.failed_halves(spark, d))


@query("query_document")
def q_query_document(spark, d):
    """Most called statements; servers from version 13 on have other columns, and some have no statement source at all."""
    s = V.pg_stat_statements(spark, d)
    top = D.write_once(T.top_statements_pg(s, Q.N_STATEMENTS), "statements")
    new = X.version_at_least(F.col("server_version"), 13)
    names = [c for c in s.columns if c not in (*K, "server_version")]
    items = [E.Item("pg_stat_statements", top.filter(keep), ["rank"], [c for c in names if c != other])
             for keep, other in ((new, "mean_time"), (~new, "mean_exec_time"))]
    spine = _spine([V.pg_server_spine(spark, d)], D.DOC, _server_version())
    return D.documents({"queries": items}, spine, D.DOC, DOC_PAGE_ROWS, unknown=["pg_stat_statements"])


@query("query_document_mysql")
def q_query_document_mysql(spark, d):
    s = V.mysql_digests(spark, d)
    top = T.top_statements_mysql(s, Q.N_STATEMENTS)
    item = E.Item("events_statements_summary_by_digest", top, ["rank"], [c for c in s.columns if c not in K])
    spine = _spine([V.pg_server_spine(spark, d)], D.DOC, F.lit(MYSQL_VERSION))
    return D.documents({"queries": [item]}, spine, D.DOC, DOC_PAGE_ROWS)


@query("long_running_document")
def q_long_running_document(spark, d):
    """Long-running sessions; only servers from version 14 on have a query id."""
    lr = D.write_once(A.long_running_pg(V.pg_stat_activity(spark, d), Q.N_LONG_RUNNING, Q.LR_MINUTES_PG)
                      .withColumn("_version", _server_version()), "long_running")
    new = X.version_at_least(F.col("_version"), 14)
    names = [c for c in lr.columns if c not in (*K, "_version")]
    items = [E.Item("pg_stat_activity", lr.filter(new), ["query_start", "pid"], names),
             E.Item("pg_stat_activity", lr.filter(~new), ["query_start", "pid"], [c for c in names if c != "query_id"])]
    spine = _spine([V.pg_server_spine(spark, d)], D.DOC, _server_version())
    return D.documents({"sessions": items}, spine, D.DOC, DOC_PAGE_ROWS)


@query("long_running_document_mysql")
def q_long_running_document_mysql(spark, d):
    lr = A.long_running_mysql(V.mysql_current_statements(spark, d), Q.N_LONG_RUNNING, Q.LR_MINUTES_MYSQL)
    names = [c for c in lr.columns if c not in K]
    item = E.Item("events_statements_current", lr, ["TIMER_WAIT", "THREAD_ID", "EVENT_ID"], names)
    spine = _spine([V.pg_server_spine(spark, d)], D.DOC, F.lit(MYSQL_VERSION))
    return D.documents({"statements": [item]}, spine, D.DOC, DOC_PAGE_ROWS)


@query("schema_document")
def q_schema_document(spark, d):
    """L5 as the posted document (PostgreSQL): six items, the shared relations computed once."""
    frames = QI.pg_inventories(spark, d)
    items = [E.Item(k, frames[k], order, cols) for k, (cols, order) in QI.PG_SCHEMA_ITEMS.items()]
    spine = _spine([V.catalog_class(spark, d)], D.DOC, F.lit(PG_VERSION))
    return D.documents({"schema": items}, spine, D.DOC, DOC_PAGE_ROWS)


# The five MySQL inventories: item -> (relation, schema column, columns, order); ties by the following columns.
MYSQL_SCHEMA_ITEMS = {
    "columns": (V.mysql_columns, "TABLE_SCHEMA", INV.MYSQL_COLUMN_COLS,
                ["TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION"]),
    "indexes": (V.mysql_statistics, "TABLE_SCHEMA", INV.MYSQL_INDEX_COLS,
                ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "COLUMN_NAME"]),
    "foreign_keys": (V.mysql_referential_constraints, "CONSTRAINT_SCHEMA", INV.MYSQL_FK_COLS,
                     ["CONSTRAINT_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME"]),
    "tables": (V.mysql_tables, "TABLE_SCHEMA", INV.MYSQL_TABLE_SCHEMA_COLS, ["TABLE_SCHEMA", "TABLE_NAME"]),
    "views": (V.mysql_views, "TABLE_SCHEMA", INV.MYSQL_VIEW_COLS, ["TABLE_SCHEMA", "TABLE_NAME", "VIEW_DEFINITION"]),
}


@query("schema_document_mysql")
def q_schema_document_mysql(spark, d):
    items = [E.Item(k, INV.mysql_user_rows(rel(spark, d), schema, cols), order, cols)
             for k, (rel, schema, cols, order) in MYSQL_SCHEMA_ITEMS.items()]
    spine = _spine([V.pg_snapshot_spine(spark, d), V.mysql_columns(spark, d)], D.DOC, F.lit(MYSQL_VERSION))
    return D.documents({"schema": items}, spine, D.DOC, DOC_PAGE_ROWS)


# ---------------------------------------------------------- database documents --
def _named(df, **columns):
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def _whole(df):
    """Sums as whole numbers."""
    return df.select(*K, *[F.col(c).cast("bigint").alias(c) for c in df.columns if c not in K])


def _statement_list(latency):
    """(K, value): the statement list of a snapshot as JSON text; its length is bounded by the engine's setting."""
    rec = F.struct("queryid", "calls", "avg_time_ms")
    g = latency.groupBy(*K).agg(F.array_sort(F.collect_list(rec)).alias("_l"))
    return g.select(*K, F.to_json("_l").cast("variant").alias("value"))


def _keyed(df, category, view, key):
    cols = [c for c in df.columns if c not in K]
    long = D.long_values(df.withColumn("key", F.col(key).cast("string")), [*K, "key"], cols)
    return _named(long, category=category, view=view)


@query("db_document")
def q_db_document(spark, d):
    """C14: settings, metric tree, row counts, summary and parameters of every snapshot (PostgreSQL)."""
    bg = V.pg_stat_bgwriter(spark, d)
    one = bg.groupBy(*K).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in bg.columns if c not in K]))
                             .alias("_r")).filter("_n = 1").select(*K, "_r.*")      # A5: exactly one row
    views = _named(D.long_values(one, K, ["checkpoints_timed", "checkpoints_req"]), view="pg_stat_bgwriter")
    latency = ST.statement_latency_pg(V.pg_stat_statements(spark, d)).select(
        *K, "queryid", "calls", F.round(F.col("avg_time_ms") * 1000).cast("bigint").alias("avg_time_ms"))
    views = views.unionByName(_named(_statement_list(latency), view="pg_stat_statements", name="statements"))
    counters = [("database", "pg_stat_database", V.pg_stat_database, R.DB_COUNTERS),
                ("database", "pg_stat_database_conflicts", V.pg_stat_database, R.DB_CONFLICTS),
                ("table", "pg_stat_user_tables", V.pg_stat_user_tables, R.TABLE_COUNTERS),
                ("table", "pg_statio_user_tables", V.pg_statio_user_tables, R.TABLE_IO_COUNTERS),
                ("index", "pg_stat_user_indexes", V.pg_stat_user_indexes, R.INDEX_COUNTERS),
                ("index", "pg_statio_user_indexes", V.pg_stat_user_indexes, R.INDEX_IO_COUNTERS)]
    local = [_named(D.long_values(_whole(R.sum_counters(rel(spark, d), cols)), K, cols), category=cat, view=view,
                    key="aggregated") for cat, view, rel, cols in counters]
    vacuum = A.vacuum_activity(V.vacuum_activity_src(spark, d), V.vacuum_own_sessions(spark, d))
    progress = V.pg_stat_progress_vacuum(spark, d)
    local += [_keyed(vacuum, "process", "pg_stat_vacuum_activity", "pid"),
              _keyed(A.raw_view(progress, "pid", "ord"), "process", "pg_stat_progress_vacuum", "pid"),
              _keyed(A.vacuuming_tables(V.pg_stat_user_tables(spark, d), progress), "table", "pg_stat_vacuum_tables", "relid")]
    glob, tree = D.metric_tree(views, reduce(lambda a, b: a.unionByName(b), local))
    spine = _spine([V.pg_server_spine(spark, d), V.pg_snapshot_spine(spark, d)], K, _server_version())
    rows = R.row_count_distribution(V.pg_stat_user_tables(spark, d), Q.ROW_BOUNDS)
    knobs = V.knob_rows(spark, d)
    return D.db_documents(spine, SS.knob_snapshot(knobs), glob, tree, rows, SS.user_set_parameters(knobs))


@query("db_document_mysql")
def q_db_document_mysql(spark, d):
    """C14 of MySQL: status, engine and derived metrics; other sources' metrics win over equal names."""
    status = V.mysql_status(spark, d)
    counters = SS.status_counters(status)
    text = lambda df: df.select(*K, "name", F.col("value").cast("variant").alias("value"))
    merged = O.metric_source_merge(counters, {"cloudwatch": QO.external_metrics(spark, d)})
    innodb = SS.transaction_metrics(V.innodb_metrics(spark, d)).withColumnRenamed("count", "value")
    ratios = SS.derived_ratios(counters)
    replication = Q.QUERIES["replication_status"](spark, d)
    digests = ST.statement_latency_mysql(V.mysql_digests(spark, d)).select(
        *K, "queryid", "calls", F.round(F.col("avg_time_ms") * 1000).cast("bigint").alias("avg_time_ms"))
    parts = [_named(text(merged), category="global"), _named(text(innodb), category="innodb_metrics"),
             _named(D.long_values(ratios, K, ["buffer_miss_ratio", "read_write_ratio"]), category="derived"),
             _named(D.long_values(replication, K, ["replica_status", "master_status"]), category="engine"),
             _named(_statement_list(digests), category="performance_schema", name="events_statements_summary_by_digest")]
    glob = D.metric_tree_mysql(reduce(lambda a, b: a.unionByName(b), parts))
    spine = _spine([status, V.mysql_digests(spark, d), V.knob_rows(spark, d)], K, F.lit(MYSQL_VERSION))
    knobs = V.knob_rows(spark, d)
    return D.db_documents(spine, SS.knob_snapshot(knobs), glob, parameters=SS.user_set_parameters(knobs))


# ------------------------------------------------------------- column sets -----
@query("column_set_union")
def q_column_set_union(spark, d):
    """G1 without a column list: logical databases of three server versions land documents with their own columns;
    the union of the column sets is found in the documents, null where a version lacks a column (Q10)."""
    ts = V.pg_stat_user_tables(spark, d).select(*K, "relid", "relname", "n_live_tup", "n_dead_tup", "n_mod_since_analyze")
    ldb = F.col("logical_database_name")
    items = [E.Item("pg_stat_user_tables", ts.filter(ldb == "db0"), ["relid"]),
             E.Item("pg_stat_user_tables", ts.filter(ldb == "db1").drop("n_mod_since_analyze"), ["relid"]),
             E.Item("pg_stat_user_tables", ts.filter(~ldb.isin("db0", "db1")).drop("n_mod_since_analyze", "n_dead_tup"), ["relid"])]
    docs = E.pack(items, K, ENVELOPE_PAGE_ROWS)
    return E.item_frames(docs)["pg_stat_user_tables"].drop("item", "page", "n_rows", "row_pos")
