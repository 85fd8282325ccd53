"""Registered queries for documents, catalogs, merges and time behaviour
(A1, A2, A7-A10, B21, C13-C15, G1, I1, I2, J1, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.keys import K
from fleetlens.operators import observations as O
from fleetlens.operators import rollups as R
from fleetlens.operators import status as SS
from fleetlens.operators import topn as T
from fleetlens.plans import registries as REG
from fleetlens.plans.queries import N_TABLES, ROW_BOUNDS, query
from fleetlens.sources import standins as V

TABLE_PAGE_ROWS = 1000
METRIC_NOW = "2024-01-30 23:47:13"      # not on a period's edge
METRIC_WINDOW_S, METRIC_PERIOD_S = 86400, 3600
HEARTBEAT_INTERVAL_S = 3600
AGENT_VERSION, ERROR_PAGE_ROWS = "0.2.1", 50
# The columns of the table statistics view.
PG_TABLE_COLUMNS = ["relid", "schemaname", "relname", "seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch",
                    "n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd", "n_live_tup", "n_dead_tup",
                    "n_mod_since_analyze", "last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze",
                    "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count"]
ENGINES = ["postgres", "mysql", "aurora-postgresql", "aurora", "aurora-mysql"]
ENGINE_VERSIONS = ["14.2", "8.0.28", "12.6", "5.6.mysql_aurora.1.22.2", "5.7.mysql_aurora.2.10.1"]


@query("envelope_explode")
def q_envelope_explode(spark, d):
    docs = V.envelope_documents(spark, d)
    rows = O.envelope_explode(docs, "supplier", "s_suppkey bigint, s_name string, s_nationkey int")
    return rows.select(*K, "item", "s_suppkey", "s_name", "s_nationkey")


@query("envelope_pack")
def q_envelope_pack(spark, d):
    tables = T.target_semi(V.pg_stat_user_tables(spark, d), T.top_tables(V.pg_stat_user_tables(spark, d), N_TABLES))
    return O.envelope_pack(tables, "pg_stat_user_tables_all_fields", PG_TABLE_COLUMNS, ["relid"], TABLE_PAGE_ROWS)


# ------------------------------------------------------------------ catalogs --
def _db_num(col="db_key"):
    return F.substring(F.col(col), 3, 8).cast("int")


def _pick(idx, values):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (idx + 1).cast("int"))


def _raw_catalog(spark, d):
    """Catalog entries derived from the metric samples: one JSON-shaped entry per
    (engine/version file, level, metric); entries of odd-length names use the
    key ``Metric`` instead of ``name`` (quirk Q1)."""
    from fleetlens.functions.expr import engine_version_key
    e = V.metric_samples(spark, d).select("db_key", "metric").distinct()
    n = _db_num()
    key = engine_version_key(_pick(n % 5, ENGINES), _pick(n % 5, ENGINE_VERSIONS))
    level_dir = F.when((F.length("metric") + n) % 3 == 0, F.lit("cloudwatch_metrics_cluster")) \
        .otherwise(F.lit("cloudwatch_metrics"))
    file = F.concat(F.lit("/catalog/"), level_dir, F.lit("/rds_"), key, F.lit(".json"))
    use_name = F.length("metric") % 2 == 0
    return e.select(F.when(use_name, F.col("metric")).alias("name"),
                    F.when(~use_name, F.col("metric")).alias("Metric"), file.alias("file"))


@query("metric_catalog")
def q_metric_catalog(spark, d):
    return O.normalize_catalog(_raw_catalog(spark, d))


def _instances(spark, d):
    s = V.metric_samples(spark, d).select("db_key").distinct()
    n = _db_num()
    return s.select("db_key", _pick(n % 5, ENGINES).alias("engine"), _pick(n % 5, ENGINE_VERSIONS).alias("version"),
                    F.when(n % 2 == 0, F.lit("cluster-1")).otherwise(F.lit("")).alias("cluster_id"))


@query("catalog_lookup")
def q_catalog_lookup(spark, d):
    return O.catalog_lookup(_instances(spark, d), O.normalize_catalog(_raw_catalog(spark, d)))


def wanted_metrics(spark, d):
    return O.catalog_lookup(_instances(spark, d), O.normalize_catalog(_raw_catalog(spark, d)))


@query("latest_metric")
def q_latest_metric(spark, d):
    return O.latest_metric(V.metric_samples(spark, d), wanted_metrics(spark, d), METRIC_NOW, METRIC_WINDOW_S, METRIC_PERIOD_S)


@query("metric_source_registry")
def q_metric_source_registry(spark, d):
    """Metric sources looked up by name (one entry, the cloud metric service)."""
    src = REG.METRIC_SOURCES["cloudwatch"]
    return src(spark, d, now=METRIC_NOW, window_s=METRIC_WINDOW_S, period_s=METRIC_PERIOD_S)


@query("row_postprocess_registry")
def q_row_postprocess_registry(spark, d):
    """Per-view row post-processing (one entry: the vacuum query scrub)."""
    v = V.vacuum_activity_src(spark, d).select(*K, "pid", "query")
    return v.transform(REG.ROW_POSTPROCESS["pg_stat_activity"])


# ------------------------------------------------------------------ heartbeat --
@query("agent_heartbeat")
def q_agent_heartbeat(spark, d):
    return O.agent_heartbeat(V.agent_errors(spark, d), V.agent_activity(spark, d), HEARTBEAT_INTERVAL_S)


@query("heartbeat_errors")
def q_heartbeat_errors(spark, d):
    return O.heartbeat_errors(V.agent_errors(spark, d), V.agent_activity(spark, d), HEARTBEAT_INTERVAL_S)


@query("heartbeat_document")
def q_heartbeat_document(spark, d):
    return O.heartbeat_document(V.agent_errors(spark, d), V.agent_activity(spark, d), AGENT_VERSION,
                                HEARTBEAT_INTERVAL_S, ERROR_PAGE_ROWS)


# ------------------------------------------------------------------ landing --
@query("observation_landing")
def q_observation_landing(spark, d):
    return O.landing_columns(V.observation_log(spark, d)).select(
        "organization_id", "db_key", "type_dir", "dt", "hr", "id", "object_key")


@query("observation_serialize")
def q_observation_serialize(spark, d):
    return O.serialize(V.observation_log(spark, d))


@query("hourly_latest")
def q_hourly_latest(spark, d):
    return O.hourly_latest(V.observation_log(spark, d))


# ------------------------------------------------------------------ merges --
def external_metrics(spark, d):
    """A second metric source keyed like the status counters (db_key = user id)."""
    from fleetlens.sources.tables import read_table
    e = read_table(spark, d, "events", "user_id", "event_type")
    g = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"),
                                 F.count(F.lit(1)).alias("n"))
    k = V.key(F.col("user_id").cast("string"))
    sel = g.select(*k, F.lit("com_select").alias("name"), (F.col("clicks") * 10).cast("string").alias("value"))
    cpu = g.select(*k, F.lit("cpuutilization").alias("name"), F.col("n").cast("string").alias("value"))
    return sel.unionByName(cpu)


@query("metric_source_merge")
def q_metric_source_merge(spark, d):
    base = SS.status_counters(V.mysql_status(spark, d))
    return O.metric_source_merge(base, {"cloudwatch": external_metrics(spark, d)})


@query("observation_assemble")
def q_observation_assemble(spark, d):
    """C14: DB-level document per snapshot (row stats + table and index counters)."""
    spine = V.pg_snapshot_spine(spark, d)
    rows = R.row_count_distribution(V.pg_stat_user_tables(spark, d), ROW_BOUNDS, spine=spine)
    tc = R.sum_counters(V.pg_stat_user_tables(spark, d), ["n_live_tup", "seq_scan", "idx_scan"])
    ic = R.sum_counters(V.pg_stat_user_indexes(spark, d), ["idx_scan", "idx_tup_read"])
    as_long = lambda df: df.select(*K, *[F.col(c).cast("bigint").alias(c) for c in df.columns if c not in K])
    doc = O.observation_assemble(spine, {"row_num_stats": rows, "table_counters": as_long(tc),
                                         "index_counters": as_long(ic)})
    return doc.select(*K, F.to_json(F.struct("row_num_stats", "table_counters", "index_counters")).alias("document"))


@query("logical_db_union")
def q_logical_db_union(spark, d):
    """G1: per-logical-database frames appended with their name (one lacks a column)."""
    ts = V.pg_stat_user_tables(spark, d).select(*K, "relid", "n_live_tup", "n_dead_tup")
    old = F.col("logical_database_name") == "db2"      # an older server whose view lacks a column
    return O.logical_db_union([ts.filter(~old), ts.filter(old).drop("n_dead_tup")])


@query("replication_status")
def q_replication_status(spark, d):
    """Replica and primary status JSON per MySQL snapshot, '' where none is reported."""
    st = V.mysql_status(spark, d)
    spine = st.select(*K).distinct()
    servers = V.replication_servers(spark, d)
    rep = servers.filter("n_signup > 0").select(*K, F.concat(F.lit("replica-"), "db_key").alias("Source_Host"),
                                                F.col("n").alias("Seconds_Behind_Source"))
    logs = servers.filter("n_purchase > 0").select(*K, F.concat(F.lit("binlog."), "db_key").alias("File"),
                                                   F.col("n").alias("Position"))
    return SS.replication_status(spine, rep, ["Source_Host", "Seconds_Behind_Source"], logs, ["File", "Position"])
