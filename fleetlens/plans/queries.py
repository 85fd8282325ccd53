"""

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
stand-ins of ``fleetlens.sources.standins`` (whole tables, no sampling).
Parameters that the stand-ins need (limits, bounds, thresholds) are fixed
here and repeated verbatim in ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import expr as X
from fleetlens.functions.text import scrub_vacuum_query, truncate_status
from fleetlens.keys import K
from fleetlens.operators import activity as A
from fleetlens.operators import bloat as BL
from fleetlens.operators import rollups as R
from fleetlens.operators import statements as ST
from fleetlens.operators import status as SS
from fleetlens.operators import topn as T
from fleetlens.sources import standins as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the registered queries (sized for the stand-ins).
ROW_BOUNDS = (25, 30, 35, 40, 45)
N_TABLES, N_INDEXES = 10, 20
N_TABLES_MYSQL, N_INDEXES_MYSQL = 20, 30
N_STATEMENTS = 5
N_LONG_RUNNING, N_SAMPLE = 100, 5
LR_MINUTES_PG = 25 * 365 * 24 * 60          # the activity stand-in is measured in years
LR_MINUTES_MYSQL = 2
N_BLOAT_TABLES = 100
STATUS_HEAD, STATUS_TAIL = 5, 10
JSON_PAGE_ROWS = 50


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ D3 / F1 --
@query("row_count_distribution")
def q_row_count_distribution(spark, d):
    return R.row_count_distribution(V.pg_stat_user_tables(spark, d), ROW_BOUNDS,
                                    spine=V.pg_snapshot_spine(spark, d))


def _targets(spark, d):
    return T.top_tables(V.pg_stat_user_tables(spark, d), N_TABLES)


@query("top_tables")
def q_top_tables(spark, d):
    return _targets(spark, d)


@query("top_tables_missing_as_zero")
def q_top_tables_zero(spark, d):
    return T.top_tables(V.pg_stat_user_tables(spark, d), N_TABLES, count_missing_as_zero=True)


@query("target_semi")
def q_target_semi(spark, d):
    return T.target_semi(V.pg_statio_user_tables(spark, d), _targets(spark, d))


@query("table_stats_select")
def q_table_stats_select(spark, d):
    return T.target_semi(V.pg_stat_user_tables(spark, d), _targets(spark, d))


@query("table_sizes")
def q_table_sizes(spark, d):
    s = T.target_semi(V.pg_table_size_facts(spark, d), _targets(spark, d))
    return s.select(*K, "relid", "indexes_size", "relation_size",
                    (F.col("table_size") - F.col("relation_size")).alias("toast_size"))


def _top_indexes(spark, d):
    return T.top_indexes(V.pg_stat_user_indexes(spark, d), _targets(spark, d), N_INDEXES)


@query("top_indexes")
def q_top_indexes(spark, d):
    return _top_indexes(spark, d)


@query("index_stats_select")
def q_index_stats_select(spark, d):
    idx = V.pg_stat_user_indexes(spark, d).select(
        *K, "relid", "indexrelid", "schemaname", "relname", "indexrelname", "idx_scan", "idx_tup_read",
        "idx_tup_fetch")
    return T.target_semi(idx, _top_indexes(spark, d), on=K + ["indexrelid"])


@query("index_io_select")
def q_index_io_select(spark, d):
    io = V.pg_stat_user_indexes(spark, d).select(*K, "indexrelid", "idx_blks_read", "idx_blks_hit")
    return T.target_semi(io, _top_indexes(spark, d), on=K + ["indexrelid"])


@query("index_catalog_select")
def q_index_catalog_select(spark, d):
    return T.target_semi(V.pg_index(spark, d), _top_indexes(spark, d), on=K + ["indexrelid"])


# ------------------------------------------------------------------ MySQL top-n
def _targets_mysql(spark, d):
    return T.top_tables_mysql(V.mysql_tables(spark, d), N_TABLES_MYSQL)


@query("user_schemas_mysql")
def q_user_schemas_mysql(spark, d):
    return T.user_schemas_mysql(V.mysql_tables(spark, d)).select(*K, "TABLE_SCHEMA", "TABLE_NAME")


@query("nonempty_tables")
def q_nonempty_tables(spark, d):
    return V.mysql_tables(spark, d).filter(F.col("TABLE_ROWS") > 0).select(*K, "TABLE_SCHEMA", "TABLE_NAME",
                                                                           "TABLE_ROWS")


@query("top_tables_mysql")
def q_top_tables_mysql(spark, d):
    return _targets_mysql(spark, d)


@query("index_size_bytes")
def q_index_size_bytes(spark, d):
    return T.index_size_bytes(V.mysql_index_stats(spark, d))


def _top_indexes_mysql(spark, d):
    return T.top_indexes_mysql(V.mysql_index_stats(spark, d), _targets_mysql(spark, d), N_INDEXES_MYSQL)


@query("top_indexes_mysql")
def q_top_indexes_mysql(spark, d):
    return _top_indexes_mysql(spark, d)


@query("index_stats_select_mysql")
def q_index_stats_select_mysql(spark, d):
    return T.target_semi(V.mysql_statistics(spark, d), _top_indexes_mysql(spark, d),
                         on=K + ["DATABASE_NAME", "TABLE_NAME", "INDEX_NAME"],
                         left_on=K + ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME"])


@query("composite_semi")
def q_composite_semi(spark, d):
    usage = V.mysql_index_usage(spark, d).filter(F.col("OBJECT_TYPE") == "TABLE")
    return T.target_semi(usage, _top_indexes_mysql(spark, d),
                         on=K + ["DATABASE_NAME", "TABLE_NAME", "INDEX_NAME"],
                         left_on=K + ["OBJECT_SCHEMA", "OBJECT_NAME", "INDEX_NAME"])


# ------------------------------------------------------------------ statements
@query("top_statements_pg")
def q_top_statements_pg(spark, d):
    return T.top_statements_pg(V.pg_stat_statements(spark, d), N_STATEMENTS)


@query("top_statements_mysql")
def q_top_statements_mysql(spark, d):
    return T.top_statements_mysql(V.mysql_digests(spark, d), N_STATEMENTS)


@query("statement_latency_pg")
def q_statement_latency_pg(spark, d):
    return ST.statement_latency_pg(V.pg_stat_statements(spark, d))


@query("statement_latency_mysql")
def q_statement_latency_mysql(spark, d):
    return ST.statement_latency_mysql(V.mysql_digests(spark, d))


# ------------------------------------------------------------------ activity --
@query("long_running_pg")
def q_long_running_pg(spark, d):
    return A.long_running_pg(V.pg_stat_activity(spark, d), N_LONG_RUNNING, LR_MINUTES_PG)


@query("bounded_sample")
def q_bounded_sample(spark, d):
    return A.long_running_pg(V.pg_stat_activity(spark, d), N_SAMPLE, LR_MINUTES_PG)


@query("long_running_mysql")
def q_long_running_mysql(spark, d):
    return A.long_running_mysql(V.mysql_current_statements(spark, d), N_LONG_RUNNING, LR_MINUTES_MYSQL)


@query("exclude_self")
def q_exclude_self(spark, d):
    act = V.pg_stat_activity(spark, d).select(*K, "pid", "state", "query_start")
    return A.exclude_self(act, V.own_sessions(spark, d))


@query("vacuum_activity")
def q_vacuum_activity(spark, d):
    return A.vacuum_activity(V.vacuum_activity_src(spark, d), V.vacuum_own_sessions(spark, d))


@query("scrub_vacuum_query")
def q_scrub_vacuum_query(spark, d):
    src = V.vacuum_activity_src(spark, d)
    return src.select(*K, "pid", scrub_vacuum_query(F.col("query")).alias("query"))


@query("vacuum_progress")
def q_vacuum_progress(spark, d):
    return A.raw_view(V.pg_stat_progress_vacuum(spark, d), "pid", "ord")


@query("vacuuming_tables")
def q_vacuuming_tables(spark, d):
    return A.vacuuming_tables(V.pg_stat_user_tables(spark, d), V.pg_stat_progress_vacuum(spark, d))


# ------------------------------------------------------------------ counters --
def _db_spine(spark, d):
    return V.pg_stat_database(spark, d).select(*K).distinct()


@query("db_counters")
def q_db_counters(spark, d):
    return R.sum_counters(V.pg_stat_database(spark, d), R.DB_COUNTERS, _db_spine(spark, d))


@query("db_conflicts")
def q_db_conflicts(spark, d):
    return R.sum_counters(V.pg_stat_database(spark, d), R.DB_CONFLICTS, _db_spine(spark, d))


@query("table_counters")
def q_table_counters(spark, d):
    return R.sum_counters(V.pg_stat_user_tables(spark, d), R.TABLE_COUNTERS, V.pg_snapshot_spine(spark, d))


@query("table_io_counters")
def q_table_io_counters(spark, d):
    return R.sum_counters(V.pg_statio_user_tables(spark, d), R.TABLE_IO_COUNTERS, V.pg_snapshot_spine(spark, d))


@query("index_counters")
def q_index_counters(spark, d):
    return R.sum_counters(V.pg_stat_user_indexes(spark, d), R.INDEX_COUNTERS, V.pg_snapshot_spine(spark, d))


@query("index_io_counters")
def q_index_io_counters(spark, d):
    return R.sum_counters(V.pg_stat_user_indexes(spark, d), R.INDEX_IO_COUNTERS, V.pg_snapshot_spine(spark, d))


@query("extension_present")
def q_extension_present(spark, d):
    return R.extension_present(V.extensions(spark, d), spine=V.knob_rows(spark, d).select(*K).distinct())


# ------------------------------------------------------------------ key/value --
@query("knob_snapshot")
def q_knob_snapshot(spark, d):
    return SS.knob_snapshot(V.knob_rows(spark, d))


@query("knob_map")
def q_knob_map(spark, d):
    """A3 as the document's map: one JSON object of settings per snapshot."""
    return SS.pack_map(SS.knob_snapshot(V.knob_rows(spark, d))).select(*K, F.to_json("settings").alias("settings"))


@query("snapshot_round_trip")
def q_snapshot_round_trip(spark, d):
    """A relation written as a landed snapshot table and read back."""
    from fleetlens.sources.snapshots import read_snapshot, write_snapshot
    from fleetlens.streaming.streams import work_dir
    path = work_dir(spark, "snapshot_round_trip")
    write_snapshot(V.pg_stat_database(spark, d), path)
    return read_snapshot(spark, path)


@query("status_counters")
def q_status_counters(spark, d):
    return SS.status_counters(V.mysql_status(spark, d))


@query("transaction_metrics")
def q_transaction_metrics(spark, d):
    return SS.transaction_metrics(V.innodb_metrics(spark, d))


@query("derived_ratios")
def q_derived_ratios(spark, d):
    return SS.derived_ratios(SS.status_counters(V.mysql_status(spark, d)))


@query("user_set_parameters")
def q_user_set_parameters(spark, d):
    return SS.user_set_parameters(V.knob_rows(spark, d))


@query("single_row_view")
def q_single_row_view(spark, d):
    """A5: snapshots whose pg_stat_bgwriter does not have exactly one row."""
    return SS.single_row_view(V.pg_stat_bgwriter(spark, d), "pg_stat_bgwriter", V.pg_server_spine(spark, d)) \
        .select(*K, "view", "n_rows")


# ------------------------------------------------------------------ text -----
@query("truncate_status_text")
def q_truncate_status_text(spark, d):
    t = V.status_text(spark, d)
    return truncate_status(t, "text", "status", STATUS_HEAD, STATUS_TAIL).select("doc_id", "status")


# ------------------------------------------------------------------ scalars --
@query("parse_server_version")
def q_parse_server_version(spark, d):
    k = V.knob_rows(spark, d)
    v = F.col("server_version")
    return k.select(*K, "ord", v, X.mysql_version_text(v).alias("mysql_version"),
                    X.pg_version_text(v).alias("pg_version"))


@query("version_number")
def q_version_number(spark, d):
    k = V.knob_rows(spark, d)
    txt = X.pg_version_text(X.mysql_version_text(F.col("server_version")))
    return k.select(*K, "ord", X.version_major(txt).alias("major"), X.version_minor(txt).alias("minor"),
                    X.version_at_least(txt, 8, 0).alias("at_least_8_0"))


@query("version_gate")
def q_version_gate(spark, d):
    s = V.pg_stat_statements(spark, d)
    txt = X.pg_version_text(F.col("server_version"))
    return s.select(*K, "userid", "query",
                    X.version_at_least(txt, 13).alias("has_exec_time"),
                    X.version_at_least(txt, 14).alias("has_query_id"))


@query("engine_version_key")
def q_engine_version_key(spark, d):
    k = V.knob_rows(spark, d)
    v = X.mysql_version_text(X.pg_version_text(F.col("server_version")))
    major = X.version_major(v)
    engine = (F.when(F.col("server_version").contains("-log"), F.lit("aurora"))
              .when(major >= 9, F.lit("aurora-postgresql"))
              .when(F.col("ord") % 2 == 0, F.lit("mysql"))
              .otherwise(F.lit("postgres")))
    version = F.when(major == 9, F.lit("9.6.3")).otherwise(F.concat(v, F.lit("-mysql_aurora.1.22.2")))
    return k.select(*K, "ord", engine.alias("engine"), version.alias("version"),
                    X.engine_version_key(engine, version).alias("catalog_key"))


@query("object_prefix")
def q_object_prefix(spark, d):
    o = V.observation_log(spark, d)
    return o.select("id", X.object_prefix(F.col("organization_id"), F.col("db_key"), F.col("obs_type"),
                                          F.col("observation_time")).alias("object_key"))


@query("statement_key")
def q_statement_key(spark, d):
    s = V.pg_stat_statements(spark, d)
    m = V.mysql_digests(spark, d)
    pg = s.select(*K, F.lit("pg").alias("engine"), X.pg_statement_key("userid", "dbid", "queryid").alias("key"))
    my = m.select(*K, F.lit("mysql").alias("engine"), X.mysql_statement_key("SCHEMA_NAME", "DIGEST").alias("key"))
    return pg.unionByName(my)


@query("ps_to_ms")
def q_ps_to_ms(spark, d):
    m = V.mysql_current_statements(spark, d)
    return m.select(*K, "THREAD_ID", X.ps_to_ms(F.col("TIMER_WAIT")).alias("timer_wait_ms"),
                    (F.col("TIMER_WAIT") > X.minutes_to_ps(LR_MINUTES_MYSQL)).alias("over_threshold"))


@query("iso_timestamps")
def q_iso_timestamps(spark, d):
    e = V.agent_errors(spark, d)
    return e.select("error_id", X.iso_timestamp(F.col("timestamp")).alias("iso"),
                    X.space_timestamp(F.col("timestamp")).alias("text"))


@query("sentinel_to_null")
def q_sentinel_to_null(spark, d):
    a = V.catalog_attribute(spark, d)
    return a.select(*K, "attrelid", "attnum", X.sentinel_to_null(F.col("attstattarget")).alias("stats_target"))


@query("fillfactor")
def q_fillfactor(spark, d):
    c = V.bloat_class(spark, d)
    return c.select(*K, "oid", X.fillfactor(F.col("reloptions")).alias("fillfactor"))


@query("max_alignment")
def q_max_alignment(spark, d):
    s = V.server_settings(spark, d)
    return s.select(*K, X.max_alignment(F.col("version")).alias("ma"))


@query("drop_null_fields")
def q_drop_null_fields(spark, d):
    """Names of the non-NULL fields of each record, in column order."""
    io = V.pg_statio_user_tables(spark, d)
    cols = [c for c in io.columns if c not in K]
    m = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))]),
                     lambda k, v: v.isNotNull())
    return io.select(*K, "relid", F.array_join(F.map_keys(m), ",").alias("fields"))


# ------------------------------------------------------------------ bloat ----
def _bloat_inputs(spark, d):
    return (V.bloat_attribute(spark, d), V.bloat_class(spark, d), V.bloat_namespace(spark, d),
            V.bloat_stats(spark, d))


def _bloat_targets(spark, d):
    return T.top_tables(V.bloat_table_stats(spark, d), N_BLOAT_TABLES)


@query("bloat_ratio")
def q_bloat_ratio(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    return BL.table_bloat(att, cls, ns, st, V.server_settings(spark, d), _bloat_targets(spark, d))


@query("bloat_ratio_stepwise")
def q_bloat_ratio_stepwise(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    return BL.table_bloat_stepwise(att, cls, ns, st, V.server_settings(spark, d), _bloat_targets(spark, d))


@query("bloat_factors")
def q_bloat_factors(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    return BL.bloat_factors(att, cls, ns, st, V.server_settings(spark, d), _bloat_targets(spark, d))


@query("factor_stats_join")
def q_factor_stats_join(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    j = BL.factor_stats_join(att, cls, ns, st, _bloat_targets(spark, d))
    return j.select(*K, "relid", "attname", "attnum", "null_frac", "avg_width")


@query("column_width_join")
def q_column_width_join(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    return BL.column_width_join(att, cls, ns, st, _bloat_targets(spark, d))


@query("tuple_padding")
def q_tuple_padding(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    return BL.tuple_padding(BL.column_width_join(att, cls, ns, st))


@query("padding_default")
def q_padding_default(spark, d):
    att, cls, ns, st = _bloat_inputs(spark, d)
    tg = _bloat_targets(spark, d)
    f = BL.bloat_factors(att, cls, ns, st, V.server_settings(spark, d), tg)
    p = BL.tuple_padding(BL.column_width_join(att, cls, ns, st, tg))
    return BL.padding_default(f, p).select(*K, "relid", "padding")


@query("relation_kinds")
def q_relation_kinds(spark, d):
    c = V.bloat_class(spark, d)
    return c.filter(F.col("relkind").isin(*BL.BLOAT_RELKINDS)).select(*K, "oid", "relkind")


# ------------------------------------------------------------------ metrics --
METRIC_NOW = "2024-01-31 00:00:00"
METRIC_WINDOW_S, METRIC_PERIOD_S = 86400, 3600


@query("metric_minute_avg")
def q_metric_minute_avg(spark, d):
    return R.metric_period_avg(V.metric_samples(spark, d), 60)


@query("latency_histogram")
def q_latency_histogram(spark, d):
    return R.latency_histogram(V.metric_samples(spark, d), 0.01)


@query("latency_histogram_mysql")
def q_latency_histogram_mysql(spark, d):
    """D9 as MySQL serves it: buckets of statement timers in picoseconds, bounds scaled to ms."""
    st = V.mysql_current_statements(spark, d).select(*K, "TIMER_WAIT")
    hist = R.latency_histogram(st, keys=K, value="TIMER_WAIT")
    return R.histogram_ps_to_ms(hist)


@query("json_text")
def q_json_text(spark, d):
    """H8: the statement digests of each snapshot as JSON array text, in pages of
    at most about JSON_PAGE_ROWS records, ordered by queryid and first-seen time."""
    from fleetlens.functions.expr import mysql_statement_key, ps_to_ms
    from fleetlens.operators.observations import records_json
    dg = V.mysql_digests(spark, d)
    lat = dg.select(*K, mysql_statement_key("SCHEMA_NAME", "DIGEST").alias("queryid"),
                    F.col("COUNT_STAR").alias("calls"),
                    F.round(ps_to_ms(F.col("AVG_TIMER_WAIT")), 6).alias("avg_time_ms"), "FIRST_SEEN")
    return records_json(lat, ["queryid", "calls", "avg_time_ms"], ["queryid", "FIRST_SEEN"],
                        "events_statements_summary_by_digest", JSON_PAGE_ROWS)
