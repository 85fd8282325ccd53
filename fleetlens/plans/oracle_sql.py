"""DuckDB oracle text for every registered query (same column names).

Each statement is self-contained over the parquet views the driver registers:
the stand-ins come in as CTEs from ``standin_sql``.  Parameters are those of
``fleetlens.plans.queries``.
"""

from __future__ import annotations

from fleetlens.plans import queries as Q
from fleetlens.plans.standin_sql import KCOLS, with_standins as W

ORACLES: dict[str, str] = {}
KC = KCOLS
KS = ", ".join(f"s.{c}" for c in KCOLS.split(", "))
KEQ = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in KCOLS.split(", "))


def _rank(order: str, keys: str = KC) -> str:
    return f"CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INTEGER)"


# ------------------------------------------------------------------ D3 / F1 --
def _buckets(bounds) -> str:
    names = ["num_tables_row_count_0_10k", "num_tables_row_count_10k_100k", "num_tables_row_count_100k_1m",
             "num_tables_row_count_1m_10m", "num_tables_row_count_10m_100m"]
    edges = [0, *bounds]
    out = [f"count_if(n_live_tup > {lo} AND n_live_tup <= {hi})::BIGINT AS {n}"
           for lo, hi, n in zip(edges, edges[1:], names)]
    out.append(f"count_if(n_live_tup > {edges[-1]})::BIGINT AS num_tables_row_count_100m_inf")
    return ",\n    ".join(out)


_BUCKET_COLS = ["num_tables", "num_empty_tables", "num_tables_row_count_0_10k", "num_tables_row_count_10k_100k",
                "num_tables_row_count_100k_1m", "num_tables_row_count_1m_10m", "num_tables_row_count_10m_100m",
                "num_tables_row_count_100m_inf"]

RCD_BODY = f"""
SELECT {KS}, {", ".join(f"coalesce(a.{c}, 0) AS {c}" for c in _BUCKET_COLS)}, a.max_row_num, a.min_row_num
FROM pg_snapshot_spine s LEFT JOIN (
  SELECT {KC}, count(*)::BIGINT AS num_tables, count_if(n_live_tup = 0)::BIGINT AS num_empty_tables,
    {_buckets(Q.ROW_BOUNDS)},
    max(n_live_tup) AS max_row_num, min(n_live_tup) AS min_row_num
  FROM pg_stat_user_tables GROUP BY ALL) a ON {KEQ("s", "a")}"""
ORACLES["row_count_distribution"] = W(RCD_BODY, "pg_snapshot_spine", "pg_stat_user_tables")


def _top_tables_sql(n: int, zero: bool = False, src: str = "pg_stat_user_tables") -> str:
    idx = "coalesce(idx_scan, 0)" if zero else "idx_scan"
    return f"""
SELECT {KC}, relid, rank FROM (
  SELECT {KC}, relid, {_rank(f"n_live_tup DESC, seq_scan + {idx} DESC, relid ASC")} AS rank
  FROM {src} WHERE n_live_tup + seq_scan + {idx} > 0) WHERE rank <= {n}"""


TT = ("tt", _top_tables_sql(Q.N_TABLES))

ORACLES["top_tables"] = W("SELECT * FROM tt", "pg_stat_user_tables", extra=[TT])
ORACLES["top_tables_missing_as_zero"] = W(_top_tables_sql(Q.N_TABLES, True), "pg_stat_user_tables")


def _semi(src: str, tgt: str, cols: list[tuple[str, str]], what: str = "t.*") -> str:
    cond = " AND ".join([KEQ("t", "g")] + [f"t.{a} = g.{b}" for a, b in cols])
    return f"SELECT {what} FROM {src} t WHERE EXISTS (SELECT 1 FROM {tgt} g WHERE {cond})"


ORACLES["target_semi"] = W(_semi("pg_statio_user_tables", "tt", [("relid", "relid")]),
                           "pg_statio_user_tables", "pg_stat_user_tables", extra=[TT])
ORACLES["table_stats_select"] = W(_semi("pg_stat_user_tables", "tt", [("relid", "relid")]),
                                  "pg_stat_user_tables", extra=[TT])
ORACLES["table_sizes"] = W(_semi("pg_table_size_facts", "tt", [("relid", "relid")],
                                 f"{', '.join('t.' + c for c in KC.split(', '))}, t.relid, t.indexes_size, "
                                 "t.relation_size, t.table_size - t.relation_size AS toast_size"),
                           "pg_table_size_facts", "pg_stat_user_tables", extra=[TT])

TI = ("ti", f"""
SELECT {KC}, indexrelid, index_size, rank FROM (
  SELECT t.*, {_rank("index_size DESC NULLS FIRST, indexrelid ASC")} AS rank
  FROM ({_semi("pg_stat_user_indexes", "tt", [("relid", "relid")])}) t) WHERE rank <= {Q.N_INDEXES}""")

ORACLES["top_indexes"] = W("SELECT * FROM ti", "pg_stat_user_indexes", "pg_stat_user_tables", extra=[TT, TI])
ORACLES["index_stats_select"] = W(
    _semi("pg_stat_user_indexes", "ti", [("indexrelid", "indexrelid")],
          f"{', '.join('t.' + c for c in KC.split(', '))}, t.relid, t.indexrelid, t.schemaname, t.relname, "
          "t.indexrelname, t.idx_scan, t.idx_tup_read, t.idx_tup_fetch"),
    "pg_stat_user_indexes", "pg_stat_user_tables", extra=[TT, TI])
ORACLES["index_io_select"] = W(
    _semi("pg_stat_user_indexes", "ti", [("indexrelid", "indexrelid")],
          f"{', '.join('t.' + c for c in KC.split(', '))}, t.indexrelid, t.idx_blks_read, t.idx_blks_hit"),
    "pg_stat_user_indexes", "pg_stat_user_tables", extra=[TT, TI])
ORACLES["index_catalog_select"] = W(_semi("pg_index", "ti", [("indexrelid", "indexrelid")]),
                                    "pg_index", "pg_stat_user_indexes", "pg_stat_user_tables", extra=[TT, TI])

# ------------------------------------------------------------------ MySQL top-n
_SYS = "('information_schema', 'performance_schema', 'mysql', 'sys')"
_MT_COLS = ("TABLE_SCHEMA, TABLE_NAME, TABLE_TYPE, ENGINE, ROW_FORMAT, TABLE_ROWS, AVG_ROW_LENGTH, "
            "DATA_LENGTH, INDEX_LENGTH, DATA_FREE")
TTM = ("ttm", f"""
SELECT {KC}, {_MT_COLS}, rank FROM (
  SELECT *, {_rank("TABLE_ROWS DESC, TABLE_SCHEMA, TABLE_NAME")} AS rank
  FROM mysql_tables WHERE lower(TABLE_SCHEMA) NOT IN {_SYS} AND TABLE_ROWS > 0) WHERE rank <= {Q.N_TABLES_MYSQL}""")

ORACLES["user_schemas_mysql"] = W(f"SELECT {KC}, TABLE_SCHEMA, TABLE_NAME FROM mysql_tables "
                                  f"WHERE lower(TABLE_SCHEMA) NOT IN {_SYS}", "mysql_tables")
ORACLES["nonempty_tables"] = W(f"SELECT {KC}, TABLE_SCHEMA, TABLE_NAME, TABLE_ROWS FROM mysql_tables "
                               "WHERE TABLE_ROWS > 0", "mysql_tables")
ORACLES["top_tables_mysql"] = W("SELECT * FROM ttm", "mysql_tables", extra=[TTM])

_SIZED = (f"SELECT {KC}, DATABASE_NAME, TABLE_NAME, INDEX_NAME, stat_value AS STAT_VALUE, "
          "stat_value * 16384 AS SIZE_IN_BYTE FROM mysql_index_stats WHERE stat_name = 'size'")
ORACLES["index_size_bytes"] = W(_SIZED, "mysql_index_stats")

TIM = ("tim", f"""
SELECT * FROM (
  SELECT t.*, {_rank("SIZE_IN_BYTE DESC, DATABASE_NAME, TABLE_NAME, INDEX_NAME")} AS rank
  FROM ({_semi(f"({_SIZED})", "ttm", [("DATABASE_NAME", "TABLE_SCHEMA"), ("TABLE_NAME", "TABLE_NAME")])}) t)
WHERE rank <= {Q.N_INDEXES_MYSQL}""")

ORACLES["top_indexes_mysql"] = W("SELECT * FROM tim", "mysql_index_stats", "mysql_tables", extra=[TTM, TIM])
ORACLES["index_stats_select_mysql"] = W(
    _semi("mysql_statistics", "tim", [("TABLE_SCHEMA", "DATABASE_NAME"), ("TABLE_NAME", "TABLE_NAME"),
                                      ("INDEX_NAME", "INDEX_NAME")]),
    "mysql_statistics", "mysql_index_stats", "mysql_tables", extra=[TTM, TIM])
ORACLES["composite_semi"] = W(
    _semi("(SELECT * FROM mysql_index_usage WHERE OBJECT_TYPE = 'TABLE')", "tim",
          [("OBJECT_SCHEMA", "DATABASE_NAME"), ("OBJECT_NAME", "TABLE_NAME"), ("INDEX_NAME", "INDEX_NAME")]),
    "mysql_index_usage", "mysql_index_stats", "mysql_tables", extra=[TTM, TIM])

# ------------------------------------------------------------------ statements
ORACLES["top_statements_pg"] = W(f"""
SELECT * FROM (SELECT *, {_rank("calls DESC, userid, dbid, query, queryid NULLS FIRST")} AS rank FROM pg_stat_statements)
WHERE rank <= {Q.N_STATEMENTS}""", "pg_stat_statements")
ORACLES["top_statements_mysql"] = W(f"""
SELECT * FROM (SELECT *, {_rank("COUNT_STAR DESC, DIGEST ASC NULLS FIRST, FIRST_SEEN, DIGEST_TEXT")} AS rank
  FROM mysql_digests) WHERE rank <= {Q.N_STATEMENTS}""", "mysql_digests")

_PGV = "split_part(server_version, ' ', 1)"
_MAJ = f"TRY_CAST(split_part({_PGV}, '.', 1) AS INTEGER)"
_MIN = f"coalesce(TRY_CAST(nullif(split_part({_PGV}, '.', 2), '') AS INTEGER), 0)"


def _at_least(major: int, minor: int = 0) -> str:
    return f"({_MAJ} > {major} OR ({_MAJ} = {major} AND {_MIN} >= {minor}))"


ORACLES["statement_latency_pg"] = W(f"""
SELECT {KC}, concat(coalesce(CAST(userid AS VARCHAR), ''), '_', coalesce(CAST(dbid AS VARCHAR), ''), '_',
  coalesce(CAST(queryid AS VARCHAR), '')) AS queryid, calls,
  CASE WHEN {_at_least(13)} THEN mean_exec_time ELSE mean_time END AS avg_time_ms
FROM pg_stat_statements""", "pg_stat_statements")
ORACLES["statement_latency_mysql"] = W(f"""
SELECT {KC}, coalesce(SCHEMA_NAME, 'NULL') || '_' || DIGEST AS queryid, COUNT_STAR AS calls,
  round(AVG_TIMER_WAIT / 1000000000.0, 6) AS avg_time_ms
FROM mysql_digests""", "mysql_digests")

# ------------------------------------------------------------------ activity --
_LR_PG = ("pid, CASE WHEN {ge14} THEN query_id END AS query_id, backend_start, query_start, datid, datname, "
          "state, state_change, wait_event, wait_event_type, backend_type, xact_start")


def _long_running_pg(n: int) -> str:
    return W(f"""
SELECT {KC}, {_LR_PG.format(ge14=_at_least(14))} FROM (
  SELECT *, {_rank("query_start ASC, pid ASC")} AS rn FROM pg_stat_activity
  WHERE query_start < observation_time - to_minutes({Q.LR_MINUTES_PG})) WHERE rn <= {n}""", "pg_stat_activity")


ORACLES["long_running_pg"] = _long_running_pg(Q.N_LONG_RUNNING)
ORACLES["bounded_sample"] = _long_running_pg(Q.N_SAMPLE)
ORACLES["long_running_mysql"] = W(f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, {_rank("TIMER_WAIT DESC, THREAD_ID ASC")} AS rn FROM mysql_current_statements
  WHERE DIGEST IS NOT NULL AND TIMER_WAIT > {Q.LR_MINUTES_MYSQL} * 60000000000000) WHERE rn <= {Q.N_LONG_RUNNING}""",
                                  "mysql_current_statements")
ORACLES["exclude_self"] = W(f"""
SELECT {KC}, pid, state, query_start FROM pg_stat_activity a
WHERE NOT EXISTS (SELECT 1 FROM own_sessions o WHERE {KEQ("a", "o")} AND a.pid = o.pid)""",
                            "pg_stat_activity", "own_sessions")

_SCRUB = ("CASE WHEN contains(query, 'autovacuum: ') THEN query "
          "WHEN contains(lower(query), 'vacuum ') AND regexp_matches(query, 'vacuum .*[^;]', 'i') "
          "THEN lower(regexp_replace(regexp_extract(query, '(?i)vacuum .*[^;]', 0), '^\\s+|\\s+$', '', 'g')) "
          "ELSE query END")

ORACLES["vacuum_activity"] = W(f"""
SELECT {KC}, usename, datid, datname, pid, wait_event_type, wait_event, state, {_SCRUB} AS query
FROM vacuum_activity_src a
WHERE query ILIKE '%vacuum %'
  AND NOT EXISTS (SELECT 1 FROM vacuum_own_sessions o WHERE {KEQ("a", "o")} AND a.pid = o.pid)""",
                               "vacuum_activity_src", "vacuum_own_sessions")
ORACLES["scrub_vacuum_query"] = W(f"SELECT {KC}, pid, {_SCRUB} AS query FROM vacuum_activity_src",
                                  "vacuum_activity_src")
ORACLES["vacuum_progress"] = W(f"""
SELECT {KC}, pid, relid, phase, heap_blks_total FROM pg_stat_progress_vacuum
QUALIFY row_number() OVER (PARTITION BY {KC}, pid ORDER BY ord DESC) = 1""", "pg_stat_progress_vacuum")
ORACLES["vacuuming_tables"] = W(
    _semi("pg_stat_user_tables", "pg_stat_progress_vacuum", [("relid", "relid")],
          f"{', '.join('t.' + c for c in KC.split(', '))}, t.relid, t.last_autovacuum, t.n_dead_tup, t.relname"),
    "pg_stat_user_tables", "pg_stat_progress_vacuum")

# ------------------------------------------------------------------ counters --
from fleetlens.operators import rollups as _R  # noqa: E402


def _sums(src: str, cols: list[str], spine: str, double_cols=()) -> str:
    agg = ", ".join(f"sum({c}) AS {c}" if c in double_cols else f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in cols)
    return f"""
SELECT {KS}, {", ".join("a." + c for c in cols)}
FROM {spine} s LEFT JOIN (SELECT {KC}, {agg} FROM {src} GROUP BY ALL) a ON {KEQ("s", "a")}"""


_DBSPINE = ("dbspine", f"SELECT DISTINCT {KC} FROM pg_stat_database")
ORACLES["db_counters"] = W(_sums("pg_stat_database", _R.DB_COUNTERS, "dbspine",
                                 ("blk_read_time", "blk_write_time")), "pg_stat_database", extra=[_DBSPINE])
ORACLES["db_conflicts"] = W(_sums("pg_stat_database", _R.DB_CONFLICTS, "dbspine"), "pg_stat_database",
                            extra=[_DBSPINE])
ORACLES["table_counters"] = W(_sums("pg_stat_user_tables", _R.TABLE_COUNTERS, "pg_snapshot_spine"),
                              "pg_stat_user_tables", "pg_snapshot_spine")
ORACLES["table_io_counters"] = W(_sums("pg_statio_user_tables", _R.TABLE_IO_COUNTERS, "pg_snapshot_spine"),
                                 "pg_statio_user_tables", "pg_snapshot_spine")
ORACLES["index_counters"] = W(_sums("pg_stat_user_indexes", _R.INDEX_COUNTERS, "pg_snapshot_spine"),
                              "pg_stat_user_indexes", "pg_snapshot_spine")
ORACLES["index_io_counters"] = W(_sums("pg_stat_user_indexes", _R.INDEX_IO_COUNTERS, "pg_snapshot_spine"),
                                 "pg_stat_user_indexes", "pg_snapshot_spine")
ORACLES["extension_present"] = W(f"""
SELECT {", ".join("s." + c for c in KC.split(", "))}, count(CASE WHEN e.extname = 'pg_stat_statements' THEN 1 END) = 1 AS extension_present
FROM (SELECT DISTINCT {KC} FROM knob_rows) s LEFT JOIN extensions e ON {KEQ("s", "e")} GROUP BY ALL""",
                                   "extensions", "knob_rows")
ORACLES["knob_snapshot"] = W(f"SELECT {KC}, name, arg_max(setting, ord) AS setting FROM knob_rows GROUP BY ALL",
                             "knob_rows")
_STATUS = ("status", f"""SELECT {KC}, lower(Variable_name) AS name, arg_max(Value, ord) AS value
FROM mysql_status GROUP BY ALL""")
ORACLES["status_counters"] = W("SELECT * FROM status", "mysql_status", extra=[_STATUS])
ORACLES["transaction_metrics"] = W(f"SELECT {KC}, name, count FROM innodb_metrics WHERE subsystem = 'transaction'",
                                   "innodb_metrics")


def _tot(names) -> str:
    lst = ", ".join(f"'{n}'" for n in names)
    return f"coalesce(CAST(sum(CASE WHEN name IN ({lst}) THEN CAST(value AS BIGINT) END) AS BIGINT), 0)"


ORACLES["derived_ratios"] = W(f"""
SELECT {KC},
  CASE WHEN requests = 0 THEN 0.0 ELSE round(reads / requests, 4) * 100 END AS buffer_miss_ratio,
  round((CASE WHEN r = 0 THEN 1 ELSE r END) / (CASE WHEN w = 0 THEN 1 ELSE w END), 4) AS read_write_ratio
FROM (SELECT {KC}, {_tot(["innodb_buffer_pool_reads"])} AS reads,
        {_tot(["innodb_buffer_pool_read_requests"])} AS requests, {_tot(["com_select"])} AS r,
        {_tot(["com_insert", "com_update", "com_delete", "com_replace"])} AS w
      FROM status GROUP BY ALL)""", "mysql_status", extra=[_STATUS])
ORACLES["user_set_parameters"] = W(f"""
SELECT DISTINCT {KC}, name FROM knob_rows WHERE source = 'user' AND name IS NOT NULL""", "knob_rows")
ORACLES["single_row_view"] = W(f"""
SELECT {", ".join("s." + c for c in KC.split(", "))}, 'pg_stat_bgwriter' AS view, count(b.buffers_max)::BIGINT AS n_rows
FROM pg_server_spine s LEFT JOIN pg_stat_bgwriter b ON {KEQ("s", "b")} GROUP BY ALL
HAVING count(b.buffers_max) <> 1""", "pg_stat_bgwriter", "pg_server_spine")
ORACLES["knob_map"] = W(f"""
SELECT {KC}, CAST(to_json(map_from_entries(list({{'k': name, 'v': setting}} ORDER BY name))) AS VARCHAR) AS settings
FROM (SELECT {KC}, name, arg_max(setting, ord) AS setting FROM knob_rows WHERE name IS NOT NULL GROUP BY ALL)
GROUP BY ALL""", "knob_rows")
ORACLES["snapshot_round_trip"] = W(
    "SELECT * REPLACE (CAST(blk_read_time AS BIGINT) AS blk_read_time, CAST(blk_write_time AS BIGINT) AS blk_write_time) "
    "FROM pg_stat_database", "pg_stat_database")

# ------------------------------------------------------------------ text -----
_BREAKS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
_LINES = ("s", f"""
  SELECT doc_id, text,
    CASE WHEN text = '' THEN []::VARCHAR[]
         WHEN regexp_matches(text, '(?:{_BREAKS})$') THEN list_slice(string_split_regex(text, '{_BREAKS}'), 1, -2)
         ELSE string_split_regex(text, '{_BREAKS}') END AS lines
  FROM status_text""")
ORACLES["truncate_status_text"] = W(f"""
SELECT doc_id, CASE WHEN len(lines) <= {Q.STATUS_HEAD + Q.STATUS_TAIL} THEN text
  ELSE array_to_string(list_concat(list_slice(lines, 1, {Q.STATUS_HEAD}),
         [concat('...ignore ', len(lines) - {Q.STATUS_HEAD + Q.STATUS_TAIL}, ' lines here...')],
         list_slice(lines, len(lines) - {Q.STATUS_TAIL} + 1, len(lines))), chr(10)) END AS status
FROM s""", "status_text", extra=[_LINES])

# ------------------------------------------------------------------ scalars --
ORACLES["parse_server_version"] = W(f"""
SELECT {KC}, ord, server_version, split_part(server_version, '-', 1) AS mysql_version,
  split_part(server_version, ' ', 1) AS pg_version FROM knob_rows""", "knob_rows")
_VT = "split_part(split_part(server_version, '-', 1), ' ', 1)"
_VMAJ = f"TRY_CAST(split_part({_VT}, '.', 1) AS INTEGER)"
_VMIN = f"coalesce(TRY_CAST(nullif(split_part({_VT}, '.', 2), '') AS INTEGER), 0)"
ORACLES["version_number"] = W(f"""
SELECT {KC}, ord, {_VMAJ} AS major, {_VMIN} AS minor, ({_VMAJ} > 8 OR ({_VMAJ} = 8 AND {_VMIN} >= 0)) AS at_least_8_0
FROM knob_rows""", "knob_rows")
ORACLES["version_gate"] = W(f"""
SELECT {KC}, userid, query, {_at_least(13)} AS has_exec_time, {_at_least(14)} AS has_query_id
FROM pg_stat_statements""", "pg_stat_statements")

_EV = "split_part(split_part(server_version, ' ', 1), '-', 1)"
_EVMAJ = f"TRY_CAST(split_part({_EV}, '.', 1) AS INTEGER)"
_EB = ("b", f"""
  SELECT {KC}, ord,
    CASE WHEN contains(server_version, '-log') THEN 'aurora' WHEN {_EVMAJ} >= 9 THEN 'aurora-postgresql'
         WHEN ord % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine,
    CASE WHEN {_EVMAJ} = 9 THEN '9.6.3' ELSE concat({_EV}, '-mysql_aurora.1.22.2') END AS version
  FROM knob_rows""")
_EC = ("c", """
  SELECT *, CASE WHEN translate(engine, '.-', '__') = 'aurora' THEN 'aurora_mysql'
                 ELSE translate(engine, '.-', '__') END AS eng,
         translate(version, '.-', '__') AS ver FROM b""")
ORACLES["engine_version_key"] = W(f"""
SELECT {KC}, ord, engine, version, concat(eng, '-',
  CASE WHEN eng = 'aurora_postgresql' THEN split_part(ver, '_', 1)
       WHEN contains(eng, 'aurora') THEN concat(split_part(ver, '_', 1), '_', split_part(ver, '_', 2))
       WHEN contains(eng, 'postgres') AND contains(ver, '9_6') THEN concat(split_part(ver, '_', 1), '_', split_part(ver, '_', 2))
       WHEN contains(eng, 'postgres') THEN split_part(ver, '_', 1)
       WHEN contains(eng, 'mysql') THEN concat(split_part(ver, '_', 1), '_', split_part(ver, '_', 2))
       ELSE ver END) AS catalog_key
FROM c""", "knob_rows", extra=[_EB, _EC])
ORACLES["object_prefix"] = W("""
SELECT id, concat_ws('/', organization_id, db_key,
  CASE WHEN lower(obs_type) IN ('db', 'table', 'query', 'long_running_query', 'schema') THEN upper(obs_type)
       ELSE 'UNKNOWN' END, strftime(observation_time, '%Y%m%d'), strftime(observation_time, '%H'), 'data')
  AS object_key FROM observation_log""", "observation_log")
ORACLES["statement_key"] = W(f"""
SELECT {KC}, 'pg' AS engine, concat(coalesce(CAST(userid AS VARCHAR), ''), '_', coalesce(CAST(dbid AS VARCHAR), ''),
  '_', coalesce(CAST(queryid AS VARCHAR), '')) AS key FROM pg_stat_statements
UNION ALL
SELECT {KC}, 'mysql' AS engine, coalesce(SCHEMA_NAME, 'NULL') || '_' || DIGEST AS key FROM mysql_digests""",
                             "pg_stat_statements", "mysql_digests")
ORACLES["ps_to_ms"] = W(f"""
SELECT {KC}, THREAD_ID, TIMER_WAIT / 1e9 AS timer_wait_ms,
  TIMER_WAIT > {Q.LR_MINUTES_MYSQL} * 60000000000000 AS over_threshold FROM mysql_current_statements""",
                        "mysql_current_statements")
ORACLES["iso_timestamps"] = W("""
SELECT error_id,
  CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
       ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
  CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S')
       ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') END AS text
FROM agent_errors""", "agent_errors")
ORACLES["sentinel_to_null"] = W(f"""
SELECT {KC}, attrelid, attnum, nullif(attstattarget, -1) AS stats_target FROM catalog_attribute""",
                                "catalog_attribute")
_FILL = ("coalesce(CAST(TRY_CAST(nullif(regexp_extract(array_to_string(reloptions, ' '), 'fillfactor=([0-9]+)', 1), '')"
         " AS SMALLINT) AS INTEGER), 100)")
ORACLES["fillfactor"] = W(f"SELECT {KC}, oid, {_FILL} AS fillfactor FROM bloat_class", "bloat_class")
_MA = "CASE WHEN regexp_matches(version, 'mingw32|64-bit|x86_64|ppc64|ia64|amd64') THEN 8 ELSE 4 END"
ORACLES["max_alignment"] = W(f"SELECT {KC}, {_MA} AS ma FROM server_settings", "server_settings")
_IO_COLS = ["schemaname", "relname", "heap_blks_read", "heap_blks_hit", "idx_blks_read", "idx_blks_hit",
            "toast_blks_read", "toast_blks_hit", "tidx_blks_read", "tidx_blks_hit"]
ORACLES["drop_null_fields"] = W(f"""
SELECT {KC}, relid, concat_ws(',', 'relid', {", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{c}' END" for c in _IO_COLS)})
  AS fields FROM pg_statio_user_tables""", "pg_statio_user_tables")

# ------------------------------------------------------------------ bloat ----
BT = ("bt", _top_tables_sql(Q.N_BLOAT_TABLES, src="bloat_table_stats"))
_BLOAT_DEPS = ("bloat_attribute", "bloat_class", "bloat_namespace", "bloat_stats", "bloat_table_stats",
               "server_settings")
_TK = lambda a: f"EXISTS (SELECT 1 FROM bt g WHERE {KEQ(a, 'g')} AND g.relid = {a}.oid)"

_FACTOR_JOIN = ("fj", f"""
SELECT {", ".join("a." + c for c in KC.split(", "))}, a.attrelid AS relid, a.attname, a.attnum, a.atttypname,
  c.reltuples, c.relpages, c.reloptions, s.null_frac, s.avg_width, s.attname AS s_attname
FROM bloat_attribute a
JOIN bloat_class c ON {KEQ("a", "c")} AND a.attrelid = c.oid
JOIN bloat_namespace n ON {KEQ("c", "n")} AND c.relnamespace = n.oid
LEFT JOIN bloat_stats s ON {KEQ("a", "s")} AND s.schemaname = n.nspname AND s.tablename = c.relname
  AND s.inherited = false AND s.attname = a.attname
WHERE NOT a.attisdropped AND c.relkind IN ('r', 'm') AND {_TK("c")}""")

_FACTORS = ("fa", f"""
SELECT {KC}, relid, tblpages, reltuples, bs, 24 AS page_hdr, fillfactor,
  (has_name OR n_user <> n_stats) AS is_na, round(data, 6) AS tpl_data_size,
  CAST(23 + CASE WHEN max_nf > 0 THEN (7 + n_stats) / 8.0 ELSE 0 END + CASE WHEN has_oid THEN 4 ELSE 0 END AS DOUBLE)
    AS tpl_hdr_size, ma
FROM (
  SELECT {", ".join("f." + c for c in KC.split(", "))}, f.relid, first(f.relpages) AS tblpages,
    first(f.reltuples) AS reltuples, CAST(first(st.block_size) AS DOUBLE) AS bs,
    first({_MA.replace("version", "st.version")}) AS ma,
    first({_FILL.replace("reloptions", "f.reloptions")}) AS fillfactor,
    max(coalesce(f.null_frac, 0)) AS max_nf, count(f.s_attname) AS n_stats,
    bool_or(f.attname = 'oid' AND f.attnum < 0) AS has_oid,
    sum((1 - coalesce(f.null_frac, 0)) * coalesce(f.avg_width, 0)) AS data,
    bool_or(f.atttypname = 'name') AS has_name, sum(CASE WHEN f.attnum > 0 THEN 1 ELSE 0 END) AS n_user
  FROM fj f JOIN server_settings st ON {KEQ("f", "st")}
  GROUP BY {", ".join("f." + c for c in KC.split(", "))}, f.relid)""")


def _width_join(targets: bool) -> tuple[str, str]:
    return ("wj", f"""
SELECT {", ".join("a." + c for c in KC.split(", "))}, a.attrelid AS relid, a.attnum, a.attname, a.attalign,
  s.avg_width
FROM bloat_attribute a
JOIN bloat_class c ON {KEQ("a", "c")} AND a.attrelid = c.oid
JOIN bloat_namespace n ON {KEQ("c", "n")} AND c.relnamespace = n.oid
JOIN bloat_stats s ON {KEQ("a", "s")} AND s.schemaname = n.nspname AND s.tablename = c.relname
  AND s.inherited = false AND s.attname = a.attname
{"WHERE " + _TK("c") if targets else ""}""")


_ALIGN = "CASE w.attalign WHEN 'c' THEN 1 WHEN 's' THEN 2 WHEN 'i' THEN 4 WHEN 'd' THEN 8 END"
_PADDING = ("pd", f"""
SELECT {KC}, relid, CAST(pad + (((off + 3) & ~3) - off) AS BIGINT) AS padding FROM (
  SELECT *, row_number() OVER (PARTITION BY {KC}, relid ORDER BY rn DESC) AS last FROM rec) WHERE last = 1""")
_REC = ("rec", f"""
WITH RECURSIVE ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {KC}, relid ORDER BY attnum) AS rn FROM wj),
rec AS (
  SELECT {KC}, relid, rn, avg_width AS off, 0 AS pad FROM ordered WHERE rn = 1
  UNION ALL
  SELECT {", ".join("w." + c for c in KC.split(", "))}, w.relid, w.rn,
    ((r.off + {_ALIGN} - 1) & ~({_ALIGN} - 1)) + w.avg_width,
    r.pad + (((r.off + {_ALIGN} - 1) & ~({_ALIGN} - 1)) - r.off)
  FROM rec r JOIN ordered w ON {KEQ("r", "w")} AND r.relid = w.relid AND w.rn = r.rn + 1)
SELECT * FROM rec""")

_WITH_PAD = ("fp", f"""
SELECT f.*, coalesce(p.padding, 0) AS padding FROM fa f LEFT JOIN pd p ON {KEQ("f", "p")} AND f.relid = p.relid""")

_RATIO = """
SELECT {kc}, relid, CASE WHEN is_na THEN NULL
  WHEN (tblpages - est) > 0 AND tblpages <> 0 THEN 100.0 * (tblpages - est) / tblpages ELSE 0.0 END AS bloat_ratio
FROM (
  SELECT *, ceil(reltuples / ((bs - page_hdr) * fillfactor / (tpl * 100.0))) AS est FROM (
    SELECT *, 4 + tpl_hdr_size + d + 2 * ma
      - CASE WHEN fmod(tpl_hdr_size, ma) = 0 THEN ma ELSE fmod(tpl_hdr_size, ma) END
      - CASE WHEN ceil(d) % ma = 0 THEN ma ELSE ceil(d) % ma END AS tpl
    FROM (SELECT *, tpl_data_size + padding AS d FROM fp)))""".format(kc=KC)

ORACLES["bloat_ratio"] = W(_RATIO, *_BLOAT_DEPS,
                           extra=[BT, _FACTOR_JOIN, _FACTORS, _width_join(True), _REC, _PADDING, _WITH_PAD])
ORACLES["bloat_ratio_stepwise"] = ORACLES["bloat_ratio"]
ORACLES["bloat_factors"] = W("SELECT * FROM fa", *_BLOAT_DEPS, extra=[BT, _FACTOR_JOIN, _FACTORS])
ORACLES["factor_stats_join"] = W(f"SELECT {KC}, relid, attname, attnum, null_frac, avg_width FROM fj",
                                 *_BLOAT_DEPS, extra=[BT, _FACTOR_JOIN])
ORACLES["column_width_join"] = W("SELECT * FROM wj", *_BLOAT_DEPS, extra=[BT, _width_join(True)])
ORACLES["tuple_padding"] = W("SELECT * FROM pd", *_BLOAT_DEPS, extra=[_width_join(False), _REC, _PADDING])
ORACLES["padding_default"] = W(f"SELECT {KC}, relid, padding FROM fp", *_BLOAT_DEPS,
                               extra=[BT, _FACTOR_JOIN, _FACTORS, _width_join(True), _REC, _PADDING, _WITH_PAD])
ORACLES["relation_kinds"] = W(f"SELECT {KC}, oid, relkind FROM bloat_class WHERE relkind IN ('r', 'm')",
                              "bloat_class")

# ------------------------------------------------------------------ metrics --
ORACLES["metric_minute_avg"] = W("""
SELECT db_key, metric, time_bucket(INTERVAL 60 SECOND, ts) AS period_start, avg(value) AS avg_value,
  count(*)::BIGINT AS samples FROM metric_samples GROUP BY ALL""", "metric_samples")


def _histogram(source: str, keys: str, value: str, first: float, unit: float = 1.0) -> str:
    """Fixed log buckets: an edge table of its own, counts by comparison with the edges."""
    k = ", ".join(f"h.{c}" for c in keys.split(", "))
    same = " AND ".join(f"s.{c} = h.{c}" for c in keys.split(", "))
    return f"""
SELECT {keys}, bucket_number, lo / {unit} AS bucket_timer_low, hi / {unit} AS bucket_timer_high, count_bucket,
  CAST(sum(count_bucket) OVER w AS BIGINT) AS count_bucket_and_lower,
  sum(count_bucket) OVER w / sum(count_bucket) OVER (PARTITION BY {keys}) AS bucket_quantile
FROM (SELECT {k}, e.bucket_number, e.lo, e.hi, count(s.v)::BIGINT AS count_bucket
  FROM (SELECT DISTINCT {keys} FROM {source}) h
  CROSS JOIN (SELECT CAST(i AS INTEGER) AS bucket_number, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE {first} * pow(10.0, (i - 1) / 50.0) END AS lo,
         CASE WHEN i < 449 THEN {first} * pow(10.0, i / 50.0) END AS hi FROM range(450) t(i)) e
  LEFT JOIN (SELECT {keys}, CAST({value} AS DOUBLE) AS v FROM {source}) s
    ON {same} AND s.v >= e.lo AND (e.hi IS NULL OR s.v < e.hi)
  GROUP BY ALL)
WINDOW w AS (PARTITION BY {keys} ORDER BY bucket_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


ORACLES["latency_histogram"] = W(_histogram("metric_samples", "db_key", "value", 0.01), "metric_samples")
ORACLES["latency_histogram_mysql"] = W(_histogram("mysql_current_statements", KC, "TIMER_WAIT", 1e7, 1e9),
                                       "mysql_current_statements")
ORACLES["json_text"] = W(f"""
SELECT {KC}, page, count(*)::BIGINT AS n_rows,
  regexp_replace(regexp_replace(CAST(to_json(list({{'queryid': queryid, 'calls': calls, 'avg_time_ms': avg_time_ms}}
    ORDER BY queryid NULLS FIRST, FIRST_SEEN)) AS VARCHAR), '"queryid":null,', '', 'g'), ',"queryid":null', '', 'g')
    AS events_statements_summary_by_digest
FROM (
  SELECT *, CAST((row_number() OVER (PARTITION BY {KC} ORDER BY queryid NULLS FIRST, FIRST_SEEN) - 1)
    // {Q.JSON_PAGE_ROWS} AS BIGINT) AS page
  FROM (
    SELECT {KC}, coalesce(SCHEMA_NAME, 'NULL') || '_' || DIGEST AS queryid, COUNT_STAR AS calls,
      round(AVG_TIMER_WAIT / 1000000000.0, 6) AS avg_time_ms, FIRST_SEEN
    FROM mysql_digests))
GROUP BY ALL""", "mysql_digests")
