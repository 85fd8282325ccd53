"""DuckDB text of the stand-in relations (see ``fleetlens.sources.standins``).

Each entry is ``name -> (sql, deps)``; ``with_standins`` turns a query body into
a self-contained statement over the raw parquet views the driver registers.
Counts are cast to BIGINT (DuckDB returns HUGEINT for count_if and integer sums).
"""

from __future__ import annotations

from fleetlens.sources.standins import DIGEST_COUNTERS

OBS = "TIMESTAMP '2024-01-31 00:00:00'"
K_LIT = "'org0' AS organization_id"


def _k(db: str, ldb: str = "'db0'") -> str:
    return f"{K_LIT}, {db} AS db_key, {ldb} AS logical_database_name, {OBS} AS observation_time"


_LDB_PART = "concat('db', {x} % 3)"
_MYSQL_SCHEMA = ("CASE {x} % 40 WHEN 0 THEN 'mysql' WHEN 1 THEN 'sys' WHEN 2 THEN 'performance_schema' "
                 "WHEN 3 THEN 'INFORMATION_SCHEMA' ELSE lower({t}) END")
KCOLS = "organization_id, db_key, logical_database_name, observation_time"

S: dict[str, tuple[str, tuple[str, ...]]] = {}

S["table_facts"] = (f"""
SELECT g.*, p.p_brand, p.p_type, p.p_name FROM (
  SELECT l_partkey,
    count(*)::BIGINT AS n,
    count_if(l_returnflag = 'R')::BIGINT AS n_r,
    count_if(l_returnflag = 'A')::BIGINT AS n_a,
    count_if(l_returnflag = 'N')::BIGINT AS n_n,
    count_if(l_returnflag = 'A' AND l_discount > 0.08)::BIGINT AS n_a_disc,
    count_if(l_linestatus = 'F')::BIGINT AS n_f,
    count_if(l_linestatus = 'O')::BIGINT AS n_o,
    count_if(l_tax > 0.04)::BIGINT AS n_tax_hi,
    count_if(l_tax < 0.02)::BIGINT AS n_tax_lo,
    count_if(l_tax > 0.07)::BIGINT AS n_tax_top,
    count_if(l_discount < 0.02)::BIGINT AS n_disc_lo,
    {", ".join(f"count_if(l_linenumber = {i})::BIGINT AS n_l{i}" for i in range(1, 8))},
    CAST(sum(l_quantity) AS BIGINT) AS qty,
    CAST(sum(l_linenumber) AS BIGINT) AS lines,
    max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS last_r,
    max(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS last_f,
    min(l_shipdate) AS first_ship,
    max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_partkey) g
JOIN part p ON g.l_partkey = p.p_partkey""", ())

_V1K = _k("p_brand", _LDB_PART.format(x="l_partkey"))

S["pg_stat_user_tables"] = (f"""
SELECT {_V1K}, l_partkey AS relid, p_type AS schemaname, p_name AS relname,
  n_r AS seq_scan, qty AS seq_tup_read, nullif(n_a_disc, 0) AS idx_scan, n_a AS idx_tup_fetch,
  n AS n_tup_ins, n_o AS n_tup_upd, n_n AS n_tup_del, n_l1 AS n_tup_hot_upd,
  n AS n_live_tup, n_f AS n_dead_tup, n_tax_hi AS n_mod_since_analyze,
  last_r AS last_vacuum, last_f AS last_autovacuum, first_ship AS last_analyze,
  last_ship AS last_autoanalyze, n_l2 AS vacuum_count, n_l3 AS autovacuum_count,
  n_l4 AS analyze_count, n_l5 AS autoanalyze_count
FROM table_facts""", ("table_facts",))

S["pg_statio_user_tables"] = (f"""
SELECT {_V1K}, l_partkey AS relid, p_type AS schemaname, p_name AS relname,
  lines AS heap_blks_read, qty * 10 AS heap_blks_hit, n_a AS idx_blks_read, n_a * 3 AS idx_blks_hit,
  nullif(n_tax_lo, 0) AS toast_blks_read, nullif(n_tax_top, 0) AS toast_blks_hit,
  nullif(n_l6, 0) AS tidx_blks_read, nullif(n_l7, 0) AS tidx_blks_hit
FROM table_facts""", ("table_facts",))

S["pg_table_size_facts"] = (f"""
SELECT {_V1K}, l_partkey AS relid, qty * 8192 + n * 8192 AS table_size,
  qty * 8192 AS relation_size, lines * 8192 AS indexes_size
FROM table_facts""", ("table_facts",))

S["pg_stat_progress_vacuum"] = (f"""
SELECT {_k("p_brand", _LDB_PART.format(x="p_partkey"))}, 100000 + p_partkey // 100 * 50 + p_partkey % 50 AS pid, p_partkey AS ord,
  p_partkey AS relid,
  ['scanning heap', 'vacuuming indexes', 'cleaning up indexes'][p_size % 3 + 1] AS phase,
  CAST(p_size * 10 AS BIGINT) AS heap_blks_total
FROM part""", ())

S["pg_server_spine"] = (f"""
SELECT DISTINCT {_k("concat('db', o_custkey % 12)")} FROM orders""", ())

S["pg_snapshot_spine"] = (f"""
SELECT DISTINCT {_k("p_brand", _LDB_PART.format(x="p_partkey"))} FROM part""", ())

S["mysql_tables"] = (f"""
SELECT {_k("p_brand")},
  {_MYSQL_SCHEMA.format(x="l_partkey", t="p_type")} AS TABLE_SCHEMA,
  concat('t', l_partkey) AS TABLE_NAME,
  CASE WHEN l_partkey % 9 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS TABLE_TYPE,
  'InnoDB' AS ENGINE, CAST(10 AS BIGINT) AS VERSION,
  CASE WHEN n_l1 % 2 = 0 THEN 'Dynamic' ELSE 'Compact' END AS ROW_FORMAT,
  n_o AS TABLE_ROWS, qty % 97 + 1 AS AVG_ROW_LENGTH, qty * 16384 AS DATA_LENGTH,
  lines * 16384 AS INDEX_LENGTH, n_f * 4096 AS DATA_FREE, CAST(0 AS BIGINT) AS MAX_DATA_LENGTH,
  'utf8mb4_0900_ai_ci' AS TABLE_COLLATION,
  CASE WHEN n_tax_hi > n_tax_lo THEN 'row_format=DYNAMIC' ELSE '' END AS CREATE_OPTIONS,
  p_name AS TABLE_COMMENT
FROM table_facts""", ("table_facts",))

S["index_facts"] = ("""
SELECT g.*, p.p_brand, p.p_type, p.p_name FROM (
  SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n, CAST(sum(l_quantity) AS BIGINT) AS qty,
    count_if(l_returnflag = 'R')::BIGINT AS n_r, count_if(l_linestatus = 'O')::BIGINT AS n_o,
    CAST(sum(l_linenumber) AS BIGINT) AS lines
  FROM lineitem GROUP BY l_partkey, l_suppkey) g
JOIN part p ON g.l_partkey = p.p_partkey""", ())

S["pg_stat_user_indexes"] = (f"""
SELECT {_V1K}, l_partkey AS relid, l_partkey * 100000 + l_suppkey AS indexrelid,
  p_type AS schemaname, p_name AS relname, concat('i', l_partkey * 100000 + l_suppkey) AS indexrelname,
  n AS idx_scan, qty AS idx_tup_read, n_r AS idx_tup_fetch, qty * 8192 AS index_size,
  lines AS idx_blks_read, n_o * 7 AS idx_blks_hit
FROM index_facts""", ("index_facts",))

S["pg_index"] = (f"""
SELECT {_V1K}, l_partkey * 100000 + l_suppkey AS indexrelid, l_partkey AS indrelid,
  1 AS indnatts, 1 AS indnkeyatts, l_suppkey % 7 = 0 AS indisunique, l_suppkey % 11 = 0 AS indisprimary,
  l_suppkey % 13 = 0 AS indisexclusion, true AS indimmediate, l_suppkey % 17 = 0 AS indisclustered, true AS indisvalid,
  false AS indcheckxmin, true AS indisready, true AS indislive, l_suppkey % 19 = 0 AS indisreplident,
  CAST(l_suppkey % 5 + 1 AS VARCHAR) AS indkey, '0' AS indcollation, '1978' AS indclass, '0' AS indoption,
  CAST(NULL AS VARCHAR) AS indexprs, CASE WHEN l_suppkey % 3 = 0 THEN concat('(n > ', n, ')') END AS indpred
FROM index_facts""", ("index_facts",))

_MYSQL_IX = f"""{_k("p_brand")}, {_MYSQL_SCHEMA.format(x="l_partkey", t="p_type")} AS DATABASE_NAME,
  concat('t', l_partkey) AS TABLE_NAME, concat('i', l_suppkey) AS INDEX_NAME"""

S["mysql_index_stats"] = (f"""
SELECT {_MYSQL_IX}, 'size' AS stat_name, qty AS stat_value FROM index_facts
UNION ALL
SELECT {_MYSQL_IX}, 'n_leaf_pages' AS stat_name, n AS stat_value FROM index_facts""", ("index_facts",))

S["mysql_statistics"] = (f"""
SELECT {_k("p_brand")}, {_MYSQL_SCHEMA.format(x="l_partkey", t="p_type")} AS TABLE_SCHEMA,
  concat('t', l_partkey) AS TABLE_NAME, CAST(l_suppkey % 2 AS BIGINT) AS NON_UNIQUE,
  {_MYSQL_SCHEMA.format(x="l_partkey", t="p_type")} AS INDEX_SCHEMA, concat('i', l_suppkey) AS INDEX_NAME,
  CAST(1 AS BIGINT) AS SEQ_IN_INDEX, concat('c', l_suppkey % 5) AS COLUMN_NAME, 'A' AS COLLATION,
  n AS CARDINALITY, CAST(NULL AS BIGINT) AS SUB_PART,
  CASE WHEN l_suppkey % 3 = 0 THEN 'YES' ELSE '' END AS NULLABLE, 'BTREE' AS INDEX_TYPE,
  CAST(NULL AS VARCHAR) AS PACKED
FROM index_facts""", ("index_facts",))

S["mysql_index_usage"] = (f"""
SELECT {_k("p_brand")}, CASE WHEN l_suppkey % 10 = 0 THEN 'VIEW' ELSE 'TABLE' END AS OBJECT_TYPE,
  {_MYSQL_SCHEMA.format(x="l_partkey", t="p_type")} AS OBJECT_SCHEMA, concat('t', l_partkey) AS OBJECT_NAME,
  concat('i', l_suppkey) AS INDEX_NAME, n AS COUNT_STAR, lines * 1000 AS SUM_TIMER_WAIT,
  n_o AS COUNT_READ, n_o * 900 AS SUM_TIMER_READ, n - n_o AS COUNT_WRITE, (n - n_o) * 1100 AS SUM_TIMER_WRITE,
  n_o AS COUNT_FETCH, n_o * 900 AS SUM_TIMER_FETCH, n_r AS COUNT_INSERT, n_r * 1000 AS SUM_TIMER_INSERT,
  n - n_o - n_r AS COUNT_UPDATE, qty AS SUM_TIMER_UPDATE, CAST(0 AS BIGINT) AS COUNT_DELETE,
  CAST(0 AS BIGINT) AS SUM_TIMER_DELETE
FROM index_facts""", ("index_facts",))

# ---- bloat world (V2)
_BK = _k("concat('db', o_custkey % 4)", "concat('ldb', o_orderkey % 2)")
_NSP3 = "['public', 'sales', 'archive']"

S["bloat_orders"] = (f"""
SELECT {_BK}, o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders""", ())

S["bloat_class"] = (f"""
SELECT {KCOLS}, o_orderkey AS oid, concat('t', o_orderkey) AS relname, o_orderkey % 3 + 2200 AS relnamespace,
  CASE WHEN o_orderkey % 10 = 0 THEN 'm' WHEN o_orderkey % 10 = 1 THEN 'v' ELSE 'r' END AS relkind,
  CAST(o_custkey AS DOUBLE) * 100 AS reltuples, o_custkey * 3 AS relpages,
  CASE WHEN o_orderpriority = '1-URGENT' THEN ['autovacuum_enabled=true', 'fillfactor=70'] END AS reloptions
FROM bloat_orders""", ("bloat_orders",))

S["bloat_namespace"] = (f"""
SELECT {KCOLS}, oid, {_NSP3}[oid - 2200 + 1] AS nspname FROM (
  SELECT DISTINCT {KCOLS}, o_orderkey % 3 + 2200 AS oid FROM bloat_orders)""", ("bloat_orders",))

S["bloat_columns"] = (f"""
SELECT g.*, {KCOLS}, o.o_orderkey FROM (
  SELECT l_orderkey, l_linenumber, CAST(max(l_quantity) AS INTEGER) AS max_qty, max(l_discount) AS max_disc
  FROM lineitem GROUP BY l_orderkey, l_linenumber) g
JOIN bloat_orders o ON g.l_orderkey = o.o_orderkey""", ("bloat_orders",))

S["bloat_attribute"] = (f"""
SELECT {KCOLS}, l_orderkey AS attrelid, l_linenumber AS attnum, concat('c', l_linenumber) AS attname,
  ['c', 's', 'i', 'd'][l_linenumber % 4 + 1] AS attalign,
  CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 1 THEN 'name' ELSE 'int4' END AS atttypname,
  (l_orderkey % 17 = 0 AND l_linenumber = 2) AS attisdropped
FROM bloat_columns
UNION ALL
SELECT {KCOLS}, o_orderkey AS attrelid, -2 AS attnum,
  CASE WHEN o_orderkey % 11 = 0 THEN 'oid' ELSE 'ctid' END AS attname, 'i' AS attalign,
  'oid' AS atttypname, false AS attisdropped
FROM bloat_orders""", ("bloat_columns", "bloat_orders"))

S["bloat_stats"] = (f"""
WITH base AS (
  SELECT {KCOLS}, l_orderkey, {_NSP3}[l_orderkey % 3 + 1] AS schemaname, concat('t', l_orderkey) AS tablename,
    concat('c', l_linenumber) AS attname, max_disc AS null_frac, max_qty AS avg_width
  FROM bloat_columns WHERE l_linenumber < 7 OR l_orderkey % 5 <> 0)
SELECT {KCOLS}, schemaname, tablename, attname, null_frac, avg_width, false AS inherited FROM base
UNION ALL
SELECT {KCOLS}, schemaname, tablename, attname, 0.5 AS null_frac, 999 AS avg_width, true AS inherited
FROM base WHERE l_orderkey % 13 = 0""", ("bloat_columns",))

S["bloat_table_stats"] = (f"""
SELECT {KCOLS}, o_orderkey AS relid, o_custkey * 100 AS n_live_tup, o_orderkey % 7 AS seq_scan,
  nullif(o_orderkey % 5, 0) AS idx_scan
FROM bloat_orders""", ("bloat_orders",))

S["server_settings"] = (f"""
SELECT {KCOLS}, 8192 AS block_size,
  CASE WHEN m = 3 THEN 'PostgreSQL 12.4 on armv7l-unknown-linux-gnueabihf, 32-bit'
       ELSE 'PostgreSQL 14.2 on x86_64-pc-linux-gnu, compiled by gcc, 64-bit' END AS version
FROM (SELECT DISTINCT {KCOLS}, o_custkey % 4 AS m FROM bloat_orders)""", ("bloat_orders",))

# ---- events world
S["metric_samples"] = ("""
SELECT concat('db', user_id % 10) AS db_key, event_type AS metric, ts, value FROM events""", ())

S["statement_facts"] = ("""
SELECT user_id, event_type, count(*)::BIGINT AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS centi_ms,
  min(event_id) AS first_id, min(ts) AS first_seen, max(ts) AS last_seen,
  count_if(value > 250)::BIGINT AS slow
FROM events GROUP BY user_id, event_type""", ())

S["pg_stat_statements"] = (f"""
SELECT {_k("concat('db', user_id % 10)")},
  ['9.6.3', '11.2', '12.4', '13.1', '14.2'][user_id % 5 + 1] AS server_version,
  user_id AS userid, user_id % 10 AS dbid, nullif(first_id % 7, 0) AS queryid,
  concat('select /* ', event_type, ' */ 1') AS query, calls, calls * 3 AS "rows",
  slow AS shared_blks_hit, calls - slow AS shared_blks_read,
  CASE WHEN user_id % 5 >= 3 THEN centi_ms / calls / 100 END AS mean_exec_time,
  CASE WHEN NOT (user_id % 5 >= 3) THEN centi_ms / calls / 100 END AS mean_time,
  centi_ms / 100 AS blk_read_time
FROM statement_facts""", ("statement_facts",))

_DIGEST_COUNTERS = [", ".join(f"calls % {i + 2} AS {n}" for i, n in enumerate(DIGEST_COUNTERS) if (i > 3) == late)
                    for late in (False, True)]

S["mysql_digests"] = (f"""
SELECT {_k("concat('db', user_id % 10)")},
  CASE WHEN user_id % 10 <> 0 THEN concat('schema', user_id % 10) END AS SCHEMA_NAME,
  CASE WHEN event_type <> 'error' THEN concat('d', event_type, user_id) END AS DIGEST,
  concat('SELECT ? FROM ', event_type) AS DIGEST_TEXT, calls AS COUNT_STAR,
  centi_ms * 10000000 AS SUM_TIMER_WAIT, calls * 1000 AS MIN_TIMER_WAIT,
  (centi_ms * 10000000 // calls // 1000) * 1000 AS AVG_TIMER_WAIT, centi_ms * 10000000 + 1 AS MAX_TIMER_WAIT,
  {_DIGEST_COUNTERS[0]}, calls * 2 AS SUM_ROWS_SENT, {_DIGEST_COUNTERS[1]}, first_seen AS FIRST_SEEN, last_seen AS LAST_SEEN
FROM statement_facts""", ("statement_facts",))

_STATUS_NAME = ("CASE event_type WHEN 'view' THEN 'Innodb_buffer_pool_read_requests' "
                "WHEN 'error' THEN 'Innodb_buffer_pool_reads' WHEN 'click' THEN 'Com_select' "
                "WHEN 'signup' THEN 'Com_insert' WHEN 'purchase' THEN 'Com_update' END")
_STATUS_ORD = ("CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 2 "
               "WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END")

S["mysql_status"] = (f"""
WITH g AS (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL)
SELECT {_k("CAST(user_id AS VARCHAR)")}, {_STATUS_NAME} AS Variable_name, CAST(n AS VARCHAR) AS Value,
  {_STATUS_ORD} * 2 AS ord FROM g
UNION ALL
SELECT {_k("CAST(user_id AS VARCHAR)")}, upper({_STATUS_NAME}) AS Variable_name, CAST(n * 2 AS VARCHAR) AS Value,
  {_STATUS_ORD} * 2 + 1 AS ord FROM g WHERE user_id % 7 = 0""", ())

S["innodb_metrics"] = (f"""
SELECT {_k("CAST(user_id AS VARCHAR)")}, concat('trx_', event_type) AS name,
  CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN 'transaction' ELSE 'server' END AS subsystem,
  n AS count
FROM (SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL)""", ())

S["pg_stat_database"] = (f"""
SELECT {_k("concat('db', o_custkey % 10)")}, concat('d', o_custkey) AS datname,
  count(*)::BIGINT AS numbackends,
  CAST(sum(o_orderkey % 100) AS BIGINT) AS xact_commit,
  count_if(o_orderstatus = 'F')::BIGINT AS xact_rollback,
  CAST(sum(floor(o_totalprice)) AS BIGINT) AS blks_read,
  CAST(sum(o_orderkey) AS BIGINT) AS blks_hit,
  count_if(o_orderstatus = 'O')::BIGINT AS tup_returned,
  count_if(o_orderstatus = 'P')::BIGINT AS tup_fetched,
  count_if(o_orderpriority = '1-URGENT')::BIGINT AS tup_inserted,
  count_if(o_orderpriority = '2-HIGH')::BIGINT AS tup_updated,
  count_if(o_orderpriority = '5-LOW')::BIGINT AS tup_deleted,
  count_if(o_orderkey % 13 = 0)::BIGINT AS conflicts,
  count_if(o_orderkey % 17 = 0)::BIGINT AS temp_files,
  CAST(sum(o_orderkey % 1000 * 1024) AS BIGINT) AS temp_bytes,
  count_if(o_orderkey % 101 = 0)::BIGINT AS deadlocks,
  sum(floor(o_totalprice / 100)) AS blk_read_time,
  sum(floor(o_totalprice / 1000)) AS blk_write_time,
  count_if(o_orderkey % 19 = 0)::BIGINT AS confl_tablespace,
  count_if(o_orderkey % 23 = 0)::BIGINT AS confl_lock,
  count_if(o_orderkey % 29 = 0)::BIGINT AS confl_snapshot,
  count_if(o_orderkey % 31 = 0)::BIGINT AS confl_bufferpin,
  count_if(o_orderkey % 37 = 0)::BIGINT AS confl_deadlock
FROM orders GROUP BY o_custkey""", ())

S["pg_stat_bgwriter"] = (f"""
WITH one AS (
  SELECT {_k("concat('db', m)")}, checkpoints_timed, checkpoints_req, buffers_max FROM (
    SELECT o_custkey % 10 AS m, count(*)::BIGINT AS checkpoints_timed,
      CAST(sum(o_orderkey % 7) AS BIGINT) AS checkpoints_req, max(o_totalprice) AS buffers_max
    FROM orders GROUP BY 1))
SELECT * FROM one
UNION ALL
SELECT {KCOLS}, checkpoints_timed + 1, checkpoints_req, buffers_max FROM one WHERE db_key = 'db3'""", ())

# ---- activity (V6, V8)
S["pg_stat_activity"] = (f"""
SELECT {_k("concat('db', o_custkey % 10)")},
  ['9.6.3', '11.2', '12.4', '13.1', '14.2'][(o_custkey % 10) % 5 + 1] AS server_version,
  o_orderkey AS pid, o_custkey AS query_id, o_orderdate - INTERVAL 1 DAY AS backend_start,
  o_orderdate AS query_start, o_custkey % 10 AS datid, concat('d', o_custkey % 10) AS datname,
  o_orderstatus AS state, o_orderdate + INTERVAL 1 HOUR AS state_change,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ClientRead' END AS wait_event,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Client' END AS wait_event_type,
  'client backend' AS backend_type, o_orderdate AS xact_start
FROM orders""", ())

S["own_sessions"] = (f"""
SELECT {_k("concat('db', o_custkey % 10)")}, o_orderkey AS pid FROM orders WHERE o_orderkey % 1000 = 0""", ())

S["mysql_current_statements"] = (f"""
SELECT {_k("concat('db', o_custkey % 10)")}, o_orderkey AS THREAD_ID, o_orderkey % 1000 AS EVENT_ID,
  'statement/sql/select' AS EVENT_NAME, o_orderkey * 1000000 AS TIMER_START,
  o_orderkey * 1000000 + CAST(floor(o_totalprice) AS BIGINT) * 1000000000 AS TIMER_END,
  CAST(floor(o_totalprice) AS BIGINT) * 1000000000 AS TIMER_WAIT, o_orderkey % 100 * 1000 AS LOCK_TIME,
  nullif(o_orderpriority, '4-NOT SPECIFIED') AS DIGEST,
  concat('SELECT * FROM t WHERE p = ', o_orderpriority) AS DIGEST_TEXT,
  o_orderkey % 10 AS ROWS_SENT, o_custkey % 100 AS ROWS_EXAMINED,
  o_orderkey % 2 AS ROWS_AFFECTED, o_orderkey % 3 AS CREATED_TMP_DISK_TABLES, o_orderkey % 4 AS CREATED_TMP_TABLES,
  o_orderkey % 5 AS SELECT_FULL_JOIN, o_orderkey % 6 AS SELECT_FULL_RANGE_JOIN, o_orderkey % 7 AS SELECT_RANGE,
  o_orderkey % 8 AS SELECT_RANGE_CHECK, o_orderkey % 9 AS SELECT_SCAN, o_orderkey % 10 AS SORT_MERGE_PASSES,
  o_orderkey % 11 AS SORT_RANGE, o_orderkey % 12 AS SORT_ROWS, o_orderkey % 13 AS SORT_SCAN,
  o_orderkey % 14 AS NO_INDEX_USED, o_orderkey % 15 AS NO_GOOD_INDEX_USED
FROM orders""", ())

S["vacuum_activity_src"] = (f"""
SELECT {_k("p_brand", _LDB_PART.format(x="p_partkey"))}, 'postgres' AS usename, p_partkey % 3 AS datid,
  concat('db', p_partkey % 3) AS datname, p_partkey AS pid,
  CASE WHEN p_size % 4 = 1 THEN 'Timeout' END AS wait_event_type,
  CASE WHEN p_size % 4 = 1 THEN 'VacuumDelay' END AS wait_event, 'active' AS state,
  CASE p_size % 4
    WHEN 0 THEN concat('-- nightly job ', p_name, chr(10) || ' VACUUM ', p_name, chr(9) || ';')
    WHEN 1 THEN concat('autovacuum: VACUUM ANALYZE public.', replace(p_name, ' ', '_'))
    WHEN 2 THEN concat('vacuum ', p_name, '; select 1')
    ELSE concat('select ', p_name) END AS query
FROM part""", ())

S["vacuum_own_sessions"] = (f"""
SELECT {_k("p_brand", _LDB_PART.format(x="p_partkey"))}, p_partkey AS pid FROM part WHERE p_partkey % 100 = 0""", ())

S["status_text"] = ("SELECT doc_id, text FROM documents", ())

# ---- catalogs
_NSPNAME = ("CASE WHEN r_regionkey = 0 THEN 'pg_catalog' WHEN r_regionkey = 1 THEN 'pg_toast_1' "
            "WHEN r_regionkey = 4 THEN 'information_schema' ELSE lower(r_name) END")
_K0 = _k("'db0'")

S["catalog_namespace"] = (f"""
SELECT {_K0}, CAST(r_regionkey AS BIGINT) AS oid, {_NSPNAME} AS nspname FROM region""", ())

S["catalog_class"] = (f"""
SELECT {_K0}, CAST(n_nationkey AS BIGINT) AS oid, lower(n_name) AS relname,
  CAST(n_regionkey AS BIGINT) AS relnamespace, ['r', 'p', 'v', 'm', 'S'][n_nationkey % 5 + 1] AS relkind,
  CAST(0 AS BIGINT) AS relam, CAST(0 AS BIGINT) AS reltablespace,
  CASE WHEN n_nationkey % 2 = 0 THEN 'postgres' ELSE 'app' END AS owner,
  CASE WHEN n_nationkey % 7 = 0 THEN 'u' ELSE 'p' END AS relpersistence,
  CASE WHEN n_nationkey % 3 = 0 THEN concat('table of ', n_name) END AS description
FROM nation
UNION ALL
SELECT {_K0}, p_partkey + 1000000 AS oid, concat('idx_', p_partkey) AS relname,
  CAST((p_partkey % 25) % 5 AS BIGINT) AS relnamespace, 'i' AS relkind,
  CAST(CASE WHEN p_size % 2 = 0 THEN 403 ELSE 405 END AS BIGINT) AS relam,
  CAST(CASE WHEN p_size % 5 = 0 THEN 1663 ELSE 0 END AS BIGINT) AS reltablespace,
  'postgres' AS owner, 'p' AS relpersistence, CAST(NULL AS VARCHAR) AS description
FROM part
UNION ALL
SELECT {_K0}, oid, concat('table_', oid) AS relname, oid % 5 AS relnamespace,
  ['r', 'p', 'v', 'm', 'S'][oid % 5 + 1] AS relkind, CAST(0 AS BIGINT) AS relam, CAST(0 AS BIGINT) AS reltablespace,
  CASE WHEN oid % 2 = 0 THEN 'postgres' ELSE 'app' END AS owner,
  CASE WHEN oid % 7 = 0 THEN 'u' ELSE 'p' END AS relpersistence,
  CASE WHEN oid % 3 = 0 THEN concat('table of ', oid) END AS description
FROM (SELECT CAST(s_suppkey % 25 + 25 * (s_suppkey // 1000) AS BIGINT) AS oid FROM supplier
      WHERE s_suppkey >= 1000 AND s_suppkey % 1000 < 25
      UNION ALL SELECT CAST(c_custkey + 3000000 AS BIGINT) FROM customer)""", ())

S["catalog_am"] = (f"""
SELECT {_K0}, oid, CASE WHEN oid = 403 THEN 'btree' ELSE 'hash' END AS amname FROM (
  SELECT DISTINCT CAST(CASE WHEN p_size % 2 = 0 THEN 403 ELSE 405 END AS BIGINT) AS oid FROM part)""", ())

_ATTNUM = ("CAST(CASE WHEN s_suppkey % 13 = 0 THEN -((s_suppkey % 1000) // 25 + 1) "
           "ELSE (s_suppkey % 1000) // 25 + 1 END AS INTEGER)")
_ATTRELID = "s_suppkey % 25 + 25 * (s_suppkey // 1000)"

S["catalog_attribute"] = (f"""
SELECT {_K0}, {_ATTRELID} AS attrelid, {_ATTNUM} AS attnum,
  lower(replace(s_name, '#', '_')) AS attname, s_suppkey % 3 AS atttypid, s_suppkey % 4 AS attcollation,
  s_suppkey % 11 = 0 AS attisdropped, s_acctbal > 0 AS attnotnull,
  CAST(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_suppkey % 100 END AS INTEGER) AS attstattarget,
  s_suppkey % 4 = 0 AS atthasdef, CASE WHEN s_suppkey % 6 = 1 THEN 'a' ELSE '' END AS attidentity,
  CASE WHEN s_suppkey % 3 = 1 THEN 'x' ELSE 'p' END AS attstorage,
  CASE WHEN s_suppkey % 8 = 3 THEN 's' ELSE '' END AS attgenerated,
  CASE WHEN s_suppkey % 5 = 0 THEN concat('note ', s_name) END AS description
FROM supplier""", ())

S["catalog_attrdef"] = (f"""
SELECT {_K0}, {_ATTRELID} AS adrelid, {_ATTNUM} AS adnum,
  concat('nextval(''seq_', s_suppkey, '''::regclass)') AS adsrc
FROM supplier""", ())

S["catalog_type"] = (f"""
SELECT {_K0}, oid, ['integer', 'text', 'numeric(12,2)'][oid + 1] AS typname,
  CAST(CASE WHEN oid = 1 THEN 1 ELSE 0 END AS BIGINT) AS typcollation
FROM (SELECT DISTINCT s_suppkey % 3 AS oid FROM supplier)""", ())

S["catalog_collation"] = (f"""
SELECT {_K0}, oid, ['-', 'default', 'C', 'en_US'][oid + 1] AS collname
FROM (SELECT DISTINCT s_suppkey % 4 AS oid FROM supplier)""", ())

S["catalog_index"] = (f"""
SELECT {_K0}, p_partkey + 1000000 AS indexrelid, p_partkey % 25 AS indrelid,
  p_size % 10 = 0 AS indisprimary, p_size % 2 = 0 AS indisunique, p_size % 7 = 0 AS indisclustered,
  p_partkey % 50 <> 7 AS indisvalid, p_size % 9 = 0 AS indisreplident,
  [CAST(p_size % 3 + 1 AS INTEGER), CASE WHEN p_partkey % 11 = 4 THEN 0 ELSE CAST(p_size % 2 + 4 AS INTEGER) END] AS indkey,
  CASE WHEN p_partkey % 11 = 4 THEN [concat('lower(c', p_size, ')')] END AS indexprs,
  concat('CREATE INDEX idx_', p_partkey, ' ON t', p_partkey % 25) AS indexdef
FROM part""", ())

S["catalog_constraint"] = (f"""
SELECT {_K0}, p_partkey + 5000000 AS oid, concat('con_', p_partkey) AS conname,
  contype, p_partkey % 25 AS conrelid,
  CASE WHEN contype IN ('f', 'c') THEN 0 ELSE p_partkey + 1000000 END AS conindid,
  p_size % 3 = 0 AS condeferrable, p_size % 6 = 0 AS condeferred,
  CAST(CASE WHEN p_partkey % 15 = 0 THEN 1 ELSE 0 END AS BIGINT) AS conparentid,
  concat(CASE contype WHEN 'f' THEN 'FOREIGN KEY (c1) REFERENCES t' WHEN 'c' THEN 'CHECK (c' ELSE 'UNIQUE (c' END,
         p_size % 25, CASE WHEN contype = 'f' THEN '(c1)' ELSE ')' END) AS condef
FROM (SELECT *, CASE WHEN p_partkey % 5 IN (2, 3) THEN ['p', 'u', 'x', 'f'][p_size % 4 + 1] ELSE 'c' END AS contype
      FROM part)""", ())

S["catalog_views"] = (f"""
SELECT {_K0}, {_NSPNAME} AS schemaname, lower(n_name) AS viewname, 'postgres' AS viewowner,
  concat(' SELECT * FROM region WHERE r_regionkey = ', n_regionkey) AS definition
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 2
UNION ALL
SELECT {_K0}, {_NSPNAME} AS schemaname, concat('v_', p_partkey) AS viewname, 'app' AS viewowner,
  concat(' SELECT * FROM part WHERE p_type = ''', p_type, '''') AS definition
FROM part JOIN region ON p_partkey % 5 = r_regionkey""", ())

S["mysql_columns"] = (f"""
SELECT {_k("concat('db', s_nationkey % 3)")},
  CASE s_suppkey % 20 WHEN 0 THEN 'mysql' WHEN 1 THEN 'sys' ELSE concat('app', s_nationkey % 4) END AS TABLE_SCHEMA,
  concat('t', s_nationkey) AS TABLE_NAME, lower(replace(s_name, '#', '_')) AS COLUMN_NAME,
  s_suppkey // 25 + 1 AS ORDINAL_POSITION, CASE WHEN s_suppkey % 4 = 0 THEN '0' END AS COLUMN_DEFAULT,
  CASE WHEN s_acctbal > 0 THEN 'NO' ELSE 'YES' END AS IS_NULLABLE,
  ['int', 'varchar', 'decimal'][s_suppkey % 3 + 1] AS DATA_TYPE,
  CASE WHEN s_suppkey % 3 = 1 THEN 'utf8mb4_0900_ai_ci' END AS COLLATION_NAME, '' AS COLUMN_COMMENT
FROM supplier""", ())

_FK_SCHEMA = "CASE p_partkey % 20 WHEN 0 THEN 'mysql' WHEN 1 THEN 'sys' ELSE concat('app', p_partkey % 4) END"

S["mysql_referential_constraints"] = (f"""
SELECT {_k("p_brand")}, {_FK_SCHEMA} AS CONSTRAINT_SCHEMA, concat('t', p_partkey % 25) AS TABLE_NAME,
  concat('fk_', p_partkey) AS CONSTRAINT_NAME, {_FK_SCHEMA} AS UNIQUE_CONSTRAINT_SCHEMA,
  'PRIMARY' AS UNIQUE_CONSTRAINT_NAME, ['NO ACTION', 'CASCADE', 'RESTRICT'][p_size % 3 + 1] AS UPDATE_RULE,
  ['NO ACTION', 'CASCADE'][p_size % 2 + 1] AS DELETE_RULE, concat('t', p_size % 25) AS REFERENCED_TABLE_NAME
FROM part""", ())

S["mysql_views"] = (f"""
SELECT {KCOLS}, TABLE_SCHEMA, TABLE_NAME, concat('select * from ', TABLE_NAME, '_base') AS VIEW_DEFINITION,
  CASE WHEN TABLE_ROWS % 2 = 0 THEN 'YES' ELSE 'NO' END AS IS_UPDATABLE, 'NONE' AS CHECK_OPTION,
  'DEFINER' AS SECURITY_TYPE
FROM mysql_tables WHERE TABLE_TYPE = 'VIEW'""", ("mysql_tables",))

# ---- V11 - V14
S["agent_errors"] = ("""
SELECT 'org0' AS organization_id, concat('db', user_id % 3) AS db_key, event_id AS error_id,
  CASE WHEN user_id % 2 = 0 THEN 'PostgresCollectorException' ELSE 'CloudWatchException' END AS name,
  props AS message, concat('Traceback (most recent call last): event ', event_id) AS stacktrace,
  ts AS "timestamp"
FROM events WHERE event_type = 'error'""", ())

S["agent_activity"] = ("""
SELECT 'org0' AS organization_id, concat('db', user_id % 3) AS db_key, min(ts) AS first_seen, max(ts) AS last_seen
FROM events GROUP BY 2""", ())

S["observation_log"] = ("""
SELECT concat('org', user_id % 3) AS organization_id, CAST(user_id AS VARCHAR) AS db_key,
  CASE event_type WHEN 'view' THEN 'db' WHEN 'click' THEN 'table' WHEN 'signup' THEN 'query'
    WHEN 'purchase' THEN 'long_running_query' WHEN 'error' THEN 'schema' END AS obs_type,
  ts AS observation_time, props AS payload, event_id AS id
FROM events""", ())

S["knob_rows"] = (f"""
SELECT {_k("p_brand")}, p_partkey AS ord, replace(p_name, ' ', '_') AS name, CAST(p_size AS VARCHAR) AS setting,
  CASE WHEN p_size % 2 = 0 THEN 'user' ELSE 'engine-default' END AS source,
  ['8.0.22-log', '12 (Ubuntu 12.6)', '5.7.34', '9.6.3', '14.2'][p_partkey % 5 + 1] AS server_version
FROM part""", ())

S["extensions"] = (f"""
SELECT {_k("p_brand")},
  CASE WHEN p_size = 9 AND p_partkey % 2 = 0 THEN 'pg_stat_statements' ELSE 'plpgsql' END AS extname
FROM part""", ())


S["failed_halves"] = ("""
SELECT 'org0' AS organization_id, p_brand AS db_key, TIMESTAMP '2024-01-31 00:00:00' AS observation_time, 'indexes' AS half
FROM part GROUP BY p_brand HAVING count(*) % 2 = 1""", ())


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in S[n][1]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_standins(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs of the named stand-ins (and their deps),
    followed by the ``extra`` (name, sql) CTEs in order."""
    ctes = [f"{n} AS ({S[n][0].strip()})" for n in _closure(names)]
    ctes += [f"{n} AS ({q.strip()})" for n, q in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + body.strip()) if ctes else body.strip()
