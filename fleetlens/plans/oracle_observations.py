"""DuckDB oracles of documents, catalogs, merges and time behaviour."""

from __future__ import annotations

from fleetlens.plans import queries_observations as QO
from fleetlens.plans.oracle_inventory import pack_sql
from fleetlens.plans.oracle_sql import _SCRUB, _STATUS, KC, KEQ, ORACLES, RCD_BODY, TT, _semi
from fleetlens.plans.standin_sql import OBS
from fleetlens.plans.standin_sql import with_standins as W

ORACLES["envelope_explode"] = W(f"""
SELECT 'org0' AS organization_id, concat('db', s_nationkey % 5) AS db_key, 'db0' AS logical_database_name,
  {OBS} AS observation_time, 'supplier' AS item, s_suppkey, s_name, s_nationkey FROM supplier""")

ORACLES["envelope_pack"] = W(
    pack_sql("pk", "pg_stat_user_tables_all_fields", QO.PG_TABLE_COLUMNS, ["relid"], QO.TABLE_PAGE_ROWS),
    "pg_stat_user_tables", extra=[TT, ("pk", _semi("pg_stat_user_tables", "tt", [("relid", "relid")]))])

# Catalog keys of the five (engine, version) pairs, normalised by hand from the rules.
_KEYS = "['postgres-14', 'mysql-8_0', 'aurora_postgresql-12', 'aurora_mysql-5_6', 'aurora_mysql-5_7']"
_CAT = ("cat", f"""
SELECT DISTINCT {_KEYS}[n % 5 + 1] AS engine_key,
  CASE WHEN (length(metric) + n) % 3 = 0 THEN 'cluster' ELSE 'instance' END AS level, metric
FROM (SELECT DISTINCT db_key, metric, CAST(substr(db_key, 3, 8) AS INTEGER) AS n FROM metric_samples)""")
_INST = ("inst", f"""
SELECT db_key, {_KEYS}[n % 5 + 1] AS engine_key, CASE WHEN n % 2 = 0 THEN 'cluster-1' ELSE '' END AS cluster_id
FROM (SELECT DISTINCT db_key, CAST(substr(db_key, 3, 8) AS INTEGER) AS n FROM metric_samples)""")
_LOOKUP = ("lk", """
SELECT DISTINCT i.db_key, i.engine_key, c.level, c.metric FROM inst i JOIN cat c ON i.engine_key = c.engine_key
WHERE c.level = 'instance' OR i.cluster_id <> ''""")

ORACLES["metric_catalog"] = W("SELECT * FROM cat", "metric_samples", extra=[_CAT])
ORACLES["catalog_lookup"] = W("SELECT * FROM lk", "metric_samples", extra=[_CAT, _INST, _LOOKUP])


def _latest(wanted: bool) -> str:
    semi = ("AND EXISTS (SELECT 1 FROM lk w WHERE w.db_key = s.db_key AND w.metric = s.metric)" if wanted else "")
    return f"""
SELECT db_key, metric, arg_max(avg_value, period_start) AS value, max(period_start) AS period_start FROM (
  SELECT db_key, metric, time_bucket(INTERVAL {QO.METRIC_PERIOD_S} SECOND, ts) AS period_start, avg(value) AS avg_value
  FROM metric_samples s
  WHERE ts >= TIMESTAMP '{QO.METRIC_NOW}' - INTERVAL {QO.METRIC_WINDOW_S} SECOND AND ts <= TIMESTAMP '{QO.METRIC_NOW}'
  {semi}
  GROUP BY ALL) GROUP BY ALL"""


ORACLES["latest_metric"] = W(_latest(True), "metric_samples", extra=[_CAT, _INST, _LOOKUP])
ORACLES["metric_source_registry"] = W(_latest(False), "metric_samples")
ORACLES["row_postprocess_registry"] = W(f"SELECT {KC}, pid, {_SCRUB} AS query FROM vacuum_activity_src",
                                        "vacuum_activity_src")

# ------------------------------------------------------------------ heartbeat --
_IV = QO.HEARTBEAT_INTERVAL_S
# A beat at start + k * interval for every k until the agent is last seen; what comes later or with the last beat
# belongs to the last one.
_ACT = ("act", f"""
SELECT organization_id, db_key, first_seen AS agent_starttime,
  greatest(1, (epoch_us(last_seen) - epoch_us(first_seen) + {_IV * 1_000_000 - 1}) // {_IV * 1_000_000}) AS n
FROM agent_activity""")
_BEATS = ("beats", f"""
SELECT organization_id, db_key, agent_starttime, beat, agent_starttime + to_seconds(beat * {_IV}) AS heartbeat_time,
  beat = n AS is_last
FROM (SELECT *, unnest(range(1, n + 1)) AS beat FROM act)""")
_ERRS = ("errs", """
SELECT e.organization_id, e.db_key,
  coalesce(min(b.heartbeat_time), any_value(l.heartbeat_time)) AS heartbeat_time,
  e.error_id, e.name, e.message, e.stacktrace, e."timestamp"
FROM agent_errors e JOIN (SELECT * FROM beats WHERE is_last) l USING (organization_id, db_key)
LEFT JOIN beats b ON e.organization_id = b.organization_id AND e.db_key = b.db_key AND b.heartbeat_time > e."timestamp"
GROUP BY ALL""")
ORACLES["heartbeat_errors"] = W("SELECT * FROM errs", "agent_errors", "agent_activity", extra=[_ACT, _BEATS, _ERRS])
_ISO = "CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
ORACLES["agent_heartbeat"] = W("""
SELECT b.organization_id, b.db_key, b.agent_starttime, b.heartbeat_time,
  CASE WHEN b.is_last AND coalesce(c.n, 0) > 0 THEN 'terminating_error' WHEN b.is_last THEN 'terminating_ok'
       WHEN coalesce(c.n, 0) > 0 THEN 'error' ELSE 'ok' END AS agent_status,
  coalesce(c.n, 0) AS n_errors
FROM beats b LEFT JOIN (SELECT organization_id, db_key, heartbeat_time, count(*)::BIGINT AS n FROM errs GROUP BY ALL) c
  ON b.organization_id = c.organization_id AND b.db_key = c.db_key AND b.heartbeat_time = c.heartbeat_time""",
                               "agent_errors", "agent_activity", extra=[_ACT, _BEATS, _ERRS])

ORACLES["heartbeat_document"] = W(f"""
SELECT b.organization_id, b.db_key, b.heartbeat_time, coalesce(c.page, 0)::BIGINT AS page,
  CAST(to_json({{'organization_id': b.organization_id, 'db_key': b.db_key,
    'agent_status': CASE WHEN b.is_last AND c.page IS NOT NULL THEN 'terminating_error' WHEN b.is_last THEN 'terminating_ok'
       WHEN c.page IS NOT NULL THEN 'error' ELSE 'ok' END,
    'agent_starttime': {_ISO.format(c="b.agent_starttime")}, 'heartbeat_time': {_ISO.format(c="b.heartbeat_time")},
    'agent_version': '{QO.AGENT_VERSION}', 'errors': coalesce(c.errors, [])}}) AS VARCHAR) AS document
FROM beats b LEFT JOIN (
  SELECT organization_id, db_key, heartbeat_time, page,
    list({{'data': {{'name': name, 'message': message, 'stacktrace': stacktrace}},
           'timestamp': {_ISO.format(c='"timestamp"')}}} ORDER BY "timestamp", error_id) AS errors
  FROM paged GROUP BY ALL) c
  ON b.organization_id = c.organization_id AND b.db_key = c.db_key AND b.heartbeat_time = c.heartbeat_time""",
    "agent_errors", "agent_activity", extra=[_ACT, _BEATS, _ERRS, ("paged", f"""
SELECT *, CAST((row_number() OVER (PARTITION BY organization_id, db_key, heartbeat_time ORDER BY "timestamp", error_id) - 1)
  // {QO.ERROR_PAGE_ROWS} AS BIGINT) AS page FROM errs""")])

# ------------------------------------------------------------------ landing --
_TYPE_DIR = ("CASE WHEN lower(obs_type) IN ('db', 'table', 'query', 'long_running_query', 'schema') "
             "THEN upper(obs_type) ELSE 'UNKNOWN' END")
ORACLES["observation_landing"] = W(f"""
SELECT organization_id, db_key, {_TYPE_DIR} AS type_dir, strftime(observation_time, '%Y%m%d') AS dt,
  strftime(observation_time, '%H') AS hr, id,
  concat_ws('/', organization_id, db_key, {_TYPE_DIR}, strftime(observation_time, '%Y%m%d'),
            strftime(observation_time, '%H'), 'data') AS object_key
FROM observation_log""", "observation_log")
ORACLES["observation_serialize"] = W("""
SELECT id, obs_type, to_json({'data': json(payload), 'summary': {'observation_time': epoch_us(observation_time) // 1000000},
  'db_key': db_key, 'organization_id': organization_id}) AS document
FROM observation_log""", "observation_log")
ORACLES["hourly_latest"] = W("""
SELECT organization_id, db_key, obs_type, hour, observation_time, id, payload FROM (
  SELECT *, date_trunc('hour', observation_time) AS hour,
    row_number() OVER (PARTITION BY organization_id, db_key, obs_type, date_trunc('hour', observation_time)
                       ORDER BY observation_time DESC, id DESC) AS rn
  FROM observation_log) WHERE rn = 1""", "observation_log")

# ------------------------------------------------------------------ merges --
_EXT = ("ext", f"""
SELECT 'org0' AS organization_id, CAST(user_id AS VARCHAR) AS db_key, 'db0' AS logical_database_name,
  {OBS} AS observation_time, 'com_select' AS name, CAST(count_if(event_type = 'click') * 10 AS VARCHAR) AS value
FROM events GROUP BY user_id
UNION ALL
SELECT 'org0', CAST(user_id AS VARCHAR), 'db0', {OBS}, 'cpuutilization', CAST(count(*) AS VARCHAR)
FROM events GROUP BY user_id""")
ORACLES["metric_source_merge"] = W(f"""
SELECT {KC}, name, arg_max(value, p) AS value FROM (
  SELECT *, 0 AS p FROM status UNION ALL SELECT *, 1 AS p FROM ext) GROUP BY ALL""",
                                   "mysql_status", extra=[_STATUS, _EXT])

_RC = ["num_tables", "num_empty_tables", "num_tables_row_count_0_10k", "num_tables_row_count_10k_100k",
       "num_tables_row_count_100k_1m", "num_tables_row_count_1m_10m", "num_tables_row_count_10m_100m",
       "num_tables_row_count_100m_inf", "max_row_num", "min_row_num"]
ORACLES["observation_assemble"] = W(f"""
SELECT {", ".join("s." + c for c in KC.split(", "))},
  regexp_replace(regexp_replace(CAST(to_json({{'row_num_stats': {{{", ".join(f"'{c}': r.{c}" for c in _RC)}}},
           'table_counters': {{'n_live_tup': CAST(t.n_live_tup AS BIGINT), 'seq_scan': CAST(t.seq_scan AS BIGINT),
                               'idx_scan': CAST(t.idx_scan AS BIGINT)}},
           'index_counters': {{'idx_scan': CAST(i.idx_scan AS BIGINT), 'idx_tup_read': CAST(i.idx_tup_read AS BIGINT)}}
          }}) AS VARCHAR), '"[a-z_0-9]+":null,', '', 'g'), ',"[a-z_0-9]+":null', '', 'g') AS document
FROM pg_snapshot_spine s
LEFT JOIN rc r ON {KEQ("s", "r")}
LEFT JOIN (SELECT {KC}, sum(n_live_tup) AS n_live_tup, sum(seq_scan) AS seq_scan, sum(idx_scan) AS idx_scan
           FROM pg_stat_user_tables GROUP BY ALL) t ON {KEQ("s", "t")}
LEFT JOIN (SELECT {KC}, sum(idx_scan) AS idx_scan, sum(idx_tup_read) AS idx_tup_read
           FROM pg_stat_user_indexes GROUP BY ALL) i ON {KEQ("s", "i")}""",
                                    "pg_snapshot_spine", "pg_stat_user_tables", "pg_stat_user_indexes",
                                    extra=[("rc", RCD_BODY)])
ORACLES["logical_db_union"] = W("""
SELECT organization_id, db_key, observation_time, relid, n_live_tup,
  CASE WHEN logical_database_name = 'db2' THEN NULL ELSE n_dead_tup END AS n_dead_tup, logical_database_name
FROM pg_stat_user_tables WHERE logical_database_name IN ('db0', 'db1', 'db2')""", "pg_stat_user_tables")
ORACLES["replication_status"] = W(f"""
SELECT {", ".join("s." + c for c in KC.split(", "))},
  CASE WHEN r.db_key IS NULL THEN '' ELSE CAST(to_json({{'Source_Host': r.host, 'Seconds_Behind_Source': r.n}}) AS VARCHAR) END
    AS replica_status,
  CASE WHEN m.db_key IS NULL THEN '' ELSE CAST(to_json({{'File': m.file, 'Position': m.n}}) AS VARCHAR) END AS master_status
FROM (SELECT DISTINCT {KC} FROM mysql_status) s
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS db_key, concat('replica-', user_id) AS host, count(*)::BIGINT AS n
           FROM events GROUP BY user_id HAVING count_if(event_type = 'signup') > 0) r ON s.db_key = r.db_key
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS db_key, concat('binlog.', user_id) AS file, count(*)::BIGINT AS n
           FROM events GROUP BY user_id HAVING count_if(event_type = 'purchase') > 0) m ON s.db_key = m.db_key""", "mysql_status")

# ------------------------------------------------------------------ streaming --
ORACLES["snapshot_counters_stream"] = ORACLES["row_count_distribution"]
ORACLES["latest_metric_stream"] = ORACLES["latest_metric"]
ORACLES["heartbeat_stream"] = ORACLES["agent_heartbeat"]
ORACLES["heartbeat_stateful_stream"] = ORACLES["agent_heartbeat"]
ORACLES["long_running_stream"] = __import__("fleetlens.plans.oracle_sql", fromlist=["x"]).ORACLES["long_running_pg"]
ORACLES["landing_stream"] = W(f"""
SELECT organization_id, db_key, {_TYPE_DIR} AS type_dir, strftime(observation_time, '%Y%m%d') AS dt,
  strftime(observation_time, '%H') AS hr, obs_type, observation_time, payload, id
FROM observation_log""", "observation_log")
