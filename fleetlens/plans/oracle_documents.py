"""DuckDB oracles of whole documents, discovered envelopes and the shared target set."""

from __future__ import annotations

from fleetlens.operators import documents as D
from fleetlens.operators import inventory as INV
from fleetlens.operators import rollups as R
from fleetlens.operators import topn as T
from fleetlens.plans import oracle_inventory as OI
from fleetlens.plans import oracle_observations as OO
from fleetlens.plans import oracle_sql as OS
from fleetlens.plans import queries as Q
from fleetlens.plans import queries_documents as QD
from fleetlens.plans.oracle_sql import KC, KEQ, ORACLES
from fleetlens.plans.queries_inventory import PG_SCHEMA_ITEMS
from fleetlens.plans.standin_sql import with_standins as W
from fleetlens.sources.standins import DIGEST_COUNTERS

DOC = "organization_id, db_key, observation_time"
_TIMES = {"last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze", "FIRST_SEEN", "LAST_SEEN", "backend_start",
          "query_start", "state_change", "xact_start"}


def _text_time(c: str) -> str:
    return (f"CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")


def _value(c: str) -> str:
    return _text_time(f'"{c}"') if c in _TIMES else f'"{c}"'


# ------------------------------------------------------- discovered envelopes --
# Columns in the engine's order with their JSON type.
_PG_INDEX = [("indexrelid", "BIGINT"), ("indrelid", "BIGINT"), ("indnatts", "BIGINT"), ("indnkeyatts", "BIGINT"),
             ("indisunique", "BOOLEAN"), ("indisprimary", "BOOLEAN"), ("indisexclusion", "BOOLEAN"),
             ("indimmediate", "BOOLEAN"), ("indisclustered", "BOOLEAN"), ("indisvalid", "BOOLEAN"),
             ("indcheckxmin", "BOOLEAN"), ("indisready", "BOOLEAN"), ("indislive", "BOOLEAN"),
             ("indisreplident", "BOOLEAN"), ("indkey", "STRING"), ("indcollation", "STRING"), ("indclass", "STRING"),
             ("indoption", "STRING"), ("indexprs", "STRING"), ("indpred", "STRING")]
_DIGEST = [("SCHEMA_NAME", "STRING"), ("DIGEST", "STRING"), ("DIGEST_TEXT", "STRING"),
           *[(c, "BIGINT") for c in ["COUNT_STAR", "SUM_TIMER_WAIT", "MIN_TIMER_WAIT", "AVG_TIMER_WAIT", "MAX_TIMER_WAIT",
                                     *DIGEST_COUNTERS[:4], "SUM_ROWS_SENT", *DIGEST_COUNTERS[4:]]],
           ("FIRST_SEEN", "STRING"), ("LAST_SEEN", "STRING")]
_TABLES = [("relid", "BIGINT"), ("schemaname", "STRING"), ("relname", "STRING"),
           *[(c, "BIGINT") for c in ["seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch", "n_tup_ins", "n_tup_upd",
                                     "n_tup_del", "n_tup_hot_upd", "n_live_tup", "n_dead_tup", "n_mod_since_analyze"]],
           *[(c, "STRING") for c in ["last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze"]],
           *[(c, "BIGINT") for c in ["vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count"]]]
_FOUND = {"pg_index_all_fields": ("pg_index", _PG_INDEX), "events_statements_summary_by_digest": ("mysql_digests", _DIGEST),
          "pg_stat_user_tables_all_fields": ("pg_stat_user_tables", _TABLES)}

ORACLES["envelope_schema"] = W("\nUNION ALL\n".join(
    f"SELECT '{item}' AS item, CAST({at} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type "
    f"WHERE EXISTS (SELECT 1 FROM {rel})"
    for item, (rel, cols) in _FOUND.items() for at, (c, t) in enumerate(cols, 1)), *[rel for rel, _ in _FOUND.values()])
for _key, _item in (("index_catalog_round_trip", "pg_index_all_fields"),
                    ("digest_round_trip", "events_statements_summary_by_digest"),
                    ("table_stats_round_trip", "pg_stat_user_tables_all_fields")):
    _rel, _cols = _FOUND[_item]
    ORACLES[_key] = W(f"SELECT {KC}, " + ", ".join(f'{_value(c)} AS "{c}"' for c, _ in _cols) + f" FROM {_rel}", _rel)


# ---------------------------------------------------------------- documents ----
def _eq(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys.split(", "))


def doc_sql(spine: str, items: list[tuple[str, str, list[str], str, str]], unknown: tuple = (), failed: str = "",
            keys: str = DOC, page_rows: int = QD.DOC_PAGE_ROWS) -> str:
    """DuckDB text of ``documents.documents``: items are (name, relation, columns, order, half); names may repeat."""
    pages, parts, seen = [], [], set()
    for name, rel, cols, order, half in items:
        names = '{"columns":[' + ",".join(f'"{c}"' for c in cols) + '],"rows":['
        row = "to_json([" + ", ".join(f"to_json({_value(c)})" for c in cols) + "])"
        pages.append(f"""
  SELECT {keys}, '{name}' AS item, CAST((pos - 1) // {page_rows} AS BIGINT) AS page,
    '{names}' || string_agg(CAST(r AS VARCHAR), ',' ORDER BY pos) || ']}}' AS payload
  FROM (SELECT {keys}, {row} AS r, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS pos FROM {rel})
  GROUP BY ALL""")
        if name in seen:
            continue
        seen.add(name)
        empty = '{"columns":[' + (",".join(f'"{c}"' for c in cols) if name not in unknown else "") + '],"rows":[]}'
        off = f"f.half = '{half}'" if failed else "false"
        parts.append(f"""CASE WHEN {off} THEN NULL ELSE '"{name}":' || coalesce(max(CASE WHEN p.item = '{name}' THEN p.payload END),
      CASE WHEN coalesce(p.page, 0) = 0 THEN '{empty}' END) END""")
    k = ", ".join(f"s.{c}" for c in keys.split(", "))
    fail_join = f"LEFT JOIN {failed} f ON {_eq('s', 'f', keys)}" if failed else ""
    return f"""
SELECT {keys}, page, '{{"data":{{' || data || '}},"summary":{{"version":"' || version || '","observation_time":'
  || epoch_us(observation_time) // 1000000 || '}},"db_key":' || to_json(db_key) || ',"organization_id":'
  || to_json(organization_id) || '}}' AS document
FROM (
  SELECT {k}, s.version, coalesce(p.page, 0) AS page, concat_ws(',', {", ".join(parts)}) AS data
  FROM ({spine}) s LEFT JOIN ({" UNION ALL ".join(pages)}) p ON {_eq("s", "p", keys)} {fail_join}
  GROUP BY {k}, s.version, p.page{", f.half" if failed else ""})
WHERE page = 0 OR data <> ''"""


def _spine_sql(rels: list[str], version: str, keys: str = DOC) -> str:
    return f"SELECT DISTINCT *, {version} AS version FROM (" + " UNION ALL ".join(
        f"SELECT {keys} FROM {r}" for r in rels) + ")"


_PGV = f"'{QD.PG_VERSION}'"
_MYV = f"'{QD.MYSQL_VERSION}'"
_DBV = ("CASE WHEN regexp_matches(db_key, '^db[0-9]+$') THEN ['9.6.3', '11.2', '12.4', '13.1', '14.2']"
        f"[TRY_CAST(substr(db_key, 3, 8) AS INTEGER) % 5 + 1] ELSE {_PGV} END")
_L = "logical_database_name"
_MANY = ("pg_stat_user_tables", "pg_statio_user_tables", "pg_table_size_facts", "pg_stat_user_indexes", "pg_index",
         "pg_snapshot_spine", "failed_halves")

_table_cols = [c for c, _ in _TABLES]
_io = ["relid", *OS._IO_COLS]
_ORD = f"{_L}, relid"
_IORD = f"{_L}, indexrelid"
ORACLES["table_document"] = W(doc_sql(_spine_sql(["pg_snapshot_spine", "server_settings"], _PGV), [
    ("pg_stat_user_tables_all_fields", "dt", [*_table_cols, _L], _ORD, "tables"),
    ("pg_statio_user_tables_all_fields", "dio", [*_io, _L], _ORD, "tables"),
    ("pg_stat_user_tables_table_sizes", "dsz", ["relid", "indexes_size", "relation_size", "toast_size", _L], _ORD, "tables"),
    ("table_bloat_ratios", "dbl", ["relid", "bloat_ratio", _L], _ORD, "tables"),
    ("pg_stat_user_indexes_all_fields", "dix", ["relid", "indexrelid", "schemaname", "relname", "indexrelname", "idx_scan",
                                                "idx_tup_read", "idx_tup_fetch", _L], _IORD, "indexes"),
    ("pg_statio_user_indexes_all_fields", "dix", ["indexrelid", "idx_blks_read", "idx_blks_hit", _L], _IORD, "indexes"),
    ("pg_index_all_fields", "dca", [*[c for c, _ in _PG_INDEX], _L], _IORD, "indexes"),
    ("indexes_size", "ti", ["indexrelid", "index_size", _L], f"{_L}, rank", "indexes")], failed="failed_halves"),
    *_MANY, *OS._BLOAT_DEPS, extra=[
        OS.TT, OS.TI,
        ("dt", OS._semi("pg_stat_user_tables", "tt", [("relid", "relid")])),
        ("dio", OS._semi("pg_statio_user_tables", "tt", [("relid", "relid")])),
        ("dsz", OS._semi("(SELECT *, table_size - relation_size AS toast_size FROM pg_table_size_facts)", "tt",
                         [("relid", "relid")])),
        ("dix", OS._semi("pg_stat_user_indexes", "ti", [("indexrelid", "indexrelid")])),
        ("dca", OS._semi("pg_index", "ti", [("indexrelid", "indexrelid")])),
        OS.BT, OS._FACTOR_JOIN, OS._FACTORS, OS._width_join(True), OS._REC, OS._PADDING, OS._WITH_PAD, ("dbl", OS._RATIO)])

_USAGE = ["OBJECT_TYPE", "OBJECT_SCHEMA", "OBJECT_NAME", "INDEX_NAME", "COUNT_STAR", "SUM_TIMER_WAIT", "COUNT_READ",
          "SUM_TIMER_READ", "COUNT_WRITE", "SUM_TIMER_WRITE", "COUNT_FETCH", "SUM_TIMER_FETCH", "COUNT_INSERT",
          "SUM_TIMER_INSERT", "COUNT_UPDATE", "SUM_TIMER_UPDATE", "COUNT_DELETE", "SUM_TIMER_DELETE"]
_NAMED = [("DATABASE_NAME", "DATABASE_NAME"), ("TABLE_NAME", "TABLE_NAME"), ("INDEX_NAME", "INDEX_NAME")]
ORACLES["table_document_mysql"] = W(doc_sql(_spine_sql(["pg_snapshot_spine"], _MYV), [
    ("information_schema_TABLES", "ttm", T.MYSQL_TABLE_COLUMNS, "rank", "tables"),
    ("information_schema_STATISTICS", "dst", D.MYSQL_STATISTICS, "TABLE_SCHEMA, TABLE_NAME, INDEX_NAME, SEQ_IN_INDEX",
     "indexes"),
    ("performance_schema_table_io_waits_summary_by_index_usage", "dus", _USAGE, "OBJECT_SCHEMA, OBJECT_NAME, INDEX_NAME",
     "indexes"),
    ("indexes_size", "tim", D.MYSQL_INDEX_SIZE, "rank", "indexes")], failed="failed_halves"),
    "mysql_tables", "mysql_index_stats", "mysql_statistics", "mysql_index_usage", "pg_snapshot_spine", "failed_halves",
    extra=[OS.TTM, OS.TIM,
           ("dst", OS._semi("mysql_statistics", "tim", [("TABLE_SCHEMA", "DATABASE_NAME"), *_NAMED[1:]])),
           ("dus", OS._semi("(SELECT * FROM mysql_index_usage WHERE OBJECT_TYPE = 'TABLE')", "tim",
                            [("OBJECT_SCHEMA", "DATABASE_NAME"), ("OBJECT_NAME", "TABLE_NAME"), _NAMED[2]]))])

_ST = ["userid", "dbid", "queryid", "query", "calls", "rows", "shared_blks_hit", "shared_blks_read", "mean_exec_time",
       "mean_time", "blk_read_time"]
_TOP_PG = ("tops", ORACLES["top_statements_pg"][ORACLES["top_statements_pg"].rindex("SELECT * FROM (SELECT *"):])
ORACLES["query_document"] = W(doc_sql(_spine_sql(["pg_server_spine"], _DBV), [
    ("pg_stat_statements", f"(SELECT * FROM tops WHERE {OS._at_least(13)})", [c for c in _ST if c != "mean_time"], "rank", "q"),
    ("pg_stat_statements", f"(SELECT * FROM tops WHERE NOT {OS._at_least(13)})", [c for c in _ST if c != "mean_exec_time"],
     "rank", "q")], unknown=("pg_stat_statements",)), "pg_stat_statements", "pg_server_spine", extra=[_TOP_PG])
_TOP_MY = ("topd", ORACLES["top_statements_mysql"][ORACLES["top_statements_mysql"].rindex("SELECT * FROM (SELECT *"):])
ORACLES["query_document_mysql"] = W(doc_sql(_spine_sql(["pg_server_spine"], _MYV), [
    ("events_statements_summary_by_digest", "topd", [c for c, _ in _DIGEST], "rank", "q")]),
    "mysql_digests", "pg_server_spine", extra=[_TOP_MY])

_LR = ["pid", "query_id", "backend_start", "query_start", "datid", "datname", "state", "state_change", "wait_event",
       "wait_event_type", "backend_type", "xact_start"]
_LRS = ("lr", f"""
SELECT * FROM (
  SELECT *, {OS._rank("query_start ASC, pid ASC")} AS rn FROM pg_stat_activity
  WHERE query_start < observation_time - to_minutes({Q.LR_MINUTES_PG})) WHERE rn <= {Q.N_LONG_RUNNING}""")
ORACLES["long_running_document"] = W(doc_sql(_spine_sql(["pg_server_spine"], _DBV), [
    ("pg_stat_activity", f"(SELECT * FROM lr WHERE {OS._at_least(14)})", _LR, "query_start, pid", "s"),
    ("pg_stat_activity", f"(SELECT * FROM lr WHERE NOT {OS._at_least(14)})", [c for c in _LR if c != "query_id"],
     "query_start, pid", "s")]), "pg_stat_activity", "pg_server_spine", extra=[_LRS])
_CUR = ["THREAD_ID", "EVENT_ID", "EVENT_NAME", "TIMER_START", "TIMER_END", "TIMER_WAIT", "LOCK_TIME", "DIGEST",
        "DIGEST_TEXT", "ROWS_AFFECTED", "ROWS_SENT", "ROWS_EXAMINED", "CREATED_TMP_DISK_TABLES", "CREATED_TMP_TABLES",
        "SELECT_FULL_JOIN", "SELECT_FULL_RANGE_JOIN", "SELECT_RANGE", "SELECT_RANGE_CHECK", "SELECT_SCAN",
        "SORT_MERGE_PASSES", "SORT_RANGE", "SORT_ROWS", "SORT_SCAN", "NO_INDEX_USED", "NO_GOOD_INDEX_USED"]
_LRM = ("lrm", f"""
SELECT * FROM (
  SELECT *, {OS._rank("TIMER_WAIT DESC, THREAD_ID ASC")} AS rn FROM mysql_current_statements
  WHERE DIGEST IS NOT NULL AND TIMER_WAIT > {Q.LR_MINUTES_MYSQL} * 60000000000000) WHERE rn <= {Q.N_LONG_RUNNING}""")
ORACLES["long_running_document_mysql"] = W(doc_sql(_spine_sql(["pg_server_spine"], _MYV), [
    ("events_statements_current", "lrm", _CUR, "TIMER_WAIT, THREAD_ID, EVENT_ID", "s")]),
    "mysql_current_statements", "pg_server_spine", extra=[_LRM])


def _order(cols: list[str]) -> str:
    return ", ".join((f'NOT "{c[1:]}"' if c.startswith("!") else f'"{c}"') + " NULLS FIRST" for c in cols)


ORACLES["schema_document"] = W(doc_sql(_spine_sql(["catalog_class"], _PGV), [
    (k, OI._SRC[k], cols, _order(order), "schema") for k, (cols, order) in PG_SCHEMA_ITEMS.items()]),
    *OI._CAT, extra=[OI._COLS, OI._IDX, OI._FK, OI._TBL, OI._VIEWS, OI._IXC])
_MYREL = {"columns": "mysql_columns", "indexes": "mysql_statistics", "foreign_keys": "mysql_referential_constraints",
          "tables": "mysql_tables", "views": "mysql_views"}
ORACLES["schema_document_mysql"] = W(doc_sql(_spine_sql(["pg_snapshot_spine", "mysql_columns"], _MYV), [
    (k, f"(SELECT * FROM {_MYREL[k]} WHERE {OI._MYSYS.format(c=schema)})", cols, _order(order), "schema")
    for k, (_, schema, cols, order) in QD.MYSQL_SCHEMA_ITEMS.items()]), *_MYREL.values(), "pg_snapshot_spine")


# ---------------------------------------------------------- database documents --
def _object(source: str, keys: str, name: str, value: str) -> str:
    """A JSON object per ``keys`` with its names in order."""
    return (f"SELECT {keys}, to_json(map_from_entries(list({{'k': CAST({name} AS VARCHAR), 'v': {value}}} ORDER BY {name}))) "
            f"AS value FROM ({source}) GROUP BY ALL")


def _long(src: str, cols: list[str], more: str = "", keys: str = KC) -> str:
    return " UNION ALL ".join(f"SELECT {keys}{more}, '{c}' AS name, to_json({c}) AS value FROM {src} WHERE {c} IS NOT NULL"
                              for c in cols)


def _counter_sql(rel: str, cols: list[str]) -> str:
    return f"(SELECT {KC}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in cols)} FROM {rel} GROUP BY ALL)"


def _text(body: str) -> str:
    """A JSON text as a string value of the tree."""
    return f"to_json(CAST({body} AS VARCHAR))"


_VIEW = ", '{c}' AS category, '{v}' AS view"
_COUNTERS = [("database", "pg_stat_database", "pg_stat_database", R.DB_COUNTERS),
             ("database", "pg_stat_database_conflicts", "pg_stat_database", R.DB_CONFLICTS),
             ("table", "pg_stat_user_tables", "pg_stat_user_tables", R.TABLE_COUNTERS),
             ("table", "pg_statio_user_tables", "pg_statio_user_tables", R.TABLE_IO_COUNTERS),
             ("index", "pg_stat_user_indexes", "pg_stat_user_indexes", R.INDEX_COUNTERS),
             ("index", "pg_statio_user_indexes", "pg_stat_user_indexes", R.INDEX_IO_COUNTERS)]
_ISO_AV = OO._ISO.format(c="last_autovacuum")
_VACUUM = OS.ORACLES["vacuum_activity"][OS.ORACLES["vacuum_activity"].rindex("\nSELECT"):]
_PROGRESS = OS.ORACLES["vacuum_progress"][OS.ORACLES["vacuum_progress"].rindex("\nSELECT"):]
_VTABLES = OS._semi("pg_stat_user_tables", "pg_stat_progress_vacuum", [("relid", "relid")],
                    f"{', '.join('t.' + c for c in KC.split(', '))}, t.relid, {_ISO_AV.replace('last_', 't.last_')} AS "
                    "last_autovacuum, t.n_dead_tup, t.relname")
_LOCAL = " UNION ALL ".join(
    [_long(_counter_sql(rel, cols), cols, _VIEW.format(c=cat, v=view) + ", 'aggregated' AS key")
     for cat, view, rel, cols in _COUNTERS]
    + [_long(f"({sql})", cols, _VIEW.format(c=cat, v=view) + f", CAST({key} AS VARCHAR) AS key")
       for sql, cols, cat, view, key in (
           (_VACUUM, ["usename", "datid", "datname", "pid", "wait_event_type", "wait_event", "state", "query"], "process",
            "pg_stat_vacuum_activity", "pid"),
           (_PROGRESS, ["pid", "relid", "phase", "heap_blks_total"], "process", "pg_stat_progress_vacuum", "pid"),
           (_VTABLES, ["relid", "last_autovacuum", "n_dead_tup", "relname"], "table", "pg_stat_vacuum_tables", "relid"))])


def _statements(src: str, queryid: str) -> str:
    """The statement list as JSON text: null fields left out."""
    rec = (f"'{{' || concat_ws(',', '\"queryid\":' || to_json({queryid}), '\"calls\":' || calls, "
           "'\"avg_time_ms\":' || avg_time_ms) || '}'")
    order = f"{queryid} NULLS FIRST, calls, avg_time_ms NULLS FIRST"
    return f"SELECT {KC}, {_text(f''' '[' || string_agg({rec}, ',' ORDER BY {order}) || ']' ''')} AS value FROM {src} GROUP BY ALL"


def _rounded(key: str) -> str:
    body = ORACLES[key][ORACLES[key].rindex("\nSELECT"):]
    return f"(SELECT {KC}, queryid, calls, CAST(round(avg_time_ms * 1000) AS BIGINT) AS avg_time_ms FROM ({body}))"


def _db_doc(spine: str, glob: str, local: str, rows: str, empty: str) -> str:
    s = ", ".join(f"s.{c}" for c in KC.split(", "))
    return f"""
SELECT {s}, '{{"db_key":' || to_json(s.db_key) || ',"knobs_data":{{"global":{{"global":' || coalesce(CAST(kn.value AS VARCHAR), '{{}}')
  || '}},"local":null}},"metrics_data":{{"global":' || coalesce(CAST(g.value AS VARCHAR), '{empty}') || ',"local":' || {local}
  || '}},"non_default_knobs":' || coalesce(CAST(par.value AS VARCHAR), '[]') || ',"organization_id":' || to_json(s.organization_id)
  || ',"row_num_stats":' || {rows} || ',"summary":{{"observation_time":' || epoch_us(s.observation_time) // 1000000
  || ',"version":"' || s.version || '"}}}}' AS document
FROM ({spine}) s LEFT JOIN kn ON {KEQ("s", "kn")} LEFT JOIN g ON {KEQ("s", "g")} LEFT JOIN loc l ON {KEQ("s", "l")}
LEFT JOIN rs r ON {KEQ("s", "r")} LEFT JOIN par ON {KEQ("s", "par")}"""


_KN = ("kn", _object(f"SELECT {KC}, name, arg_max(setting, ord) AS setting FROM knob_rows WHERE name IS NOT NULL GROUP BY ALL",
                     KC, "name", "to_json(setting)"))
_PAR = ("par", f"SELECT {KC}, to_json(list(DISTINCT name ORDER BY name)) AS value FROM knob_rows "
               "WHERE source = 'user' AND name IS NOT NULL GROUP BY ALL")
_RS_COLS = sorted(R.ROW_COUNT_COLUMNS)
_RS = ("rs", "SELECT *, " + "'{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || {c}" for c in _RS_COLS)
       + f") || '}}' AS value FROM ({OS.RCD_BODY}) WHERE num_tables > 0")
_CATS = sorted(D.PG_CATEGORIES)
_LOC = [("lv", _LOCAL), ("l1", _object("SELECT * FROM lv", f"{KC}, category, view, key", "name", "value")),
        ("l2", _object("SELECT * FROM l1", f"{KC}, category, view", "key", "value")),
        ("l3", _object("SELECT * FROM l2", f"{KC}, category", "view", "value")),
        ("loc", f"SELECT {KC}, '{{' || " + " || ',' || ".join(
            f"'\"{c}\":' || coalesce(max(CASE WHEN category = '{c}' THEN CAST(value AS VARCHAR) END), '{{}}')" for c in _CATS)
         + " || '}' AS value FROM l3 GROUP BY ALL")]
_GV = ("gv", f"""
SELECT {KC}, 'pg_stat_bgwriter' AS view, name, value FROM ({_long(
    f"(SELECT * FROM pg_stat_bgwriter QUALIFY count(*) OVER (PARTITION BY {KC}) = 1)",
    ["checkpoints_timed", "checkpoints_req"])})
UNION ALL
SELECT * FROM (SELECT {KC}, 'pg_stat_statements' AS view, 'statements' AS name, value
  FROM ({_statements(_rounded("statement_latency_pg"), "queryid")}))""")
_BARE = "{" + ",".join(f'"{c}":{{}}' for c in _CATS) + "}"
ORACLES["db_document"] = W(
    _db_doc(_spine_sql(["pg_server_spine", "pg_snapshot_spine"], _DBV, KC), "g", f"coalesce(l.value, '{_BARE}')",
            "coalesce(r.value, '{}')", "{}"),
    "pg_server_spine", "pg_snapshot_spine", "knob_rows", "pg_stat_bgwriter", "pg_stat_statements", "pg_stat_database",
    "pg_stat_user_tables", "pg_statio_user_tables", "pg_stat_user_indexes", "vacuum_activity_src", "vacuum_own_sessions",
    "pg_stat_progress_vacuum",
    extra=[_KN, _PAR, _RS, *_LOC, _GV, ("g1", _object("SELECT * FROM gv", f"{KC}, view", "name", "value")),
           ("g", _object("SELECT * FROM g1", KC, "view", "value"))])

_MERGED = ORACLES["metric_source_merge"][ORACLES["metric_source_merge"].rindex("\nSELECT " + KC + ", name, arg_max"):]
_RATIOS = ORACLES["derived_ratios"][ORACLES["derived_ratios"].rindex("\nSELECT " + KC + ",\n  CASE WHEN requests"):]
_REPL = ORACLES["replication_status"][ORACLES["replication_status"].rindex("\nSELECT s.organization_id"):]
_MCATS = sorted(D.MYSQL_CATEGORIES)
_MV = ("mv", f"""
SELECT {KC}, 'global' AS category, name, to_json(value) AS value FROM ({_MERGED})
UNION ALL SELECT {KC}, 'innodb_metrics', name, to_json(count) FROM innodb_metrics WHERE subsystem = 'transaction'
UNION ALL SELECT {KC}, 'derived', name, value FROM ({_long(f"({_RATIOS})", ["buffer_miss_ratio", "read_write_ratio"])})
UNION ALL SELECT {KC}, 'engine', name, value FROM ({_long(f"({_REPL})", ["replica_status", "master_status"])})
UNION ALL SELECT {KC}, 'performance_schema', 'events_statements_summary_by_digest', value
  FROM ({_statements(_rounded("statement_latency_mysql"), "queryid")})""")
_MBARE = "{" + ",".join(f'"{c}":{{}}' for c in _MCATS) + "}"
ORACLES["db_document_mysql"] = W(
    _db_doc(_spine_sql(["mysql_status", "mysql_digests", "knob_rows"], _MYV, KC), "g", "'null'", "'{}'", _MBARE),
    "mysql_status", "mysql_digests", "knob_rows", "innodb_metrics",
    extra=[OS._STATUS, OO._EXT, _KN, _PAR, _MV, ("m1", _object("SELECT * FROM mv", f"{KC}, category", "name", "value")),
           ("g", f"SELECT {KC}, '{{' || " + " || ',' || ".join(
               f"'\"{c}\":' || coalesce(max(CASE WHEN category = '{c}' THEN CAST(value AS VARCHAR) END), '{{}}')" for c in _MCATS)
            + " || '}' AS value FROM m1 GROUP BY ALL"),
           ("loc", f"SELECT {KC}, NULL AS value FROM mysql_status LIMIT 0"),
           ("rs", f"SELECT {KC}, NULL AS value FROM mysql_status LIMIT 0")])

ORACLES["column_set_union"] = W(f"""
SELECT {KC}, relid, relname, n_live_tup, CASE WHEN {_L} IN ('db0', 'db1') THEN n_dead_tup END AS n_dead_tup,
  CASE WHEN {_L} = 'db0' THEN n_mod_since_analyze END AS n_mod_since_analyze
FROM pg_stat_user_tables""", "pg_stat_user_tables")
