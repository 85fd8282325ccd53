"""DuckDB oracles of the schema inventories."""

from __future__ import annotations

from fleetlens.plans.oracle_sql import KC, KEQ, ORACLES
from fleetlens.plans.queries_inventory import PG_SCHEMA_ITEMS, SCHEMA_PAGE_ROWS
from fleetlens.plans.standin_sql import with_standins as W

_USER = "({c} NOT IN ('pg_catalog', 'information_schema') AND NOT regexp_matches({c}, '^pg_toast'))"
_CAT = ("catalog_attribute", "catalog_class", "catalog_namespace", "catalog_attrdef", "catalog_type",
        "catalog_collation", "catalog_index", "catalog_am", "catalog_constraint", "catalog_views")
P = lambda a: ", ".join(f"{a}.{c}" for c in KC.split(", "))

ORACLES["user_schemas_pg"] = W(f"""
SELECT {P("c")}, c.oid, c.relname, n.nspname
FROM catalog_class c LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
WHERE {_USER.format(c="n.nspname")}""", "catalog_class", "catalog_namespace")
ORACLES["live_columns"] = W(f"SELECT {KC}, attrelid, attnum, attname FROM catalog_attribute "
                            "WHERE attnum > 0 AND NOT attisdropped", "catalog_attribute")

_COLS = ("cols", f"""
SELECT {P("a")}, a.attrelid AS table_id, a.attname AS name, t.typname AS type,
  CASE WHEN a.atthasdef THEN d.adsrc END AS default_val, NOT a.attnotnull AS nullable, a.attnotnull AS not_null,
  CASE WHEN a.attcollation <> t.typcollation THEN co.collname END AS "collation", a.attidentity AS identity,
  a.attstorage AS storage_type, a.attgenerated AS generated,
  nullif(a.attstattarget, -1) AS stats_target, a.description, a.attnum
FROM catalog_attribute a
JOIN catalog_class c ON {KEQ("a", "c")} AND c.oid = a.attrelid
LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
LEFT JOIN catalog_attrdef d ON {KEQ("a", "d")} AND d.adrelid = a.attrelid AND d.adnum = a.attnum
LEFT JOIN catalog_type t ON {KEQ("a", "t")} AND t.oid = a.atttypid
LEFT JOIN catalog_collation co ON {KEQ("a", "co")} AND co.oid = a.attcollation
WHERE a.attnum > 0 AND NOT a.attisdropped AND c.relkind IN ('r', 'p', 'v', 'm', 'f', '')
  AND {_USER.format(c="n.nspname")}""")

ORACLES["column_inventory"] = W("SELECT * FROM cols", *_CAT, extra=[_COLS])
ORACLES["column_defaults"] = W(f'SELECT {KC}, table_id, name, default_val, "collation" FROM cols', *_CAT,
                               extra=[_COLS])

_IDX = ("idx", f"""
SELECT {P("i")}, i.indrelid AS table_id, i.indexrelid AS index_id, c2.relname AS index_name,
  i.indisprimary AS is_primary, i.indisunique AS is_unique, i.indisclustered AS is_clustered,
  i.indisvalid AS is_valid, i.indexdef AS index_expression, con.condef AS index_constraint,
  con.contype AS constraint_type, con.condeferrable AS constraint_deferrable,
  con.condeferred AS constraint_deferred_by_default, i.indisreplident AS index_replica_identity,
  c2.reltablespace AS table_space, am.amname AS index_type
FROM catalog_index i
JOIN catalog_class c ON {KEQ("i", "c")} AND c.oid = i.indrelid
LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
JOIN catalog_class c2 ON {KEQ("i", "c2")} AND c2.oid = i.indexrelid
LEFT JOIN catalog_am am ON {KEQ("c2", "am")} AND am.oid = c2.relam
LEFT JOIN catalog_constraint con ON {KEQ("i", "con")} AND con.conrelid = i.indrelid
  AND con.conindid = i.indexrelid AND con.contype IN ('p', 'u', 'x')
WHERE {_USER.format(c="n.nspname")}""")
ORACLES["index_inventory"] = W("SELECT * FROM idx", *_CAT, extra=[_IDX])

_FK = ("fk", f"""
SELECT {P("r")}, r.conrelid AS table_id, r.conname AS constraint_name, r.condef AS constraint_expression
FROM catalog_constraint r
LEFT JOIN catalog_class c ON {KEQ("r", "c")} AND c.oid = r.conrelid
LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
WHERE r.contype = 'f' AND r.conparentid = 0 AND {_USER.format(c="n.nspname")}""")
ORACLES["fk_inventory"] = W("SELECT * FROM fk", *_CAT, extra=[_FK])

_MYSYS = "lower({c}) NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys')"
ORACLES["fk_inventory_mysql"] = W(f"""
SELECT {KC}, CONSTRAINT_SCHEMA, TABLE_NAME, CONSTRAINT_NAME, UNIQUE_CONSTRAINT_SCHEMA, UNIQUE_CONSTRAINT_NAME,
  UPDATE_RULE, DELETE_RULE, REFERENCED_TABLE_NAME FROM mysql_referential_constraints
WHERE {_MYSYS.format(c="CONSTRAINT_SCHEMA")}""", "mysql_referential_constraints")

_IXC = ("ixc", f"""
SELECT {KC}, indrelid AS table_id, indexrelid AS index_id,
  coalesce(array_to_string(list(attname ORDER BY pos), ','), '') AS column_names
FROM (
  SELECT {P("k")}, k.indrelid, k.indexrelid, k.pos,
    CASE WHEN k.attnum = 0 THEN k.indexprs[1] ELSE a.attname END AS attname FROM (
    SELECT {P("i")}, i.indrelid, i.indexrelid, i.indexprs, generate_subscripts(i.indkey, 1) - 1 AS pos,
      unnest(i.indkey) AS attnum
    FROM catalog_index i
    JOIN catalog_class c ON {KEQ("i", "c")} AND c.oid = i.indrelid
    LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
    WHERE {_USER.format(c="n.nspname")}) k
  LEFT JOIN catalog_attribute a ON {KEQ("k", "a")} AND a.attrelid = k.indrelid AND a.attnum = k.attnum)
GROUP BY ALL""")
ORACLES["index_column_names"] = W("SELECT * FROM ixc", *_CAT, extra=[_IXC])

ORACLES["ordered_string_agg"] = W(f"""
SELECT {KC}, attrelid, array_to_string(list(attname ORDER BY attnum), ',') AS column_list
FROM catalog_attribute WHERE attnum > 0 AND NOT attisdropped GROUP BY ALL""", "catalog_attribute")

_TBL = ("tbl", f"""
SELECT {P("c")}, n.nspname AS schema, c.oid AS table_id, c.relname AS table_name, c.relkind AS type, c.owner,
  c.relpersistence AS persistence, c.description
FROM catalog_class c LEFT JOIN catalog_namespace n ON {KEQ("c", "n")} AND n.oid = c.relnamespace
WHERE c.relkind IN ('r', 'p', 'v', 'm', 'f', '') AND {_USER.format(c="n.nspname")}""")
ORACLES["table_inventory"] = W("SELECT * FROM tbl", *_CAT, extra=[_TBL])
ORACLES["table_inventory_mysql"] = W(f"""
SELECT {KC}, TABLE_SCHEMA, TABLE_NAME, TABLE_TYPE, ENGINE, VERSION, ROW_FORMAT, TABLE_ROWS, MAX_DATA_LENGTH,
  TABLE_COLLATION, CREATE_OPTIONS, TABLE_COMMENT FROM mysql_tables WHERE {_MYSYS.format(c="TABLE_SCHEMA")}""",
                                     "mysql_tables")
_VIEWS = ("vw", f"SELECT {KC}, schemaname, viewname, viewowner, definition FROM catalog_views "
                f"WHERE {_USER.format(c='schemaname')}")
ORACLES["view_inventory"] = W("SELECT * FROM vw", *_CAT, extra=[_VIEWS])
ORACLES["view_inventory_mysql"] = W(f"""
SELECT {KC}, TABLE_SCHEMA, TABLE_NAME, VIEW_DEFINITION, IS_UPDATABLE, CHECK_OPTION, SECURITY_TYPE
FROM mysql_views WHERE {_MYSYS.format(c="TABLE_SCHEMA")}""", "mysql_views")
ORACLES["column_inventory_mysql"] = W(f"""
SELECT {KC}, TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION, COLUMN_DEFAULT, IS_NULLABLE, DATA_TYPE,
  COLLATION_NAME, COLUMN_COMMENT FROM mysql_columns WHERE {_MYSYS.format(c="TABLE_SCHEMA")}""", "mysql_columns")
ORACLES["index_inventory_mysql"] = W(f"""
SELECT {KC}, TABLE_SCHEMA, TABLE_NAME, INDEX_NAME, NON_UNIQUE, COLUMN_NAME, "COLLATION", SUB_PART, INDEX_TYPE,
  NULLABLE, PACKED FROM mysql_statistics WHERE {_MYSYS.format(c="TABLE_SCHEMA")}""", "mysql_statistics")


def pack_sql(src: str, item: str, cols: list[str], order: list[str], page_rows: int) -> str:
    """DuckDB text of ``envelope_pack`` over the relation ``src``."""
    row = "[" + ", ".join(f'CAST(s."{c}" AS VARCHAR)' for c in cols) + "]"
    colnames = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
    keys = ", ".join((f'NOT s."{o[1:]}"' if o.startswith("!") else f's."{o}"') + " NULLS FIRST" for o in order)
    return f"""
SELECT {KC}, '{item}' AS item, page, count(*)::BIGINT AS n_rows,
  to_json({{'columns': {colnames}, 'rows': list(r ORDER BY pos)}}) AS payload
FROM (SELECT *, CAST((pos - 1) // {page_rows} AS BIGINT) AS page FROM (
  SELECT {P("s")}, {row} AS r, row_number() OVER (PARTITION BY {P("s")} ORDER BY {keys}) AS pos FROM {src} s))
GROUP BY ALL"""


_SRC = {"columns": "cols", "indexes": "idx", "foreign_keys": "fk", "tables": "tbl", "views": "vw",
        "index_columns": "ixc"}
ORACLES["schema_observation"] = W(
    "\nUNION ALL\n".join(pack_sql(_SRC[k], k, cols, order, SCHEMA_PAGE_ROWS)
                         for k, (cols, order) in PG_SCHEMA_ITEMS.items()),
    *_CAT, extra=[_COLS, _IDX, _FK, _TBL, _VIEWS, _IXC])
ORACLES["inventory_order"] = W(f"""
SELECT {KC}, table_id, attnum, name, CAST(row_number() OVER (PARTITION BY {KC}, table_id ORDER BY attnum) AS INTEGER)
  AS position FROM cols""", *_CAT, extra=[_COLS])
