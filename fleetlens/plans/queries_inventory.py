"""Registered queries for the schema inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.keys import K
from fleetlens.operators import inventory as INV
from fleetlens.plans.queries import query
from fleetlens.sources import standins as V
from fleetlens.sources.envelopes import Item, pack
from fleetlens.sources.shared import write_once

SCHEMA_PAGE_ROWS = 20


def _pg(spark, d):
    return (V.catalog_attribute(spark, d), V.catalog_class(spark, d), V.catalog_namespace(spark, d))


@query("user_schemas_pg")
def q_user_schemas_pg(spark, d):
    """B1 on every relation of the catalog: relations in user schemas (NULL schema dropped)."""
    cls = V.catalog_class(spark, d)
    ns = V.catalog_namespace(spark, d).select(*K, F.col("oid").alias("relnamespace"), "nspname")
    j = cls.join(ns, K + ["relnamespace"], "left")
    return INV.user_schemas_pg(j).select(*K, "oid", "relname", "nspname")


@query("live_columns")
def q_live_columns(spark, d):
    return INV.live_columns(V.catalog_attribute(spark, d)).select(*K, "attrelid", "attnum", "attname")


def _columns(spark, d):
    att, cls, ns = _pg(spark, d)
    return INV.column_inventory(att, cls, ns, V.catalog_attrdef(spark, d), V.catalog_type(spark, d),
                                V.catalog_collation(spark, d))


@query("column_inventory")
def q_column_inventory(spark, d):
    return _columns(spark, d)


@query("column_defaults")
def q_column_defaults(spark, d):
    return _columns(spark, d).select(*K, "table_id", "name", "default_val", "collation")


def _indexes(spark, d):
    return INV.index_inventory(V.catalog_index(spark, d), V.catalog_class(spark, d), V.catalog_namespace(spark, d),
                               V.catalog_am(spark, d), V.catalog_constraint(spark, d))


@query("index_inventory")
def q_index_inventory(spark, d):
    return _indexes(spark, d)


def _fks(spark, d):
    return INV.fk_inventory(V.catalog_constraint(spark, d), V.catalog_class(spark, d), V.catalog_namespace(spark, d))


@query("fk_inventory")
def q_fk_inventory(spark, d):
    return _fks(spark, d)


@query("fk_inventory_mysql")
def q_fk_inventory_mysql(spark, d):
    return INV.mysql_user_rows(V.mysql_referential_constraints(spark, d), "CONSTRAINT_SCHEMA", INV.MYSQL_FK_COLS)


def _index_columns(spark, d):
    att, cls, ns = _pg(spark, d)
    return INV.index_column_names(V.catalog_index(spark, d), att, cls, ns)


@query("index_column_names")
def q_index_column_names(spark, d):
    return _index_columns(spark, d)


@query("ordered_string_agg")
def q_ordered_string_agg(spark, d):
    live = INV.live_columns(V.catalog_attribute(spark, d))
    return INV.ordered_string_agg(live, K + ["attrelid"], "attnum", "attname", "column_list")


def _tables(spark, d):
    return INV.table_inventory(V.catalog_class(spark, d), V.catalog_namespace(spark, d))


@query("table_inventory")
def q_table_inventory(spark, d):
    return _tables(spark, d)


@query("table_inventory_mysql")
def q_table_inventory_mysql(spark, d):
    return INV.mysql_user_rows(V.mysql_tables(spark, d), "TABLE_SCHEMA", INV.MYSQL_TABLE_SCHEMA_COLS)


@query("view_inventory")
def q_view_inventory(spark, d):
    return INV.view_inventory(V.catalog_views(spark, d))


@query("view_inventory_mysql")
def q_view_inventory_mysql(spark, d):
    return INV.mysql_user_rows(V.mysql_views(spark, d), "TABLE_SCHEMA", INV.MYSQL_VIEW_COLS)


@query("column_inventory_mysql")
def q_column_inventory_mysql(spark, d):
    return INV.mysql_user_rows(V.mysql_columns(spark, d), "TABLE_SCHEMA", INV.MYSQL_COLUMN_COLS)


@query("index_inventory_mysql")
def q_index_inventory_mysql(spark, d):
    return INV.mysql_user_rows(V.mysql_statistics(spark, d), "TABLE_SCHEMA", INV.MYSQL_INDEX_COLS)


# The six PostgreSQL inventories of one schema document, item -> (columns, order).
PG_SCHEMA_ITEMS = {
    "columns": (["table_id", "name", "type", "default_val", "nullable", "collation", "identity", "storage_type",
                 "generated", "stats_target", "description"], ["table_id", "attnum"]),
    "indexes": (["table_id", "index_id", "index_name", "is_primary", "is_unique", "is_clustered", "is_valid",
                 "index_expression", "index_constraint", "constraint_type", "constraint_deferrable",
                 "constraint_deferred_by_default", "index_replica_identity", "table_space", "index_type"],
                ["!is_primary", "index_name"]),
    "foreign_keys": (["table_id", "constraint_name", "constraint_expression"], ["table_id", "constraint_name"]),
    "tables": (["schema", "table_id", "table_name", "type", "owner", "persistence", "description"],
               ["schema", "table_id"]),
    "views": (["schemaname", "viewname", "viewowner", "definition"], ["schemaname", "viewname"]),
    "index_columns": (["table_id", "index_id", "column_names"], ["table_id", "index_id"]),
}


def pg_inventories(spark, d):
    """The six PostgreSQL inventories over relations, columns and indexes that are computed once."""
    rel = write_once(INV.relations(V.catalog_class(spark, d), V.catalog_namespace(spark, d)), "relations")
    att = write_once(V.catalog_attribute(spark, d), "attributes")
    idx = write_once(V.catalog_index(spark, d), "indexes")
    con = write_once(V.catalog_constraint(spark, d), "constraints")
    return {
        "columns": INV.column_inventory(att, rel, None, V.catalog_attrdef(spark, d), V.catalog_type(spark, d),
                                        V.catalog_collation(spark, d)),
        "indexes": INV.index_inventory(idx, rel, None, V.catalog_am(spark, d), con),
        "foreign_keys": INV.fk_inventory(con, rel, None), "tables": INV.table_inventory(rel, None),
        "views": INV.view_inventory(V.catalog_views(spark, d)), "index_columns": INV.index_column_names(idx, att, rel, None),
    }


@query("schema_observation")
def q_schema_observation(spark, d):
    """The six inventories as paged {columns, rows} documents per snapshot, numbered as one list."""
    frames = pg_inventories(spark, d)
    return pack([Item(k, frames[k], order, cols) for k, (cols, order) in PG_SCHEMA_ITEMS.items()], K, SCHEMA_PAGE_ROWS,
                typed=False)


@query("inventory_order")
def q_inventory_order(spark, d):
    """F8: the display order of the column inventory (rank = position)."""
    from pyspark.sql import Window
    inv = _columns(spark, d).select(*K, "table_id", "attnum", "name")
    w = Window.partitionBy(*K, "table_id").orderBy("attnum")
    return inv.withColumn("position", F.row_number().over(w))
