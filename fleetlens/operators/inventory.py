"""Schema inventories: C1-C4, C10, D4, L1-L4 (L5 packs them, see observations).

Catalog relations carry K; oids are only unique inside one database, so every
join key starts with K.  Namespaces, types, collations and access methods are
few per database but grow with the fleet, so no broadcast is forced: the joins
on them go through ``skew.lookup_join``, which deals heavy keys over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import sentinel_to_null
from fleetlens.keys import K
from fleetlens.operators.skew import lookup_join
from fleetlens.operators.topn import MYSQL_SYSTEM_SCHEMAS

# Fixed values.
PG_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
PG_TOAST_PATTERN = "^pg_toast"
INVENTORY_RELKINDS = ("r", "p", "v", "m", "f", "")
INDEX_CONSTRAINT_TYPES = ("p", "u", "x")


def user_schema(nspname: Column) -> Column:
    """B1: not a system schema; NULL is dropped (three-valued logic)."""
    return ~nspname.isin(*PG_SYSTEM_SCHEMAS) & ~nspname.rlike(PG_TOAST_PATTERN)


def user_schemas_pg(df: DataFrame, col: str = "nspname") -> DataFrame:
    return df.filter(user_schema(F.col(col)))


def live_columns(att: DataFrame) -> DataFrame:
    """User columns that are not dropped."""
    return att.filter((F.col("attnum") > 0) & ~F.col("attisdropped"))


def relations(cls: DataFrame, nsp: DataFrame) -> DataFrame:
    """Relations with the name of their schema.  Written once, it stands for ``cls`` in every inventory (``nsp`` None)."""
    return _class_ns(cls, nsp)


def _class_ns(cls: DataFrame, nsp: DataFrame | None) -> DataFrame:
    if nsp is None:
        return cls
    ns = nsp.select(*K, F.col("oid").alias("relnamespace"), "nspname")
    return lookup_join(cls, ns, K + ["relnamespace"])


def multi_matches(df: DataFrame, keys) -> DataFrame:
    """C2 check: keys of a lookup that would match more than once (should be empty)."""
    return df.groupBy(*keys).count().filter(F.col("count") > 1)


def column_inventory(att: DataFrame, cls: DataFrame, nsp: DataFrame | None, attrdef: DataFrame, types: DataFrame,
                     coll: DataFrame, with_generated: bool = True) -> DataFrame:
    """C1 + C2: user columns of user relations with type, default and collation.

    ``nullable`` is NOT attnotnull and ``not_null`` the raw flag (the
    reference labels attnotnull as nullable, quirk Q7).
    """
    c = F.col
    rel = _class_ns(cls.filter(c("relkind").isin(*INVENTORY_RELKINDS)), nsp)
    rel = rel.filter(user_schema(c("nspname"))).select(*K, c("oid").alias("attrelid"))
    a = live_columns(att).join(rel, K + ["attrelid"])
    # At most one default per (table, column) and one collation per oid
    d = attrdef.select(*K, c("adrelid").alias("attrelid"), c("adnum").alias("attnum"), "adsrc")
    a = a.join(d, K + ["attrelid", "attnum"], "left")
    t = types.select(*K, c("oid").alias("atttypid"), "typname", "typcollation")
    a = lookup_join(a, t, K + ["atttypid"])
    co = coll.select(*K, c("oid").alias("attcollation"), "collname")
    a = lookup_join(a, co, K + ["attcollation"])
    cols = [
        c("attrelid").alias("table_id"),
        c("attname").alias("name"),
        c("typname").alias("type"),
        F.when(c("atthasdef"), c("adsrc")).alias("default_val"),
        (~c("attnotnull")).alias("nullable"),
        c("attnotnull").alias("not_null"),
        F.when(c("attcollation") != c("typcollation"), c("collname")).alias("collation"),
        c("attidentity").alias("identity"),
        c("attstorage").alias("storage_type"),
    ]
    if with_generated:
        cols.append(c("attgenerated").alias("generated"))
    cols += [sentinel_to_null(c("attstattarget")).alias("stats_target"), c("description"), c("attnum")]
    return a.select(*K, *cols)


def index_inventory(idx: DataFrame, cls: DataFrame, nsp: DataFrame | None, am: DataFrame, con: DataFrame) -> DataFrame:
    """Indexes of user tables with access method and owning constraint."""
    c = F.col
    tables = _class_ns(cls, nsp).filter(user_schema(c("nspname"))).select(*K, c("oid").alias("indrelid"))
    i = idx.join(tables, K + ["indrelid"])
    c2 = cls.select(*K, c("oid").alias("indexrelid"), c("relname").alias("index_name"), "relam",
                    c("reltablespace").alias("table_space"))
    i = i.join(c2, K + ["indexrelid"])
    a = am.select(*K, c("oid").alias("relam"), c("amname").alias("index_type"))
    i = lookup_join(i, a, K + ["relam"])
    k = con.filter(c("contype").isin(*INDEX_CONSTRAINT_TYPES)).select(
        *K, c("conrelid").alias("indrelid"), c("conindid").alias("indexrelid"), "condef", "contype",
        "condeferrable", "condeferred")
    i = i.join(k, K + ["indrelid", "indexrelid"], "left")
    return i.select(
        *K,
        c("indrelid").alias("table_id"), c("indexrelid").alias("index_id"), "index_name",
        c("indisprimary").alias("is_primary"), c("indisunique").alias("is_unique"),
        c("indisclustered").alias("is_clustered"), c("indisvalid").alias("is_valid"),
        c("indexdef").alias("index_expression"), c("condef").alias("index_constraint"),
        c("contype").alias("constraint_type"), c("condeferrable").alias("constraint_deferrable"),
        c("condeferred").alias("constraint_deferred_by_default"),
        c("indisreplident").alias("index_replica_identity"), "table_space", "index_type")


def fk_inventory(con: DataFrame, cls: DataFrame, nsp: DataFrame | None, server_major: int = 14) -> DataFrame:
    """C4: foreign keys of user tables; from v11 only top-level constraints."""
    c = F.col
    fk = con.filter(c("contype") == "f")
    if server_major >= 11:
        fk = fk.filter(c("conparentid") == 0)
    rel = _class_ns(cls, nsp).select(*K, c("oid").alias("conrelid"), "nspname")
    fk = fk.join(rel, K + ["conrelid"], "left").filter(user_schema(c("nspname")))
    return fk.select(*K, c("conrelid").alias("table_id"), c("conname").alias("constraint_name"),
                     c("condef").alias("constraint_expression"))


def ordered_string_agg(df: DataFrame, keys, order: str, value: str, alias: str, sep: str = ",") -> DataFrame:
    """array_to_string(array_agg(value ORDER BY order), sep) per group.

    NULL values are skipped like PostgreSQL's array_to_string.  Groups are
    index keys or table columns (bounded by the engine).
    """
    keys = list(keys)
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                   F.col(value).alias("v")))).alias("_l"))
    return g.select(*keys, F.array_join(F.transform("_l", lambda e: e["v"]), sep).alias(alias))


def index_column_names(idx: DataFrame, att: DataFrame, cls: DataFrame, nsp: DataFrame | None) -> DataFrame:
    """Per index its keys in key order ('WITH ORDINALITY'): column names, and the text of expression keys
    (attnum 0, in the order of ``indexprs``)."""
    c = F.col
    tables = _class_ns(cls, nsp).filter(user_schema(c("nspname"))).select(*K, c("oid").alias("indrelid"))
    keys = idx.join(tables, K + ["indrelid"]).select(*K, "indrelid", "indexrelid",
                                                     "indkey", "indexprs",
                                                     F.posexplode("indkey").alias("pos", "attnum"))
    nth = F.size(F.filter(F.slice("indkey", F.lit(1), c("pos") + 1), lambda k: k == 0))
    keys = keys.withColumn("expr", F.when(c("attnum") == 0, F.get(c("indexprs"), nth - 1))).drop("indkey", "indexprs")
    names = att.select(*K, c("attrelid").alias("indrelid"), "attnum", "attname")
    j = keys.join(names, K + ["indrelid", "attnum"], "left").withColumn("attname", F.coalesce("expr", "attname"))
    out = ordered_string_agg(j, K + ["indrelid", "indexrelid"], "pos", "attname", "column_names")
    return out.select(*K, c("indrelid").alias("table_id"), c("indexrelid").alias("index_id"), "column_names")


def table_inventory(cls: DataFrame, nsp: DataFrame | None) -> DataFrame:
    """L1 (PostgreSQL): user relations of the inventory kinds."""
    c = F.col
    r = _class_ns(cls.filter(c("relkind").isin(*INVENTORY_RELKINDS)), nsp).filter(user_schema(c("nspname")))
    return r.select(*K, c("nspname").alias("schema"), c("oid").alias("table_id"), c("relname").alias("table_name"),
                    c("relkind").alias("type"), "owner", c("relpersistence").alias("persistence"), "description")


def view_inventory(views: DataFrame) -> DataFrame:
    """L2 (PostgreSQL): views outside the system schemas."""
    return views.filter(user_schema(F.col("schemaname"))).select(*K, "schemaname", "viewname", "viewowner",
                                                                 "definition")


def mysql_user_rows(df: DataFrame, schema_col: str, cols) -> DataFrame:
    """L1-L4 and C4 (MySQL): rows outside the four system schemas."""
    return df.filter(~F.lower(F.col(schema_col)).isin(*MYSQL_SYSTEM_SCHEMAS)).select(*K, *cols)


# The columns of the inventories.
MYSQL_COLUMN_COLS = ["TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION", "COLUMN_DEFAULT",
                     "IS_NULLABLE", "DATA_TYPE", "COLLATION_NAME", "COLUMN_COMMENT"]
MYSQL_INDEX_COLS = ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "NON_UNIQUE", "COLUMN_NAME", "COLLATION",
                    "SUB_PART", "INDEX_TYPE", "NULLABLE", "PACKED"]
MYSQL_FK_COLS = ["CONSTRAINT_SCHEMA", "TABLE_NAME", "CONSTRAINT_NAME", "UNIQUE_CONSTRAINT_SCHEMA",
                 "UNIQUE_CONSTRAINT_NAME", "UPDATE_RULE", "DELETE_RULE", "REFERENCED_TABLE_NAME"]
MYSQL_TABLE_SCHEMA_COLS = ["TABLE_SCHEMA", "TABLE_NAME", "TABLE_TYPE", "ENGINE", "VERSION", "ROW_FORMAT",
                           "TABLE_ROWS", "MAX_DATA_LENGTH", "TABLE_COLLATION", "CREATE_OPTIONS", "TABLE_COMMENT"]
MYSQL_VIEW_COLS = ["TABLE_SCHEMA", "TABLE_NAME", "VIEW_DEFINITION", "IS_UPDATABLE", "CHECK_OPTION",
                   "SECURITY_TYPE"]
