"""Landed telemetry snapshots derived from the driver's parquet tables.

A production deployment reads landed catalog snapshots (one row per catalog row,
prefixed by the snapshot key K).  For tests and bench these relations are
derived from the TPC-H-like tables under ``/root/testdata`` so that their size
grows with the scale factor.  Every stand-in is a projection or a grouping that
Spark runs as an ordinary job (partial aggregation before each shuffle, no
window over a growing group, no driver round trip); the DuckDB text of the same
relation lives in ``fleetlens.plans.oracle_sql``.

Ids (V1 ...) follow FIXTURES.md section 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.tables import read_table

# Fixed values of the stand-ins (shared with the DuckDB oracle text).
ORG = "org0"
OBS_TIME = "2024-01-31 00:00:00"
MYSQL_SYSTEM_SCHEMA_BY_MOD40 = {0: "mysql", 1: "sys", 2: "performance_schema", 3: "INFORMATION_SCHEMA"}
ALIGN_BY_MOD4 = ["c", "s", "i", "d"]
PG_VERSION_BY_MOD5 = ["9.6.3", "11.2", "12.4", "13.1", "14.2"]
SERVER_VERSION_BY_MOD5 = ["8.0.22-log", "12 (Ubuntu 12.6)", "5.7.34", "9.6.3", "14.2"]
STATUS_NAME_BY_EVENT = {
    "view": "Innodb_buffer_pool_read_requests",
    "error": "Innodb_buffer_pool_reads",
    "click": "Com_select",
    "signup": "Com_insert",
    "purchase": "Com_update",
}
OBS_TYPE_BY_EVENT = {
    "view": "db",
    "click": "table",
    "signup": "query",
    "purchase": "long_running_query",
    "error": "schema",
}


def obs_time() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{OBS_TIME}'")


def key(db_key: Column, ldb: Column | None = None, org: Column | None = None,
        t: Column | None = None) -> list[Column]:
    return [
        (org if org is not None else F.lit(ORG)).alias("organization_id"),
        db_key.alias("db_key"),
        (ldb if ldb is not None else F.lit("db0")).alias("logical_database_name"),
        (t if t is not None else obs_time()).alias("observation_time"),
    ]


def _case(col: Column, mapping: dict, default: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == F.lit(k), F.lit(v)) if out is None else out.when(col == F.lit(k), F.lit(v))
    return out.otherwise(default) if default is not None else out


def _pick(idx: Column, values: list[str]) -> Column:
    # element_at is 1-based
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _ldb_by_part(partkey: Column) -> Column:
    return F.concat(F.lit("db"), (partkey % 3).cast("string"))


def _mysql_schema(partkey: Column, p_type: Column) -> Column:
    return _case(partkey % 40, MYSQL_SYSTEM_SCHEMA_BY_MOD40, F.lower(p_type))


# ---------------------------------------------------------------- V1 tables ----

def _table_facts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem pre-aggregated per part, then joined to part (V1 grain)."""
    li = read_table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_discount", "l_tax",
                    "l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    qty = F.sum("l_quantity").cast("bigint")
    g = li.groupBy("l_partkey").agg(
        F.count("*").alias("n"),
        F.count_if(rf == "R").alias("n_r"),
        F.count_if(rf == "A").alias("n_a"),
        F.count_if(rf == "N").alias("n_n"),
        F.count_if((rf == "A") & (F.col("l_discount") > 0.08)).alias("n_a_disc"),
        F.count_if(ls == "F").alias("n_f"),
        F.count_if(ls == "O").alias("n_o"),
        F.count_if(F.col("l_tax") > 0.04).alias("n_tax_hi"),
        F.count_if(F.col("l_tax") < 0.02).alias("n_tax_lo"),
        F.count_if(F.col("l_tax") > 0.07).alias("n_tax_top"),
        F.count_if(F.col("l_discount") < 0.02).alias("n_disc_lo"),
        *[F.count_if(ln == i).alias(f"n_l{i}") for i in range(1, 8)],
        qty.alias("qty"),
        F.sum(ln).cast("bigint").alias("lines"),
        F.max(F.when(rf == "R", F.col("l_shipdate"))).alias("last_r"),
        F.max(F.when(ls == "F", F.col("l_shipdate"))).alias("last_f"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name")
    return g.join(p, g.l_partkey == p.p_partkey)


def pg_stat_user_tables(spark: SparkSession, d: str) -> DataFrame:
    """V1: pg_stat_user_tables, 22 columns after K."""
    t = _table_facts(spark, d)
    c = F.col
    return t.select(
        *key(c("p_brand"), _ldb_by_part(c("l_partkey"))),
        c("l_partkey").alias("relid"),
        c("p_type").alias("schemaname"),
        c("p_name").alias("relname"),
        c("n_r").alias("seq_scan"),
        c("qty").alias("seq_tup_read"),
        F.nullif(c("n_a_disc"), F.lit(0)).alias("idx_scan"),
        c("n_a").alias("idx_tup_fetch"),
        c("n").alias("n_tup_ins"),
        c("n_o").alias("n_tup_upd"),
        c("n_n").alias("n_tup_del"),
        c("n_l1").alias("n_tup_hot_upd"),
        c("n").alias("n_live_tup"),
        c("n_f").alias("n_dead_tup"),
        c("n_tax_hi").alias("n_mod_since_analyze"),
        c("last_r").alias("last_vacuum"),
        c("last_f").alias("last_autovacuum"),
        c("first_ship").alias("last_analyze"),
        c("last_ship").alias("last_autoanalyze"),
        c("n_l2").alias("vacuum_count"),
        c("n_l3").alias("autovacuum_count"),
        c("n_l4").alias("analyze_count"),
        c("n_l5").alias("autoanalyze_count"),
    )


def pg_statio_user_tables(spark: SparkSession, d: str) -> DataFrame:
    """V1: pg_statio_user_tables (NULLs where the view would have none)."""
    t = _table_facts(spark, d)
    c = F.col
    z = F.lit(0)
    return t.select(
        *key(c("p_brand"), _ldb_by_part(c("l_partkey"))),
        c("l_partkey").alias("relid"),
        c("p_type").alias("schemaname"),
        c("p_name").alias("relname"),
        c("lines").alias("heap_blks_read"),
        (c("qty") * 10).alias("heap_blks_hit"),
        c("n_a").alias("idx_blks_read"),
        (c("n_a") * 3).alias("idx_blks_hit"),
        F.nullif(c("n_tax_lo"), z).alias("toast_blks_read"),
        F.nullif(c("n_tax_top"), z).alias("toast_blks_hit"),
        F.nullif(c("n_l6"), z).alias("tidx_blks_read"),
        F.nullif(c("n_l7"), z).alias("tidx_blks_hit"),
    )


def pg_table_size_facts(spark: SparkSession, d: str) -> DataFrame:
    """V1: what pg_table_size / pg_relation_size / pg_indexes_size return."""
    t = _table_facts(spark, d)
    c = F.col
    rel = c("qty") * 8192
    return t.select(
        *key(c("p_brand"), _ldb_by_part(c("l_partkey"))),
        c("l_partkey").alias("relid"),
        (rel + c("n") * 8192).alias("table_size"),
        rel.alias("relation_size"),
        (c("lines") * 8192).alias("indexes_size"),
    )


def pg_stat_progress_vacuum(spark: SparkSession, d: str) -> DataFrame:
    """Progress rows of vacuums: one per part, on table relid = p_partkey; two parts share a pid
    (a later row of the same process)."""
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    return p.select(
        *key(F.col("p_brand"), _ldb_by_part(F.col("p_partkey"))),
        F.expr("100000 + p_partkey div 100 * 50 + p_partkey % 50").alias("pid"),
        F.col("p_partkey").alias("ord"),
        F.col("p_partkey").alias("relid"),
        _pick(F.col("p_size") % 3, ["scanning heap", "vacuuming indexes", "cleaning up indexes"]).alias("phase"),
        (F.col("p_size") * 10).cast("bigint").alias("heap_blks_total"),
    )


def pg_server_spine(spark: SparkSession, d: str) -> DataFrame:
    """All servers, two of them without a row in pg_stat_bgwriter."""
    o = read_table(spark, d, "orders", "o_custkey")
    return o.select(*key(F.concat(F.lit("db"), (F.col("o_custkey") % 12).cast("string")))).distinct()


def pg_snapshot_spine(spark: SparkSession, d: str) -> DataFrame:
    """All snapshots of the table world, including ones whose views are empty."""
    p = read_table(spark, d, "part", "p_partkey", "p_brand")
    return p.select(*key(F.col("p_brand"), _ldb_by_part(F.col("p_partkey")))).distinct()


def mysql_tables(spark: SparkSession, d: str) -> DataFrame:
    """information_schema.TABLES per database (db_key = brand)."""
    t = _table_facts(spark, d)
    c = F.col
    return t.select(
        *key(c("p_brand")),
        _mysql_schema(c("l_partkey"), c("p_type")).alias("TABLE_SCHEMA"),
        F.concat(F.lit("t"), c("l_partkey").cast("string")).alias("TABLE_NAME"),
        F.when(c("l_partkey") % 9 == 0, F.lit("VIEW")).otherwise(F.lit("BASE TABLE")).alias("TABLE_TYPE"),
        F.lit("InnoDB").alias("ENGINE"),
        F.lit(10).cast("bigint").alias("VERSION"),
        F.when(c("n_l1") % 2 == 0, F.lit("Dynamic")).otherwise(F.lit("Compact")).alias("ROW_FORMAT"),
        c("n_o").alias("TABLE_ROWS"),
        (c("qty") % 97 + 1).alias("AVG_ROW_LENGTH"),
        (c("qty") * 16384).alias("DATA_LENGTH"),
        (c("lines") * 16384).alias("INDEX_LENGTH"),
        (c("n_f") * 4096).alias("DATA_FREE"),
        F.lit(0).cast("bigint").alias("MAX_DATA_LENGTH"),
        F.lit("utf8mb4_0900_ai_ci").alias("TABLE_COLLATION"),
        F.when(c("n_tax_hi") > c("n_tax_lo"), F.lit("row_format=DYNAMIC")).otherwise(F.lit("")).alias("CREATE_OPTIONS"),
        c("p_name").alias("TABLE_COMMENT"),
    )


# ---------------------------------------------------------------- V3 indexes ---

def _index_facts(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity",
                    "l_returnflag", "l_linestatus", "l_linenumber")
    g = li.groupBy("l_partkey", "l_suppkey").agg(
        F.count("*").alias("n"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_r"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_o"),
        F.sum("l_linenumber").cast("bigint").alias("lines"),
    )
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name")
    return g.join(p, g.l_partkey == p.p_partkey)


def pg_stat_user_indexes(spark: SparkSession, d: str) -> DataFrame:
    """V3: pg_stat_user_indexes plus index size and index I/O."""
    t = _index_facts(spark, d)
    c = F.col
    ixid = c("l_partkey") * 100000 + c("l_suppkey")
    return t.select(
        *key(c("p_brand"), _ldb_by_part(c("l_partkey"))),
        c("l_partkey").alias("relid"),
        ixid.alias("indexrelid"),
        c("p_type").alias("schemaname"),
        c("p_name").alias("relname"),
        F.concat(F.lit("i"), ixid.cast("string")).alias("indexrelname"),
        c("n").alias("idx_scan"),
        c("qty").alias("idx_tup_read"),
        c("n_r").alias("idx_tup_fetch"),
        (c("qty") * 8192).alias("index_size"),
        c("lines").alias("idx_blks_read"),
        (c("n_o") * 7).alias("idx_blks_hit"),
    )


def pg_index(spark: SparkSession, d: str) -> DataFrame:
    """V3: pg_index rows of the same indexes (catalog flags)."""
    t = _index_facts(spark, d)
    c = F.col
    return t.select(
        *key(c("p_brand"), _ldb_by_part(c("l_partkey"))),
        (c("l_partkey") * 100000 + c("l_suppkey")).alias("indexrelid"),
        c("l_partkey").alias("indrelid"),
        F.lit(1).alias("indnatts"),
        F.lit(1).alias("indnkeyatts"),
        (c("l_suppkey") % 7 == 0).alias("indisunique"),
        (c("l_suppkey") % 11 == 0).alias("indisprimary"),
        (c("l_suppkey") % 13 == 0).alias("indisexclusion"),
        F.lit(True).alias("indimmediate"),
        (c("l_suppkey") % 17 == 0).alias("indisclustered"),
        F.lit(True).alias("indisvalid"),
        F.lit(False).alias("indcheckxmin"),
        F.lit(True).alias("indisready"),
        F.lit(True).alias("indislive"),
        (c("l_suppkey") % 19 == 0).alias("indisreplident"),
        (c("l_suppkey") % 5 + 1).cast("string").alias("indkey"),
        F.lit("0").alias("indcollation"),
        F.lit("1978").alias("indclass"),
        F.lit("0").alias("indoption"),
        F.lit(None).cast("string").alias("indexprs"),
        F.when(c("l_suppkey") % 3 == 0, F.concat(F.lit("(n > "), c("n").cast("string"), F.lit(")"))).alias("indpred"),
    )


def mysql_index_stats(spark: SparkSession, d: str) -> DataFrame:
    """mysql.innodb_index_stats: a 'size' row and a 'n_leaf_pages' row per index."""
    t = _index_facts(spark, d)
    c = F.col
    base = [
        *key(c("p_brand")),
        _mysql_schema(c("l_partkey"), c("p_type")).alias("DATABASE_NAME"),
        F.concat(F.lit("t"), c("l_partkey").cast("string")).alias("TABLE_NAME"),
        F.concat(F.lit("i"), c("l_suppkey").cast("string")).alias("INDEX_NAME"),
    ]
    size = t.select(*base, F.lit("size").alias("stat_name"), c("qty").alias("stat_value"))
    leaf = t.select(*base, F.lit("n_leaf_pages").alias("stat_name"), c("n").alias("stat_value"))
    return size.unionByName(leaf)


def mysql_statistics(spark: SparkSession, d: str) -> DataFrame:
    """information_schema.STATISTICS: one row per index column (one column each)."""
    t = _index_facts(spark, d)
    c = F.col
    sch = _mysql_schema(c("l_partkey"), c("p_type"))
    return t.select(
        *key(c("p_brand")),
        sch.alias("TABLE_SCHEMA"),
        F.concat(F.lit("t"), c("l_partkey").cast("string")).alias("TABLE_NAME"),
        (c("l_suppkey") % 2).cast("bigint").alias("NON_UNIQUE"),
        sch.alias("INDEX_SCHEMA"),
        F.concat(F.lit("i"), c("l_suppkey").cast("string")).alias("INDEX_NAME"),
        F.lit(1).cast("bigint").alias("SEQ_IN_INDEX"),
        F.concat(F.lit("c"), (c("l_suppkey") % 5).cast("string")).alias("COLUMN_NAME"),
        F.lit("A").alias("COLLATION"),
        c("n").alias("CARDINALITY"),
        F.lit(None).cast("bigint").alias("SUB_PART"),
        F.when(c("l_suppkey") % 3 == 0, F.lit("YES")).otherwise(F.lit("")).alias("NULLABLE"),
        F.lit("BTREE").alias("INDEX_TYPE"),
        F.lit(None).cast("string").alias("PACKED"),
    )


def mysql_index_usage(spark: SparkSession, d: str) -> DataFrame:
    """performance_schema.table_io_waits_summary_by_index_usage."""
    t = _index_facts(spark, d)
    c = F.col
    return t.select(
        *key(c("p_brand")),
        F.when(c("l_suppkey") % 10 == 0, F.lit("VIEW")).otherwise(F.lit("TABLE")).alias("OBJECT_TYPE"),
        _mysql_schema(c("l_partkey"), c("p_type")).alias("OBJECT_SCHEMA"),
        F.concat(F.lit("t"), c("l_partkey").cast("string")).alias("OBJECT_NAME"),
        F.concat(F.lit("i"), c("l_suppkey").cast("string")).alias("INDEX_NAME"),
        c("n").alias("COUNT_STAR"),
        (c("lines") * 1000).alias("SUM_TIMER_WAIT"),
        c("n_o").alias("COUNT_READ"),
        (c("n_o") * 900).alias("SUM_TIMER_READ"),
        (c("n") - c("n_o")).alias("COUNT_WRITE"),
        ((c("n") - c("n_o")) * 1100).alias("SUM_TIMER_WRITE"),
        c("n_o").alias("COUNT_FETCH"),
        (c("n_o") * 900).alias("SUM_TIMER_FETCH"),
        c("n_r").alias("COUNT_INSERT"),
        (c("n_r") * 1000).alias("SUM_TIMER_INSERT"),
        (c("n") - c("n_o") - c("n_r")).alias("COUNT_UPDATE"),
        c("qty").alias("SUM_TIMER_UPDATE"),
        F.lit(0).cast("bigint").alias("COUNT_DELETE"),
        F.lit(0).cast("bigint").alias("SUM_TIMER_DELETE"),
    )


# ---------------------------------------------------------------- V2 bloat -----

def _bloat_orders(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return o.select(
        *key(F.concat(F.lit("db"), (F.col("o_custkey") % 4).cast("string")),
             F.concat(F.lit("ldb"), (F.col("o_orderkey") % 2).cast("string"))),
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
    )


_NSP_BY_MOD3 = ["public", "sales", "archive"]


def bloat_class(spark: SparkSession, d: str) -> DataFrame:
    """pg_class rows of the bloat world: one table per order."""
    o = _bloat_orders(spark, d)
    c = F.col
    kind = F.when(c("o_orderkey") % 10 == 0, F.lit("m")).when(c("o_orderkey") % 10 == 1, F.lit("v")).otherwise(F.lit("r"))
    return o.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        c("o_orderkey").alias("oid"),
        F.concat(F.lit("t"), c("o_orderkey").cast("string")).alias("relname"),
        (c("o_orderkey") % 3 + 2200).alias("relnamespace"),
        kind.alias("relkind"),
        (c("o_custkey").cast("double") * 100).alias("reltuples"),
        (c("o_custkey") * 3).alias("relpages"),
        F.when(c("o_orderpriority") == "1-URGENT",
               F.array(F.lit("autovacuum_enabled=true"), F.lit("fillfactor=70"))).alias("reloptions"),
    )


def bloat_namespace(spark: SparkSession, d: str) -> DataFrame:
    o = _bloat_orders(spark, d)
    return (o.select("organization_id", "db_key", "logical_database_name", "observation_time",
                     (F.col("o_orderkey") % 3 + 2200).alias("oid"))
            .distinct()
            .withColumn("nspname", _pick(F.col("oid") - 2200, _NSP_BY_MOD3)))


def _bloat_columns(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    g = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").cast("int").alias("max_qty"),
        F.max("l_discount").alias("max_disc"),
    )
    o = _bloat_orders(spark, d).select("organization_id", "db_key", "logical_database_name",
                                       "observation_time", "o_orderkey")
    return g.join(o, g.l_orderkey == o.o_orderkey)


def bloat_attribute(spark: SparkSession, d: str) -> DataFrame:
    """pg_attribute: user columns from lineitem lines, one system column per table."""
    g = _bloat_columns(spark, d)
    c = F.col
    user = g.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        c("l_orderkey").alias("attrelid"),
        c("l_linenumber").alias("attnum"),
        F.concat(F.lit("c"), c("l_linenumber").cast("string")).alias("attname"),
        _pick(c("l_linenumber") % 4, ALIGN_BY_MOD4).alias("attalign"),
        F.when((c("l_orderkey") % 97 == 0) & (c("l_linenumber") == 1), F.lit("name"))
         .otherwise(F.lit("int4")).alias("atttypname"),
        ((c("l_orderkey") % 17 == 0) & (c("l_linenumber") == 2)).alias("attisdropped"),
    )
    o = _bloat_orders(spark, d)
    system = o.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        c("o_orderkey").alias("attrelid"),
        F.lit(-2).alias("attnum"),
        F.when(c("o_orderkey") % 11 == 0, F.lit("oid")).otherwise(F.lit("ctid")).alias("attname"),
        F.lit("i").alias("attalign"),
        F.lit("oid").alias("atttypname"),
        F.lit(False).alias("attisdropped"),
    )
    return user.unionByName(system)


def bloat_stats(spark: SparkSession, d: str) -> DataFrame:
    """pg_stats: analysed columns only; some tables also carry inherited=true rows."""
    g = _bloat_columns(spark, d)
    c = F.col
    analysed = g.filter((c("l_linenumber") < 7) | (c("l_orderkey") % 5 != 0))
    cols = ["organization_id", "db_key", "logical_database_name", "observation_time"]
    base = analysed.select(
        *cols,
        _pick(c("l_orderkey") % 3, _NSP_BY_MOD3).alias("schemaname"),
        F.concat(F.lit("t"), c("l_orderkey").cast("string")).alias("tablename"),
        F.concat(F.lit("c"), c("l_linenumber").cast("string")).alias("attname"),
        c("max_disc").alias("null_frac"),
        c("max_qty").alias("avg_width"),
    )
    own = base.withColumn("inherited", F.lit(False))
    inh = (base.filter(F.substring("tablename", 2, 20).cast("bigint") % 13 == 0)
           .withColumn("inherited", F.lit(True))
           .withColumn("null_frac", F.lit(0.5))
           .withColumn("avg_width", F.lit(999)))
    return own.unionByName(inh)


def bloat_table_stats(spark: SparkSession, d: str) -> DataFrame:
    """pg_stat_user_tables of the bloat world (drives F1 there)."""
    o = _bloat_orders(spark, d)
    c = F.col
    return o.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        c("o_orderkey").alias("relid"),
        (c("o_custkey") * 100).alias("n_live_tup"),
        (c("o_orderkey") % 7).alias("seq_scan"),
        F.nullif(c("o_orderkey") % 5, F.lit(0)).alias("idx_scan"),
    )


def server_settings(spark: SparkSession, d: str) -> DataFrame:
    """block_size and version() per database of the bloat world."""
    o = _bloat_orders(spark, d).select("organization_id", "db_key", "logical_database_name",
                                       "observation_time", "o_custkey")
    dbs = o.select("organization_id", "db_key", "logical_database_name", "observation_time",
                   (F.col("o_custkey") % 4).alias("m")).distinct()
    return dbs.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        F.lit(8192).alias("block_size"),
        F.when(F.col("m") == 3, F.lit("PostgreSQL 12.4 on armv7l-unknown-linux-gnueabihf, 32-bit"))
         .otherwise(F.lit("PostgreSQL 14.2 on x86_64-pc-linux-gnu, compiled by gcc, 64-bit"))
         .alias("version"),
    )


# ------------------------------------------------------------- V4 / V5 / V7 ----

def metric_samples(spark: SparkSession, d: str) -> DataFrame:
    """V4: metric time series (db_key, metric, ts, value)."""
    e = read_table(spark, d, "events", "user_id", "event_type", "ts", "value")
    return e.select(
        F.concat(F.lit("db"), (F.col("user_id") % 10).cast("string")).alias("db_key"),
        F.col("event_type").alias("metric"),
        "ts", "value",
    )


def _statement_facts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "user_id", "event_type", "value", "event_id", "ts")
    return e.groupBy("user_id", "event_type").agg(
        F.count("*").alias("calls"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("centi_ms"),
        F.min("event_id").alias("first_id"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_if(F.col("value") > 250).alias("slow"),
    )


def pg_stat_statements(spark: SparkSession, d: str) -> DataFrame:
    """V5: pg_stat_statements; mean_exec_time from v13, mean_time before."""
    s = _statement_facts(spark, d)
    c = F.col
    m = c("user_id") % 5
    ver = _pick(m, PG_VERSION_BY_MOD5)
    mean = (c("centi_ms") / c("calls") / 100)
    new = m >= 3
    return s.select(
        *key(F.concat(F.lit("db"), (c("user_id") % 10).cast("string"))),
        ver.alias("server_version"),
        c("user_id").alias("userid"),
        (c("user_id") % 10).alias("dbid"),
        F.nullif(c("first_id") % 7, F.lit(0)).alias("queryid"),
        F.concat(F.lit("select /* "), c("event_type"), F.lit(" */ 1")).alias("query"),
        c("calls"),
        (c("calls") * 3).alias("rows"),
        c("slow").alias("shared_blks_hit"),
        (c("calls") - c("slow")).alias("shared_blks_read"),
        F.when(new, mean).alias("mean_exec_time"),
        F.when(~new, mean).alias("mean_time"),
        (c("centi_ms") / 100).alias("blk_read_time"),
    )


# The remaining counters of events_statements_summary_by_digest.
DIGEST_COUNTERS = ["SUM_LOCK_TIME", "SUM_ERRORS", "SUM_WARNINGS", "SUM_ROWS_AFFECTED", "SUM_ROWS_EXAMINED",
                   "SUM_CREATED_TMP_DISK_TABLES", "SUM_CREATED_TMP_TABLES", "SUM_SELECT_FULL_JOIN",
                   "SUM_SELECT_FULL_RANGE_JOIN", "SUM_SELECT_RANGE", "SUM_SELECT_RANGE_CHECK", "SUM_SELECT_SCAN",
                   "SUM_SORT_MERGE_PASSES", "SUM_SORT_RANGE", "SUM_SORT_ROWS", "SUM_SORT_SCAN", "SUM_NO_INDEX_USED",
                   "SUM_NO_GOOD_INDEX_USED"]


def mysql_digests(spark: SparkSession, d: str) -> DataFrame:
    """V5: events_statements_summary_by_digest (timers in picoseconds)."""
    s = _statement_facts(spark, d)
    c = F.col
    sum_ps = c("centi_ms") * 10000000
    return s.select(
        *key(F.concat(F.lit("db"), (c("user_id") % 10).cast("string"))),
        F.when(c("user_id") % 10 != 0, F.concat(F.lit("schema"), (c("user_id") % 10).cast("string"))).alias("SCHEMA_NAME"),
        F.when(c("event_type") != "error", F.concat(F.lit("d"), c("event_type"), c("user_id").cast("string"))).alias("DIGEST"),
        F.concat(F.lit("SELECT ? FROM "), c("event_type")).alias("DIGEST_TEXT"),
        c("calls").alias("COUNT_STAR"),
        sum_ps.alias("SUM_TIMER_WAIT"),
        (c("calls") * 1000).alias("MIN_TIMER_WAIT"),
        (F.expr("centi_ms * 10000000 div calls div 1000") * 1000).alias("AVG_TIMER_WAIT"),
        (sum_ps + 1).alias("MAX_TIMER_WAIT"),
        *[(c("calls") % (i + 2)).alias(name) for i, name in enumerate(DIGEST_COUNTERS[:4])],
        (c("calls") * 2).alias("SUM_ROWS_SENT"),
        *[(c("calls") % (i + 2)).alias(name) for i, name in enumerate(DIGEST_COUNTERS) if i > 3],
        c("first_seen").alias("FIRST_SEEN"),
        c("last_seen").alias("LAST_SEEN"),
    )


def mysql_status(spark: SparkSession, d: str) -> DataFrame:
    """V7: SHOW GLOBAL STATUS rows with their output position ``ord``.

    Databases with user_id % 7 = 0 also report an upper-case duplicate of each
    counter later in the output (doubled value): the later one must win.
    """
    e = read_table(spark, d, "events", "user_id", "event_type")
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    c = F.col
    name = _case(c("event_type"), STATUS_NAME_BY_EVENT)
    ordinal = _case(c("event_type"), {k: i for i, k in enumerate(STATUS_NAME_BY_EVENT)})
    k = key(c("user_id").cast("string"))
    base = g.select(*k, name.alias("Variable_name"), c("n").cast("string").alias("Value"),
                    (ordinal * 2).alias("ord"))
    dup = g.filter(c("user_id") % 7 == 0).select(
        *k, F.upper(name).alias("Variable_name"), (c("n") * 2).cast("string").alias("Value"),
        (ordinal * 2 + 1).alias("ord"))
    return base.unionByName(dup)


def innodb_metrics(spark: SparkSession, d: str) -> DataFrame:
    """information_schema.innodb_metrics (name, subsystem, count)."""
    e = read_table(spark, d, "events", "user_id", "event_type")
    g = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    c = F.col
    return g.select(
        *key(c("user_id").cast("string")),
        F.concat(F.lit("trx_"), c("event_type")).alias("name"),
        F.when(c("event_type").isin("purchase", "signup", "error"), F.lit("transaction"))
         .otherwise(F.lit("server")).alias("subsystem"),
        c("n").alias("count"),
    )


def pg_stat_database(spark: SparkSession, d: str) -> DataFrame:
    """pg_stat_database and its conflicts view: one row per customer database."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                   "o_orderpriority")
    c = F.col
    st = c("o_orderstatus")
    g = o.groupBy("o_custkey").agg(
        F.count("*").alias("numbackends"),
        F.sum(c("o_orderkey") % 100).alias("xact_commit"),
        F.count_if(st == "F").alias("xact_rollback"),
        F.sum(F.floor("o_totalprice")).cast("bigint").alias("blks_read"),
        F.sum(c("o_orderkey")).alias("blks_hit"),
        F.count_if(st == "O").alias("tup_returned"),
        F.count_if(st == "P").alias("tup_fetched"),
        F.count_if(c("o_orderpriority") == "1-URGENT").alias("tup_inserted"),
        F.count_if(c("o_orderpriority") == "2-HIGH").alias("tup_updated"),
        F.count_if(c("o_orderpriority") == "5-LOW").alias("tup_deleted"),
        F.count_if(c("o_orderkey") % 13 == 0).alias("conflicts"),
        F.count_if(c("o_orderkey") % 17 == 0).alias("temp_files"),
        F.sum(c("o_orderkey") % 1000 * 1024).alias("temp_bytes"),
        F.count_if(c("o_orderkey") % 101 == 0).alias("deadlocks"),
        F.sum(F.floor(c("o_totalprice") / 100)).alias("blk_read_time"),
        F.sum(F.floor(c("o_totalprice") / 1000)).alias("blk_write_time"),
        F.count_if(c("o_orderkey") % 19 == 0).alias("confl_tablespace"),
        F.count_if(c("o_orderkey") % 23 == 0).alias("confl_lock"),
        F.count_if(c("o_orderkey") % 29 == 0).alias("confl_snapshot"),
        F.count_if(c("o_orderkey") % 31 == 0).alias("confl_bufferpin"),
        F.count_if(c("o_orderkey") % 37 == 0).alias("confl_deadlock"),
    )
    return g.select(*key(F.concat(F.lit("db"), (c("o_custkey") % 10).cast("string"))),
                    F.concat(F.lit("d"), c("o_custkey").cast("string")).alias("datname"),
                    *[x for x in g.columns if x != "o_custkey"])


def pg_stat_bgwriter(spark: SparkSession, d: str) -> DataFrame:
    """A global view: one row per database snapshot; database db3 reports it twice."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = F.col
    g = o.groupBy((c("o_custkey") % 10).alias("m")).agg(
        F.count(F.lit(1)).alias("checkpoints_timed"), F.sum(c("o_orderkey") % 7).alias("checkpoints_req"),
        F.max("o_totalprice").alias("buffers_max"))
    one = g.select(*key(F.concat(F.lit("db"), c("m").cast("string"))), "checkpoints_timed", "checkpoints_req",
                   "buffers_max")
    dup = one.filter(c("db_key") == "db3").withColumn("checkpoints_timed", c("checkpoints_timed") + 1)
    return one.unionByName(dup)


# ---------------------------------------------------------------- V6 / V8 ------

def pg_stat_activity(spark: SparkSession, d: str) -> DataFrame:
    """V6: sessions (pg_stat_activity); query_id is present from v14."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = F.col
    m = c("o_custkey") % 10
    return o.select(
        *key(F.concat(F.lit("db"), m.cast("string"))),
        _pick(m % 5, PG_VERSION_BY_MOD5).alias("server_version"),
        c("o_orderkey").alias("pid"),
        c("o_custkey").alias("query_id"),
        (c("o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("backend_start"),
        c("o_orderdate").alias("query_start"),
        m.alias("datid"),
        F.concat(F.lit("d"), m.cast("string")).alias("datname"),
        c("o_orderstatus").alias("state"),
        (c("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("state_change"),
        F.when(c("o_orderkey") % 3 == 0, F.lit("ClientRead")).alias("wait_event"),
        F.when(c("o_orderkey") % 3 == 0, F.lit("Client")).alias("wait_event_type"),
        F.lit("client backend").alias("backend_type"),
        c("o_orderdate").alias("xact_start"),
    )


def own_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The collector's own backend pid per snapshot (pg_backend_pid())."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey").filter(F.col("o_orderkey") % 1000 == 0)
    return o.select(*key(F.concat(F.lit("db"), (F.col("o_custkey") % 10).cast("string"))),
                    F.col("o_orderkey").alias("pid"))


# The remaining counters of events_statements_current.
STATEMENT_COUNTERS = ["ROWS_AFFECTED", "CREATED_TMP_DISK_TABLES", "CREATED_TMP_TABLES", "SELECT_FULL_JOIN",
                      "SELECT_FULL_RANGE_JOIN", "SELECT_RANGE", "SELECT_RANGE_CHECK", "SELECT_SCAN",
                      "SORT_MERGE_PASSES", "SORT_RANGE", "SORT_ROWS", "SORT_SCAN", "NO_INDEX_USED",
                      "NO_GOOD_INDEX_USED"]


def mysql_current_statements(spark: SparkSession, d: str) -> DataFrame:
    """V6: performance_schema.events_statements_current, timers in ps."""
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = F.col
    wait = F.floor("o_totalprice").cast("bigint") * 1000000000
    return o.select(
        *key(F.concat(F.lit("db"), (c("o_custkey") % 10).cast("string"))),
        c("o_orderkey").alias("THREAD_ID"),
        (c("o_orderkey") % 1000).alias("EVENT_ID"),
        F.lit("statement/sql/select").alias("EVENT_NAME"),
        (c("o_orderkey") * 1000000).alias("TIMER_START"),
        (c("o_orderkey") * 1000000 + wait).alias("TIMER_END"),
        wait.alias("TIMER_WAIT"),
        (c("o_orderkey") % 100 * 1000).alias("LOCK_TIME"),
        F.nullif(c("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("DIGEST"),
        F.concat(F.lit("SELECT * FROM t WHERE p = "), c("o_orderpriority")).alias("DIGEST_TEXT"),
        (c("o_orderkey") % 10).alias("ROWS_SENT"),
        (c("o_custkey") % 100).alias("ROWS_EXAMINED"),
        *[(c("o_orderkey") % (i + 2)).alias(name) for i, name in enumerate(STATEMENT_COUNTERS)],
    )


def vacuum_activity_src(spark: SparkSession, d: str) -> DataFrame:
    """V8: sessions whose query text mentions vacuum in various forms."""
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_size")
    c = F.col
    m = c("p_size") % 4
    q = (F.when(m == 0, F.concat(F.lit("-- nightly job "), c("p_name"), F.lit("\n VACUUM "), c("p_name"),
                                 F.lit("\t;")))
         .when(m == 1, F.concat(F.lit("autovacuum: VACUUM ANALYZE public."), F.regexp_replace("p_name", " ", "_")))
         .when(m == 2, F.concat(F.lit("vacuum "), c("p_name"), F.lit("; select 1")))
         .otherwise(F.concat(F.lit("select "), c("p_name"))))
    return p.select(
        *key(c("p_brand"), _ldb_by_part(c("p_partkey"))),
        F.lit("postgres").alias("usename"),
        (c("p_partkey") % 3).alias("datid"),
        F.concat(F.lit("db"), (c("p_partkey") % 3).cast("string")).alias("datname"),
        c("p_partkey").alias("pid"),
        F.when(m == 1, F.lit("Timeout")).alias("wait_event_type"),
        F.when(m == 1, F.lit("VacuumDelay")).alias("wait_event"),
        F.lit("active").alias("state"),
        q.alias("query"),
    )


def vacuum_own_sessions(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_brand").filter(F.col("p_partkey") % 100 == 0)
    return p.select(*key(F.col("p_brand"), _ldb_by_part(F.col("p_partkey"))), F.col("p_partkey").alias("pid"))


# ---------------------------------------------------------------- V9 -----------

def status_text(spark: SparkSession, d: str) -> DataFrame:
    """V9: engine status text, one document per database."""
    return read_table(spark, d, "documents", "doc_id", "text")


# ---------------------------------------------------------------- V10 ----------

def catalog_namespace(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "region", "r_regionkey", "r_name")
    c = F.col
    nsp = (F.when(c("r_regionkey") == 0, F.lit("pg_catalog"))
           .when(c("r_regionkey") == 1, F.lit("pg_toast_1"))
           .when(c("r_regionkey") == 4, F.lit("information_schema"))
           .otherwise(F.lower("r_name")))
    return r.select(*key(F.lit("db0")), c("r_regionkey").cast("bigint").alias("oid"), nsp.alias("nspname"))


_RELKIND = ["r", "p", "v", "m", "S"]


def catalog_class(spark: SparkSession, d: str) -> DataFrame:
    """pg_class: tables from nation, index relations from part."""
    n = read_table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    c = F.col
    tables = n.select(
        *key(F.lit("db0")),
        c("n_nationkey").cast("bigint").alias("oid"),
        F.lower("n_name").alias("relname"),
        c("n_regionkey").cast("bigint").alias("relnamespace"),
        _pick(c("n_nationkey") % 5, _RELKIND).alias("relkind"),
        F.lit(0).cast("bigint").alias("relam"),
        F.lit(0).cast("bigint").alias("reltablespace"),
        F.when(c("n_nationkey") % 2 == 0, F.lit("postgres")).otherwise(F.lit("app")).alias("owner"),
        F.when(c("n_nationkey") % 7 == 0, F.lit("u")).otherwise(F.lit("p")).alias("relpersistence"),
        F.when(c("n_nationkey") % 3 == 0, F.concat(F.lit("table of "), c("n_name"))).alias("description"),
    )
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    idx = p.select(
        *key(F.lit("db0")),
        (c("p_partkey") + 1000000).alias("oid"),
        F.concat(F.lit("idx_"), c("p_partkey").cast("string")).alias("relname"),
        ((c("p_partkey") % 25) % 5).cast("bigint").alias("relnamespace"),
        F.lit("i").alias("relkind"),
        F.when(c("p_size") % 2 == 0, F.lit(403)).otherwise(F.lit(405)).cast("bigint").alias("relam"),
        F.when(c("p_size") % 5 == 0, F.lit(1663)).otherwise(F.lit(0)).cast("bigint").alias("reltablespace"),
        F.lit("postgres").alias("owner"),
        F.lit("p").alias("relpersistence"),
        F.lit(None).cast("string").alias("description"),
    )
    s = read_table(spark, d, "supplier", "s_suppkey").filter("s_suppkey >= 1000 and s_suppkey % 1000 < 25")
    more = _more_tables(s, _attrelid())          # the tables of catalog_attribute beyond the first 25
    plain = _more_tables(read_table(spark, d, "customer", "c_custkey"), c("c_custkey") + 3000000)
    return tables.unionByName(idx).unionByName(more).unionByName(plain)


def _more_tables(df: DataFrame, oid: Column) -> DataFrame:
    return df.select(oid.cast("bigint").alias("oid")).select(
        *key(F.lit("db0")), "oid", F.concat(F.lit("table_"), F.col("oid").cast("string")).alias("relname"),
        (F.col("oid") % 5).alias("relnamespace"), _pick(F.col("oid") % 5, _RELKIND).alias("relkind"),
        F.lit(0).cast("bigint").alias("relam"), F.lit(0).cast("bigint").alias("reltablespace"),
        F.when(F.col("oid") % 2 == 0, F.lit("postgres")).otherwise(F.lit("app")).alias("owner"),
        F.when(F.col("oid") % 7 == 0, F.lit("u")).otherwise(F.lit("p")).alias("relpersistence"),
        F.when(F.col("oid") % 3 == 0, F.concat(F.lit("table of "), F.col("oid").cast("string"))).alias("description"))


def catalog_am(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_size")
    am = p.select(F.when(F.col("p_size") % 2 == 0, F.lit(403)).otherwise(F.lit(405)).cast("bigint").alias("oid")).distinct()
    return am.select(*key(F.lit("db0")), "oid",
                     F.when(F.col("oid") == 403, F.lit("btree")).otherwise(F.lit("hash")).alias("amname"))


def _attrelid() -> Column:
    # 25 tables per block of 1,000 suppliers: a table never has more than 40 columns
    return F.expr("s_suppkey % 25 + 25 * (s_suppkey div 1000)")


def _attnum_abs() -> Column:
    return F.expr("(s_suppkey % 1000) div 25") + 1


def catalog_attribute(spark: SparkSession, d: str) -> DataFrame:
    """pg_attribute from supplier: 25 tables per 1,000 suppliers, at most 40 columns each
    (the engine bounds columns per table; the stand-in keeps that bound at every scale)."""
    s = read_table(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal")
    c = F.col
    num = _attnum_abs()
    return s.select(
        *key(F.lit("db0")),
        _attrelid().alias("attrelid"),
        F.when(c("s_suppkey") % 13 == 0, -num).otherwise(num).cast("int").alias("attnum"),
        F.lower(F.regexp_replace("s_name", "#", "_")).alias("attname"),
        (c("s_suppkey") % 3).alias("atttypid"),
        (c("s_suppkey") % 4).alias("attcollation"),
        (c("s_suppkey") % 11 == 0).alias("attisdropped"),
        (c("s_acctbal") > 0).alias("attnotnull"),
        F.when(c("s_suppkey") % 3 == 0, F.lit(-1)).otherwise(c("s_suppkey") % 100).cast("int").alias("attstattarget"),
        (c("s_suppkey") % 4 == 0).alias("atthasdef"),
        F.when(c("s_suppkey") % 6 == 1, F.lit("a")).otherwise(F.lit("")).alias("attidentity"),
        F.when(c("s_suppkey") % 3 == 1, F.lit("x")).otherwise(F.lit("p")).alias("attstorage"),
        F.when(c("s_suppkey") % 8 == 3, F.lit("s")).otherwise(F.lit("")).alias("attgenerated"),
        F.when(c("s_suppkey") % 5 == 0, F.concat(F.lit("note "), c("s_name"))).alias("description"),
    )


def catalog_attrdef(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey")  # one a column: what counts is the column's atthasdef
    c = F.col
    num = _attnum_abs()
    return s.select(
        *key(F.lit("db0")),
        _attrelid().alias("adrelid"),
        F.when(c("s_suppkey") % 13 == 0, -num).otherwise(num).cast("int").alias("adnum"),
        F.concat(F.lit("nextval('seq_"), c("s_suppkey").cast("string"), F.lit("'::regclass)")).alias("adsrc"),
    )


def catalog_type(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey")
    t = s.select((F.col("s_suppkey") % 3).alias("oid")).distinct()
    return t.select(*key(F.lit("db0")), "oid",
                    _pick(F.col("oid"), ["integer", "text", "numeric(12,2)"]).alias("typname"),
                    F.when(F.col("oid") == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("typcollation"))


def catalog_collation(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey")
    t = s.select((F.col("s_suppkey") % 4).alias("oid")).distinct()
    return t.select(*key(F.lit("db0")), "oid",
                    _pick(F.col("oid"), ["-", "default", "C", "en_US"]).alias("collname"))


_CONTYPE = ["p", "u", "x", "f"]


def catalog_index(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    c = F.col
    return p.select(
        *key(F.lit("db0")),
        (c("p_partkey") + 1000000).alias("indexrelid"),
        (c("p_partkey") % 25).alias("indrelid"),
        (c("p_size") % 10 == 0).alias("indisprimary"),
        (c("p_size") % 2 == 0).alias("indisunique"),
        (c("p_size") % 7 == 0).alias("indisclustered"),
        (c("p_partkey") % 50 != 7).alias("indisvalid"),
        (c("p_size") % 9 == 0).alias("indisreplident"),
        F.array((c("p_size") % 3 + 1).cast("int"),
                F.when(c("p_partkey") % 11 == 4, F.lit(0)).otherwise((c("p_size") % 2 + 4).cast("int"))).alias("indkey"),
        F.when(c("p_partkey") % 11 == 4, F.array(F.concat(F.lit("lower(c"), c("p_size").cast("string"), F.lit(")"))))
        .alias("indexprs"),
        F.concat(F.lit("CREATE INDEX idx_"), c("p_partkey").cast("string"), F.lit(" ON t"),
                 (c("p_partkey") % 25).cast("string")).alias("indexdef"),
    )


def catalog_constraint(spark: SparkSession, d: str) -> DataFrame:
    """pg_constraint: one per part; keys, exclusions and foreign keys, and checks, which no inventory lists."""
    p = read_table(spark, d, "part", "p_partkey", "p_size")
    c = F.col
    ct = F.when((c("p_partkey") % 5).isin(2, 3), _pick(c("p_size") % 4, _CONTYPE)).otherwise("c")
    return p.select(
        *key(F.lit("db0")),
        (c("p_partkey") + 5000000).alias("oid"),
        F.concat(F.lit("con_"), c("p_partkey").cast("string")).alias("conname"),
        ct.alias("contype"),
        (c("p_partkey") % 25).alias("conrelid"),
        F.when(ct.isin("f", "c"), F.lit(0)).otherwise(c("p_partkey") + 1000000).alias("conindid"),
        (c("p_size") % 3 == 0).alias("condeferrable"),
        (c("p_size") % 6 == 0).alias("condeferred"),
        F.when(c("p_partkey") % 15 == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("conparentid"),
        F.concat(F.when(ct == "f", F.lit("FOREIGN KEY (c1) REFERENCES t")).when(ct == "c", F.lit("CHECK (c"))
                 .otherwise(F.lit("UNIQUE (c")),
                 (c("p_size") % 25).cast("string"),
                 F.when(ct == "f", F.lit("(c1)")).otherwise(F.lit(")"))).alias("condef"),
    )


def catalog_views(spark: SparkSession, d: str) -> DataFrame:
    """pg_views: the class rows of kind 'v' (from nation) plus one view per part, in namespace p_partkey % 5."""
    n = read_table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    n = n.withColumn("relkind", _pick(F.col("n_nationkey") % 5, _RELKIND)).filter("relkind = 'v'")
    r = read_table(spark, d, "region", "r_regionkey", "r_name")
    c = F.col
    nsp = (F.when(c("r_regionkey") == 0, F.lit("pg_catalog"))
           .when(c("r_regionkey") == 1, F.lit("pg_toast_1"))
           .when(c("r_regionkey") == 4, F.lit("information_schema"))
           .otherwise(F.lower("r_name")))
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # region: 5 rows at every scale
    base = j.select(*key(F.lit("db0")), nsp.alias("schemaname"), F.lower("n_name").alias("viewname"),
                    F.lit("postgres").alias("viewowner"),
                    F.concat(F.lit(" SELECT * FROM region WHERE r_regionkey = "), c("n_regionkey").cast("string"))
                    .alias("definition"))
    p = read_table(spark, d, "part", "p_partkey", "p_type")
    pj = p.join(F.broadcast(r), (p.p_partkey % 5) == r.r_regionkey)
    parts = pj.select(*key(F.lit("db0")), nsp.alias("schemaname"),
                      F.concat(F.lit("v_"), c("p_partkey").cast("string")).alias("viewname"),
                      F.lit("app").alias("viewowner"),
                      F.concat(F.lit(" SELECT * FROM part WHERE p_type = '"), c("p_type"), F.lit("'"))
                      .alias("definition"))
    return base.unionByName(parts)


def mysql_columns(spark: SparkSession, d: str) -> DataFrame:
    """information_schema.columns (MySQL), from supplier."""
    s = read_table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    c = F.col
    return s.select(
        *key(F.concat(F.lit("db"), (c("s_nationkey") % 3).cast("string"))),
        _case(c("s_suppkey") % 20, {0: "mysql", 1: "sys"},
              F.concat(F.lit("app"), (c("s_nationkey") % 4).cast("string"))).alias("TABLE_SCHEMA"),
        F.concat(F.lit("t"), c("s_nationkey").cast("string")).alias("TABLE_NAME"),
        F.lower(F.regexp_replace("s_name", "#", "_")).alias("COLUMN_NAME"),
        (F.expr("s_suppkey div 25") + 1).alias("ORDINAL_POSITION"),
        F.when(c("s_suppkey") % 4 == 0, F.lit("0")).alias("COLUMN_DEFAULT"),
        F.when(c("s_acctbal") > 0, F.lit("NO")).otherwise(F.lit("YES")).alias("IS_NULLABLE"),
        _pick(c("s_suppkey") % 3, ["int", "varchar", "decimal"]).alias("DATA_TYPE"),
        F.when(c("s_suppkey") % 3 == 1, F.lit("utf8mb4_0900_ai_ci")).alias("COLLATION_NAME"),
        F.lit("").alias("COLUMN_COMMENT"),
    )


def mysql_referential_constraints(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    c = F.col
    sch = _case(c("p_partkey") % 20, {0: "mysql", 1: "sys"}, F.concat(F.lit("app"), (c("p_partkey") % 4).cast("string")))
    return p.select(
        *key(c("p_brand")),
        sch.alias("CONSTRAINT_SCHEMA"),
        F.concat(F.lit("t"), (c("p_partkey") % 25).cast("string")).alias("TABLE_NAME"),
        F.concat(F.lit("fk_"), c("p_partkey").cast("string")).alias("CONSTRAINT_NAME"),
        sch.alias("UNIQUE_CONSTRAINT_SCHEMA"),
        F.lit("PRIMARY").alias("UNIQUE_CONSTRAINT_NAME"),
        _pick(c("p_size") % 3, ["NO ACTION", "CASCADE", "RESTRICT"]).alias("UPDATE_RULE"),
        _pick(c("p_size") % 2, ["NO ACTION", "CASCADE"]).alias("DELETE_RULE"),
        F.concat(F.lit("t"), (c("p_size") % 25).cast("string")).alias("REFERENCED_TABLE_NAME"),
    )


def mysql_views(spark: SparkSession, d: str) -> DataFrame:
    t = mysql_tables(spark, d).filter(F.col("TABLE_TYPE") == "VIEW")
    return t.select(
        "organization_id", "db_key", "logical_database_name", "observation_time",
        "TABLE_SCHEMA", "TABLE_NAME",
        F.concat(F.lit("select * from "), F.col("TABLE_NAME"), F.lit("_base")).alias("VIEW_DEFINITION"),
        F.when(F.col("TABLE_ROWS") % 2 == 0, F.lit("YES")).otherwise(F.lit("NO")).alias("IS_UPDATABLE"),
        F.lit("NONE").alias("CHECK_OPTION"),
        F.lit("DEFINER").alias("SECURITY_TYPE"),
    )


def replication_servers(spark: SparkSession, d: str) -> DataFrame:
    """One row per server (a user of events): a replica where it has sign-ups, a primary where it has purchases."""
    e = read_table(spark, d, "events", "user_id", "event_type")
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                 *[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in ("signup", "purchase")])
    return g.select(*key(F.col("user_id").cast("string")), "n", "n_signup", "n_purchase")


def failed_halves(spark: SparkSession, d: str) -> DataFrame:
    """Halves of a table document that a server could not collect: the indexes of brands with an odd number of parts."""
    p = read_table(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return p.filter("n % 2 = 1").select(*key(F.col("p_brand")), F.lit("indexes").alias("half")).drop("logical_database_name")


# ---------------------------------------------------------------- V11-V14 -----

def agent_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors queued by the agents (event_type = 'error')."""
    e = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    c = F.col
    return e.filter(c("event_type") == "error").select(
        F.lit(ORG).alias("organization_id"),
        F.concat(F.lit("db"), (c("user_id") % 3).cast("string")).alias("db_key"),
        c("event_id").alias("error_id"),
        F.when(c("user_id") % 2 == 0, F.lit("PostgresCollectorException"))
         .otherwise(F.lit("CloudWatchException")).alias("name"),
        c("props").alias("message"),
        F.concat(F.lit("Traceback (most recent call last): event "), c("event_id").cast("string")).alias("stacktrace"),
        c("ts").alias("timestamp"),
    )


def agent_activity(spark: SparkSession, d: str) -> DataFrame:
    """Life span of each agent: first and last activity seen for the database."""
    e = read_table(spark, d, "events", "ts", "user_id")
    c = F.col
    return e.groupBy(F.concat(F.lit("db"), (c("user_id") % 3).cast("string")).alias("db_key")).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    ).select(F.lit(ORG).alias("organization_id"), "db_key", "first_seen", "last_seen")


def observation_log(spark: SparkSession, d: str) -> DataFrame:
    """Documents posted by the agents (one per event)."""
    e = read_table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props")
    c = F.col
    return e.select(
        F.concat(F.lit("org"), (c("user_id") % 3).cast("string")).alias("organization_id"),
        c("user_id").cast("string").alias("db_key"),
        _case(c("event_type"), OBS_TYPE_BY_EVENT).alias("obs_type"),
        c("ts").alias("observation_time"),
        c("props").alias("payload"),
        c("event_id").alias("id"),
    )


def knob_rows(spark: SparkSession, d: str) -> DataFrame:
    """(name, setting) rows per database, ``ord`` = output position."""
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_size")
    c = F.col
    return p.select(
        *key(c("p_brand")),
        c("p_partkey").alias("ord"),
        F.regexp_replace("p_name", " ", "_").alias("name"),
        c("p_size").cast("string").alias("setting"),
        F.when(c("p_size") % 2 == 0, F.lit("user")).otherwise(F.lit("engine-default")).alias("source"),
        _pick(c("p_partkey") % 5, SERVER_VERSION_BY_MOD5).alias("server_version"),
    )


def extensions(spark: SparkSession, d: str) -> DataFrame:
    """pg_extension rows per database."""
    p = read_table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    c = F.col
    return p.select(
        *key(c("p_brand")),
        F.when((c("p_size") == 9) & (c("p_partkey") % 2 == 0), F.lit("pg_stat_statements"))
         .otherwise(F.lit("plpgsql")).alias("extname"),
    )


def envelope_documents(spark: SparkSession, d: str) -> DataFrame:
    """{columns, rows} JSON documents of the supplier rows, one set per database
    ('db' || nation % 5), paged; even and odd nations list the columns in different orders."""
    from fleetlens.operators.observations import envelope_pack

    sp = read_table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    c = F.col
    rows = sp.select(*key(F.concat(F.lit("db"), (c("s_nationkey") % 5).cast("string"))),
                     "s_suppkey", "s_name", "s_nationkey")
    even = envelope_pack(rows.filter(c("s_nationkey") % 2 == 0), "supplier",
                         ["s_suppkey", "s_name", "s_nationkey"], ["s_suppkey"], 1000)
    odd = envelope_pack(rows.filter(c("s_nationkey") % 2 == 1), "supplier",
                        ["s_name", "s_nationkey", "s_suppkey"], ["s_suppkey"], 1000)
    return even.unionByName(odd)
