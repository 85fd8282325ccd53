"""Whole observation documents: what one agent posts per database and observation.

* table, query, long-running and schema documents: items of rows, packed by
  ``sources.envelopes.pack`` and put together per document and page;
* the database document: settings, the metric tree, row counts, parameters.

A document of a large server is several pages, each a valid document of at most
``page_rows`` rows an item; page 0 has every item, also those without rows.
An item's half (tables, indexes) that failed for a server is left out of its
document and leaves the other half as it is.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import iso_timestamp
from fleetlens.keys import K
from fleetlens.operators import topn
from fleetlens.sources.envelopes import Item, pack
from fleetlens.sources.shared import write_once

#: A document holds all logical databases of a server: their name is a column of its rows.
DOC = ["organization_id", "db_key", "observation_time"]
LOGICAL = "logical_database_name"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which any may be null; the left keys stay."""
    r = right.select(F.struct(*keys).alias("_k"), *[c for c in right.columns if c not in keys])
    return left.join(r, [F.col(k).eqNullSafe(F.col("_k")[k]) for k in keys], how).drop("_k")


def epoch_seconds(ts: str = "observation_time") -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def empty_item(columns: Sequence[str]) -> str:
    return json.dumps({"columns": list(columns), "rows": []}, separators=(",", ":"))


def documents(halves: Mapping[str, Sequence[Item]], spine: DataFrame, keys: Sequence[str] = DOC, page_rows: int = 1000,
              failed: DataFrame | None = None, unknown: Sequence[str] = ()) -> DataFrame:
    """(keys, page, document) for every row of ``spine`` (keys, version).

    Items of one name are variants of it (other servers have other columns).
    ``failed`` (keys, half) names the halves that a server could not collect;
    items in ``unknown`` have no columns where they have no rows (their source
    is not installed).
    """
    keys = list(keys)
    pages = pack([i for own in halves.values() for i in own], keys, page_rows)
    found = pages.groupBy(*keys, "page").agg(F.map_from_entries(F.collect_list(F.struct("item", "payload"))).alias("_m"))
    doc = _null_safe(spine.select(*keys, "version"), found, keys)
    if failed is None:
        doc = doc.withColumn("_failed", F.array().cast("array<string>"))
    else:
        doc = _null_safe(doc, failed.groupBy(*keys).agg(F.collect_set("half").alias("_failed")), keys)
    page = F.coalesce("page", F.lit(0).cast("bigint"))
    parts, seen = [], set()
    for half, own in halves.items():
        for item in own:
            if item.name in seen:
                continue
            seen.add(item.name)
            empty = F.when(page == 0, F.lit(empty_item([] if item.name in unknown else item.names(keys))))
            text = F.coalesce(F.col("_m")[item.name], empty)
            fine = ~F.array_contains(F.coalesce("_failed", F.array().cast("array<string>")), half)
            parts.append(F.when(fine, F.concat(F.lit(f'"{item.name}":'), text)))
    data = F.array_join(F.array_compact(F.array(*parts)), ",")
    summary = F.struct("version", epoch_seconds().alias("observation_time"))
    rest = F.to_json(F.struct(summary.alias("summary"), "db_key", "organization_id"))
    return (doc.select(*keys, page.alias("page"), data.alias("_data"), rest.alias("_rest"))
            .filter((F.col("page") == 0) | (F.col("_data") != ""))
            .select(*keys, "page", F.concat(F.lit('{"data":{'), "_data", F.lit("},"), F.expr("substring(_rest, 2)"))
                    .alias("document")))


# -------------------------------------------------------- one target set a run ----
def target_tables(table_stats: DataFrame, n: int) -> DataFrame:
    """The target tables of every snapshot with all their statistics, written once: every item reads this table."""
    c = F.col
    live = table_stats.filter(c("n_live_tup") + c("seq_scan") + c("idx_scan") > 0)
    return write_once(topn.top_n_per_key(
        live, n, [c("n_live_tup").desc(), (c("seq_scan") + c("idx_scan")).desc(), c("relid").asc()],
        salt_by=["relid"], rank_col="rank"), "target_tables")


def target_indexes(index_stats: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """The target tables' largest indexes with all their statistics, written once."""
    c = F.col
    return write_once(topn.top_n_per_key(
        topn.target_semi(index_stats, targets), n, [c("index_size").desc_nulls_first(), c("indexrelid").asc()],
        salt_by=["indexrelid"], rank_col="rank"), "target_indexes")


def _all(df: DataFrame, *without: str) -> list[str]:
    """Columns of a ``SELECT *`` item, the logical database last."""
    return [c for c in df.columns if c not in (*K, *without)] + [LOGICAL]


def table_half(targets: DataFrame, io: DataFrame, sizes: DataFrame, bloat: DataFrame) -> list[Item]:
    by = [LOGICAL, "relid"]
    io, sizes = (topn.target_semi(x, targets) for x in (io, sizes))
    toast = (F.col("table_size") - F.col("relation_size")).alias("toast_size")
    sizes = sizes.select(*K, "relid", "indexes_size", "relation_size", toast)
    return [Item("pg_stat_user_tables_all_fields", targets, by, _all(targets, "rank")),
            Item("pg_statio_user_tables_all_fields", io, by, _all(io)),
            Item("pg_stat_user_tables_table_sizes", sizes, by, _all(sizes)),
            Item("table_bloat_ratios", bloat, by, ["relid", "bloat_ratio", LOGICAL])]


def index_half(indexes: DataFrame, catalog: DataFrame) -> list[Item]:
    """``indexes``: the written target indexes; only the catalog is scanned besides."""
    by = [LOGICAL, "indexrelid"]
    catalog = topn.target_semi(catalog, indexes, on=K + ["indexrelid"])
    stats = ["relid", "indexrelid", "schemaname", "relname", "indexrelname", "idx_scan", "idx_tup_read", "idx_tup_fetch"]
    return [Item("pg_stat_user_indexes_all_fields", indexes, by, [*stats, LOGICAL]),
            Item("pg_statio_user_indexes_all_fields", indexes, by, ["indexrelid", "idx_blks_read", "idx_blks_hit", LOGICAL]),
            Item("pg_index_all_fields", catalog, by, _all(catalog)),
            Item("indexes_size", indexes, [LOGICAL, "rank"], ["indexrelid", "index_size", LOGICAL])]


# The columns that the MySQL items name.
MYSQL_STATISTICS = ["TABLE_SCHEMA", "TABLE_NAME", "NON_UNIQUE", "INDEX_SCHEMA", "INDEX_NAME", "SEQ_IN_INDEX", "COLUMN_NAME",
                    "COLLATION", "CARDINALITY", "SUB_PART", "NULLABLE", "INDEX_TYPE"]
MYSQL_INDEX_SIZE = ["DATABASE_NAME", "TABLE_NAME", "INDEX_NAME", "STAT_VALUE", "SIZE_IN_BYTE"]


def table_half_mysql(targets: DataFrame) -> list[Item]:
    return [Item("information_schema_TABLES", targets, ["rank"], topn.MYSQL_TABLE_COLUMNS)]


def index_half_mysql(sizes: DataFrame, statistics: DataFrame, usage: DataFrame) -> list[Item]:
    """``sizes``: the target indexes (written once), by name."""
    named = K + ["DATABASE_NAME", "TABLE_NAME", "INDEX_NAME"]
    st = topn.target_semi(statistics, sizes, on=named, left_on=K + ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME"])
    us = topn.target_semi(usage.filter(F.col("OBJECT_TYPE") == "TABLE"), sizes, on=named,
                          left_on=K + ["OBJECT_SCHEMA", "OBJECT_NAME", "INDEX_NAME"])
    return [Item("information_schema_STATISTICS", st, ["TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "SEQ_IN_INDEX"],
                 MYSQL_STATISTICS),
            Item("performance_schema_table_io_waits_summary_by_index_usage", us,
                 ["OBJECT_SCHEMA", "OBJECT_NAME", "INDEX_NAME"], [c for c in us.columns if c not in K]),
            Item("indexes_size", sizes, ["rank"], MYSQL_INDEX_SIZE)]


# ---------------------------------------------------------------- metric tree ----
def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, name, value) of a view's rows: null fields left out, times in ISO form, whole numbers and flags as such."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("name"), (iso_timestamp(c) if kinds[c].startswith("timestamp") else F.col(c))
                      .cast("variant").alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_e")).select(*keys, "_e.name", "_e.value").filter(
        F.col("value").isNotNull())


def _fold(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One VARIANT object per ``keys`` of the (name, value) below: a level of the tree becomes a value of the next."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col(name).cast("string"), "value")))
    return df.filter(F.col(name).isNotNull()).groupBy(*keys).agg(F.to_variant_object(pairs).alias("value"))


#: Parts of the tree that are there also when they hold nothing.
PG_CATEGORIES = ("database", "table", "index", "process")
MYSQL_CATEGORIES = ("global", "innodb_metrics", "performance_schema", "engine", "derived")


def _with_categories(folded: DataFrame, category: str, names: Sequence[str]) -> DataFrame:
    """(K, value): an object with exactly ``names``, empty objects where a snapshot has nothing."""
    empty = F.parse_json(F.lit("{}"))
    parts = [F.coalesce(F.first(F.when(F.col(category) == n, F.col("value")), ignorenulls=True), empty).alias(n)
             for n in names]
    return folded.groupBy(*K).agg(*parts).select(*K, F.to_variant_object(F.struct(*names)).alias("value"))


def metric_tree(views: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(K, value) of the global and of the local metrics of PostgreSQL.

    ``views`` (K, view, name, value): one row a metric of the single-row views.
    ``local`` (K, category, view, key, name, value): key is ``aggregated`` or the row's own.
    Every level is one aggregation; a node's children are bounded by the
    engine (metrics of a view, workers, views), not by the fleet.
    """
    glob = _fold(_fold(views, K + ["view"], "name"), K, "view")
    rows = _fold(local, K + ["category", "view", "key"], "name")
    named = _fold(_fold(rows, K + ["category", "view"], "key"), K + ["category"], "view")
    return glob, _with_categories(named, "category", PG_CATEGORIES)


def metric_tree_mysql(metrics: DataFrame) -> DataFrame:
    """(K, value) of the global metrics of MySQL from (K, category, name, value); there are no local ones."""
    return _with_categories(_fold(metrics, K + ["category"], "name"), "category", MYSQL_CATEGORIES)


def db_documents(spine: DataFrame, knobs: DataFrame, glob: DataFrame, local: DataFrame | None = None,
                 row_stats: DataFrame | None = None, parameters: DataFrame | None = None) -> DataFrame:
    """(K, document): the database document of every row of ``spine`` (K, version).

    knobs (K, name, setting), glob and local (K, value), row_stats (K and the
    ten counts), parameters (K, name): a part that a snapshot lacks is empty
    and leaves the others as they are.
    """
    null, empty = F.parse_json(F.lit("null")), F.parse_json(F.lit("{}"))
    doc = spine.select(*K, "version")
    settings = _fold(knobs.select(*K, "name", F.col("setting").cast("variant").alias("value")), K, "name")
    doc = _null_safe(doc, settings.withColumnRenamed("value", "_knobs"), K)
    doc = _null_safe(doc, glob.withColumnRenamed("value", "_global"), K)
    own = null
    if local is not None:
        doc = _null_safe(doc, local.withColumnRenamed("value", "_local"), K)
        bare = F.parse_json(F.lit(json.dumps({c: {} for c in PG_CATEGORIES})))
        own = F.coalesce("_local", bare)
    stats = empty
    if row_stats is not None:
        names = [c for c in row_stats.columns if c not in K]
        doc = _null_safe(doc, row_stats.select(*K, F.to_variant_object(F.struct(*names)).alias("_rows")), K)
        stats = F.coalesce("_rows", empty)
    names = F.array().cast("array<string>")
    if parameters is not None:
        doc = _null_safe(doc, parameters.groupBy(*K).agg(F.array_sort(F.collect_set("name")).alias("_names")), K)
        names = F.coalesce("_names", names)
    nothing = empty if local is not None else F.parse_json(F.lit(json.dumps({c: {} for c in MYSQL_CATEGORIES})))
    tree = F.struct(F.coalesce("_global", nothing).alias("global"), own.alias("local"))
    knob = F.struct(F.struct(F.coalesce("_knobs", empty).alias("global")).alias("global"), null.alias("local"))
    whole = F.struct(knob.alias("knobs_data"), tree.alias("metrics_data"),
                     F.struct("version", epoch_seconds().alias("observation_time")).alias("summary"),
                     stats.alias("row_num_stats"), "db_key", "organization_id", names.alias("non_default_knobs"))
    return doc.select(*K, F.to_json(F.to_variant_object(whole)).alias("document"))
