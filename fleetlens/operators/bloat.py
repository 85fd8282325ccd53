"""Table bloat estimate: C5, C11, C12, D5, D6, H6.

The flagship plan is one lazy job per fleet:

    top_tables (F1) -> target set (K, relid)
      -> bloat_factors  : attribute x class x namespace  LEFT  stats   (C12 -> D5)
      -> tuple_padding  : attribute x class x namespace  INNER stats   (C5  -> D6)
      -> bloat_ratio    : factors LEFT padding (C11) -> arithmetic (H6)

The target set (K, relid) becomes the target tables with their names first;
attributes are cut by their ids and statistics by their names before they are
joined with each other, and no list visits the driver.  The only collected group is the columns of one
table (D6), which PostgreSQL bounds at 1,600 attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import fillfactor, max_alignment
from fleetlens.keys import K
from fleetlens.operators.skew import lookup_join
from fleetlens.operators.topn import target_semi
from fleetlens.sources.shared import write_once

# Fixed values.
PAGE_HEADER_SIZE = 24
TUPLE_HEADER_BASE = 23
ALIGNMENT_BYTES = {"c": 1, "s": 2, "i": 4, "d": 8}
BLOAT_RELKINDS = ("r", "m")
MAX_TABLE_COLUMNS = 1600   # PostgreSQL's MaxHeapAttributeNumber bounds a D6 group


# A sort on join or group keys compares them in this order: a table's id or name tells rows apart, and the snapshot
# key, which is equal in long runs of rows, comes last.
BY_ID = ["attrelid", *K]
BY_TABLE = ["relid", *K]
BY_NAME = ["relname", "attname", "nspname", *K]


def _targets(df: DataFrame, targets: DataFrame | None, id_col: str) -> DataFrame:
    if targets is None:
        return df
    return target_semi(df, targets, on=K + ["relid"], left_on=K + [id_col])


def _target_tables(classes: DataFrame, nsp: DataFrame, targets: DataFrame | None, relkinds=None) -> DataFrame:
    """Target classes with their names: a small frame that cuts every larger catalog relation."""
    cls = classes
    if relkinds:
        cls = cls.filter(F.col("relkind").isin(*relkinds))
    cls = _targets(cls, targets, "oid").withColumnRenamed("oid", "attrelid")
    ns = nsp.select(*K, F.col("oid").alias("relnamespace"), "nspname")
    return lookup_join(cls, ns, K + ["relnamespace"], "inner")


def _target_stats(stats: DataFrame, tables: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Statistics of the target tables only: the fleet's other rows are dropped before any shuffle of theirs
    where the target names can be broadcast."""
    named = _stats_on_names(stats)
    if targets is None:
        return named
    return named.join(tables.select(*K, "nspname", "relname").distinct(), K + ["nspname", "relname"], "left_semi")


def _stats_on_names(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.col("inherited")).select(
        *K, F.col("schemaname").alias("nspname"), F.col("tablename").alias("relname"),
        "attname", "null_frac", "avg_width", F.lit(1).alias("stat_found"))


def factor_stats_join(attrs: DataFrame, classes: DataFrame, nsp: DataFrame, stats: DataFrame,
                      targets: DataFrame | None = None) -> DataFrame:
    """Live attributes of target tables (kind r, m), LEFT JOIN column statistics.

    The four-key condition sits in the ON clause, so unanalysed columns stay
    with NULL statistics.
    """
    tables = _target_tables(classes, nsp, targets, BLOAT_RELKINDS)
    base = attrs.filter(~F.col("attisdropped")).join(tables, BY_ID)
    j = base.join(_target_stats(stats, tables, targets), BY_NAME, "left")
    return j.select(*K, F.col("attrelid").alias("relid"), "attname", "attnum", "atttypname",
                    "reltuples", "relpages", "reloptions", "null_frac", "avg_width", "stat_found")


def bloat_factors(attrs: DataFrame, classes: DataFrame, nsp: DataFrame, stats: DataFrame,
                  settings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per table the inputs of the bloat estimate.

    tpl_hdr_size = 23 + (max(null_frac) > 0 ? (7 + #stats) / 8 : 0) + (has oid ? 4 : 0)
    tpl_data_size = sum((1 - null_frac) * avg_width), rounded to 6 decimals so
    that ceil() does not depend on the summation order (quirk Q14)
    is_na = any column of type name, or #user columns != #stats.
    """
    j = factor_stats_join(attrs, classes, nsp, stats, targets)
    s = settings.select(*K, F.col("block_size").cast("double").alias("bs"),
                        max_alignment(F.col("version")).alias("ma"))
    nf = F.coalesce(F.col("null_frac"), F.lit(0.0))
    n_stats = F.count("stat_found")
    g = j.groupBy(*BY_TABLE).agg(
        F.first("relpages").alias("tblpages"),
        F.first("reltuples").alias("reltuples"),
        F.first(fillfactor(F.col("reloptions"))).alias("fillfactor"),
        F.max(nf).alias("_max_nf"),
        n_stats.alias("_n_stats"),
        F.bool_or((F.col("attname") == "oid") & (F.col("attnum") < 0)).alias("_has_oid"),
        F.sum((1 - nf) * F.coalesce(F.col("avg_width"), F.lit(0))).alias("_data"),
        F.bool_or(F.col("atttypname") == "name").alias("_has_name"),
        F.sum(F.when(F.col("attnum") > 0, 1).otherwise(0)).alias("_n_user"),
    )
    hdr = (F.lit(TUPLE_HEADER_BASE)
           + F.when(F.col("_max_nf") > 0, (F.lit(7) + F.col("_n_stats")) / F.lit(8.0)).otherwise(F.lit(0))
           + F.when(F.col("_has_oid"), F.lit(4)).otherwise(F.lit(0)))
    return g.join(s, K).select(
        *K, "relid", "tblpages", "reltuples", "bs", F.lit(PAGE_HEADER_SIZE).alias("page_hdr"),
        "fillfactor",
        (F.col("_has_name") | (F.col("_n_user") != F.col("_n_stats"))).alias("is_na"),
        F.round(F.col("_data"), 6).alias("tpl_data_size"),
        hdr.cast("double").alias("tpl_hdr_size"),
        "ma",
    )


def column_width_join(attrs: DataFrame, classes: DataFrame, nsp: DataFrame, stats: DataFrame,
                      targets: DataFrame | None = None) -> DataFrame:
    """Columns of target tables with an analysed width (inner join on names)."""
    tables = _target_tables(classes, nsp, targets)
    base = attrs.join(tables, BY_ID)
    j = base.join(_target_stats(stats, tables, targets), BY_NAME)
    return j.select(*K, F.col("attrelid").alias("relid"), "attnum", "attname", "attalign", "avg_width")


_ALIGN_SQL = ("CASE x.attalign WHEN 'c' THEN 1 WHEN 's' THEN 2 WHEN 'i' THEN 4 WHEN 'd' THEN 8 "
              "ELSE raise_error(concat('unknown attalign ', x.attalign)) END")

# One step of the padding fold: align the running offset for the next column,
# add the gap to the padding, then move past the column.
_PADDING_FOLD = f"""
aggregate(
  slice(cols, 2, greatest(size(cols) - 1, 0)),
  named_struct('off', cols[0].avg_width, 'pad', 0),
  (acc, x) -> named_struct(
      'off', ((acc.off + {_ALIGN_SQL} - 1) & ~({_ALIGN_SQL} - 1)) + x.avg_width,
      'pad', acc.pad + (((acc.off + {_ALIGN_SQL} - 1) & ~({_ALIGN_SQL} - 1)) - acc.off)),
  acc -> acc.pad + (((acc.off + 3) & ~3) - acc.off))
"""


def tuple_padding(widths: DataFrame) -> DataFrame:
    """Alignment padding per table, an ordered fold over its columns.

    The columns of one table (at most 1,600) are collected in attnum order and
    folded with ``aggregate`` inside the JVM; the first column starts the
    offset, the tuple end is aligned to 4 bytes.
    """
    g = widths.groupBy(*BY_TABLE).agg(
        F.array_sort(F.collect_list(F.struct("attnum", "attalign", "avg_width"))).alias("cols"))
    return g.select(*K, "relid", F.expr(_PADDING_FOLD).cast("bigint").alias("padding"))


def padding_default(factors: DataFrame, padding: DataFrame) -> DataFrame:
    """C11: every factor row with its padding; tables without widths get 0."""
    return factors.join(padding.select(*K, "relid", "padding"), BY_TABLE, "left") \
        .withColumn("padding", F.coalesce(F.col("padding"), F.lit(0).cast("bigint")))


def bloat_ratio_expr(is_na, padding, tpl_data_size, tpl_hdr_size, ma, tblpages, reltuples, bs,
                     page_hdr, fillfactor_):
    """H6 as a Column, in the reference's order of operations."""
    d = tpl_data_size + padding
    hdr_rem = F.when(tpl_hdr_size % ma == 0, ma).otherwise(tpl_hdr_size % ma)
    data_rem = F.when(F.ceil(d) % ma == 0, ma).otherwise(F.ceil(d) % ma)
    tpl = F.lit(4) + tpl_hdr_size + d + F.lit(2) * ma - hdr_rem - data_rem
    est = F.ceil(reltuples / ((bs - page_hdr) * fillfactor_ / (tpl * F.lit(100.0))))
    free = tblpages - est
    return (F.when(is_na, F.lit(None).cast("double"))
            .when((free > 0) & (tblpages != 0), F.lit(100.0) * free / tblpages)
            .otherwise(F.lit(0.0)))


def bloat_ratio(factors_with_padding: DataFrame) -> DataFrame:
    """H6 over the output of ``padding_default``: (K, relid, bloat_ratio)."""
    c = F.col
    r = bloat_ratio_expr(c("is_na"), c("padding"), c("tpl_data_size"), c("tpl_hdr_size"), c("ma"),
                         c("tblpages"), c("reltuples"), c("bs"), c("page_hdr"), c("fillfactor"))
    return factors_with_padding.select(*K, "relid", r.alias("bloat_ratio"))


def table_bloat(attrs, classes, nsp, stats, settings, targets) -> DataFrame:
    """F1 targets -> bloat ratio in one pass (the flagship plan).

    The separate operators above join attribute x class x namespace with the
    statistics twice (LEFT for the factors, INNER for the widths) and
    aggregate twice.  Here the LEFT join is done once and a single
    ``groupBy(K, relid)`` computes the factors over the live columns and
    collects the analysed widths for the padding fold, so the catalog is
    shuffled once.  Tables of other kinds than r/m are cut before the join:
    their padding would be discarded by the LEFT join from the factors (C11).
    """
    c = F.col
    tables = _target_tables(classes, nsp, targets, BLOAT_RELKINDS)
    if targets is not None:
        # Cuts attributes and statistics: computed once, and broadcast to both where its written size allows.
        tables = write_once(tables, "bloat_targets")
    base = attrs.join(tables, BY_ID)
    j = base.join(_target_stats(stats, tables, targets), BY_NAME, "left")
    live = ~c("attisdropped")
    matched = c("stat_found").isNotNull()
    nf = F.coalesce(c("null_frac"), F.lit(0.0))
    g = j.groupBy(c("attrelid").alias("relid"), *K).agg(
        F.first("relpages").alias("tblpages"),
        F.first("reltuples").alias("reltuples"),
        F.first(fillfactor(c("reloptions"))).alias("fillfactor"),
        F.count(F.when(live, F.lit(1))).alias("_n_live"),
        F.max(F.when(live, nf)).alias("_max_nf"),
        F.count(F.when(live & matched, F.lit(1))).alias("_n_stats"),
        F.bool_or(live & (c("attname") == "oid") & (c("attnum") < 0)).alias("_has_oid"),
        F.sum(F.when(live, (1 - nf) * F.coalesce(c("avg_width"), F.lit(0)))).alias("_data"),
        F.bool_or(live & (c("atttypname") == "name")).alias("_has_name"),
        F.count(F.when(live & (c("attnum") > 0), F.lit(1))).alias("_n_user"),
        F.array_sort(F.collect_list(F.when(matched, F.struct("attnum", "attalign", "avg_width")))).alias("cols"),
    ).filter(c("_n_live") > 0)
    s = settings.select(*K, c("block_size").cast("double").alias("bs"), max_alignment(c("version")).alias("ma"))
    hdr = (F.lit(TUPLE_HEADER_BASE)
           + F.when(c("_max_nf") > 0, (F.lit(7) + c("_n_stats")) / F.lit(8.0)).otherwise(F.lit(0))
           + F.when(c("_has_oid"), F.lit(4)).otherwise(F.lit(0))).cast("double")
    padding = F.when(F.size("cols") > 0, F.expr(_PADDING_FOLD).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    f = g.join(s, K).select(
        *K, "relid", "tblpages", "reltuples", "bs", F.lit(PAGE_HEADER_SIZE).alias("page_hdr"), "fillfactor",
        (c("_has_name") | (c("_n_user") != c("_n_stats"))).alias("is_na"),
        F.round(c("_data"), 6).alias("tpl_data_size"), hdr.alias("tpl_hdr_size"), "ma", padding.alias("padding"))
    return bloat_ratio(f)


def table_bloat_stepwise(attrs, classes, nsp, stats, settings, targets) -> DataFrame:
    """The same result composed from the separate operators (C12->D5, C5->D6, C11, H6)."""
    factors = bloat_factors(attrs, classes, nsp, stats, settings, targets)
    padding = tuple_padding(column_width_join(attrs, classes, nsp, stats, targets))
    return bloat_ratio(padding_default(factors, padding))
