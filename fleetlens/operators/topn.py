"""Top-n per snapshot (F1-F7) and the target-set semi-joins.

Every ``LIMIT n`` of a single-database collector becomes "first n per K".
``top_n_per_key`` is skew-safe: a hot snapshot is first cut per (K, salt)
sub-group (each holds about 1/salts of the key's rows and Spark applies a
partial ``WindowGroupLimit`` before the shuffle), so the final per-K window
never sees more than ``n * salts`` rows.  The order always ends with a unique
tie-break so the result is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.keys import K

DEFAULT_SALTS = 16
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def ensure_group_limit(spark, n: int) -> None:
    """Make Spark insert the per-partition ``WindowGroupLimit`` for a limit of ``n``.

    The optimizer only adds it when n <= the threshold (1,000 by default); the
    agent's limits go up to 10,000 (indexes, statements).  Without it a hot
    snapshot's rows would be sorted whole before the filter.
    """
    cur = int(spark.conf.get(GROUP_LIMIT_CONF, "1000"))
    if n > cur:
        spark.conf.set(GROUP_LIMIT_CONF, str(n))


def top_n_per_key(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str] = K,
                  salt_by: Sequence[str] | None = None, salts: int = DEFAULT_SALTS,
                  rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..n per ``keys`` by ``order`` (which must be a total order).

    ``salt_by`` names the unique columns used to spread a key over ``salts``
    sub-groups; without it the single-stage window is used.
    """
    keys = list(keys)
    ensure_group_limit(df.sparkSession, n)
    out = df
    if salt_by and salts > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts))
        w1 = Window.partitionBy(*keys, salt).orderBy(*order)
        out = out.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n).drop("_rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def target_semi(df: DataFrame, targets: DataFrame, on: Sequence[str] | None = None,
                left_on: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose (K, id...) is in ``targets``; no targets keeps nothing.

    The target set is small per snapshot but grows with the fleet, so no
    broadcast is forced: AQE broadcasts it when the runtime size allows.
    """
    on = list(on or K + ["relid"])
    left_on = list(left_on or on)
    t = targets.select(*[F.col(r).alias(f"_t{i}") for i, r in enumerate(on)])
    cond = [F.col(l) == F.col(f"_t{i}") for i, l in enumerate(left_on)]
    return df.join(t, cond, "left_semi")


# F1 ---------------------------------------------------------------------------
def top_tables(table_stats: DataFrame, n: int = 1000, count_missing_as_zero: bool = False) -> DataFrame:
    """Largest / busiest tables per snapshot -> (K, relid, rank).

    ``n_live_tup + seq_scan + idx_scan > 0`` drops tables whose idx_scan is
    NULL (no index) unless ``count_missing_as_zero`` is set (quirk Q8).
    """
    c = F.col
    idx = F.coalesce(c("idx_scan"), F.lit(0)) if count_missing_as_zero else c("idx_scan")
    live = table_stats.filter(c("n_live_tup") + c("seq_scan") + idx > 0)
    ranked = top_n_per_key(
        live, n, [c("n_live_tup").desc(), (c("seq_scan") + idx).desc(), c("relid").asc()],
        salt_by=["relid"], rank_col="rank")
    return ranked.select(*K, "relid", "rank")


# F2 ---------------------------------------------------------------------------
def top_indexes(index_stats: DataFrame, targets: DataFrame, n: int = 10000) -> DataFrame:
    """Indexes of the target tables by size (NULLs first, as PostgreSQL) -> (K, indexrelid, index_size)."""
    c = F.col
    cand = target_semi(index_stats, targets)
    ranked = top_n_per_key(cand, n, [c("index_size").desc_nulls_first(), c("indexrelid").asc()],
                           salt_by=["indexrelid"], rank_col="rank")
    return ranked.select(*K, "indexrelid", "index_size", "rank")


# F3 ---------------------------------------------------------------------------
# The engine's own schemas and the columns of the table statistics.
MYSQL_SYSTEM_SCHEMAS = ("information_schema", "performance_schema", "mysql", "sys")
MYSQL_TABLE_COLUMNS = ["TABLE_SCHEMA", "TABLE_NAME", "TABLE_TYPE", "ENGINE", "ROW_FORMAT", "TABLE_ROWS",
                       "AVG_ROW_LENGTH", "DATA_LENGTH", "INDEX_LENGTH", "DATA_FREE"]


def user_schemas_mysql(df: DataFrame, col: str = "TABLE_SCHEMA") -> DataFrame:
    """B2: drop the four system schemas (MySQL compares them case-insensitively)."""
    return df.filter(~F.lower(F.col(col)).isin(*MYSQL_SYSTEM_SCHEMAS))


def top_tables_mysql(tables: DataFrame, n: int = 1000) -> DataFrame:
    c = F.col
    live = user_schemas_mysql(tables).filter(c("TABLE_ROWS") > 0)   # B2, B11
    ranked = top_n_per_key(live, n, [c("TABLE_ROWS").desc(), c("TABLE_SCHEMA"), c("TABLE_NAME")],
                           salt_by=["TABLE_SCHEMA", "TABLE_NAME"], rank_col="rank")
    return ranked.select(*K, *MYSQL_TABLE_COLUMNS, "rank")


# F4 / B9 ------------------------------------------------------------------------
def index_size_bytes(index_stats: DataFrame, page_size: int = 16384) -> DataFrame:
    """B9: 'size' statistics in bytes."""
    return index_stats.filter(F.col("stat_name") == "size").select(
        *K, "DATABASE_NAME", "TABLE_NAME", "INDEX_NAME", F.col("stat_value").alias("STAT_VALUE"),
        (F.col("stat_value") * F.lit(page_size)).alias("SIZE_IN_BYTE"))


def top_indexes_mysql(index_stats: DataFrame, target_tables: DataFrame, n: int = 10000,
                      page_size: int = 16384) -> DataFrame:
    c = F.col
    sized = index_size_bytes(index_stats, page_size)
    cand = target_semi(sized, target_tables, on=K + ["TABLE_SCHEMA", "TABLE_NAME"],
                       left_on=K + ["DATABASE_NAME", "TABLE_NAME"])
    ranked = top_n_per_key(cand, n, [c("SIZE_IN_BYTE").desc(), c("DATABASE_NAME"), c("TABLE_NAME"),
                                     c("INDEX_NAME")],
                           salt_by=["DATABASE_NAME", "TABLE_NAME", "INDEX_NAME"], rank_col="rank")
    return ranked


# F5 / F6 ------------------------------------------------------------------------
def top_statements_pg(statements: DataFrame, n: int = 10000) -> DataFrame:
    c = F.col
    return top_n_per_key(statements, n, [c("calls").desc(), c("userid"), c("dbid"), c("query"),
                                         c("queryid").asc_nulls_first()],
                         salt_by=["userid", "dbid", "query", "queryid"], rank_col="rank")


def top_statements_mysql(digests: DataFrame, n: int = 10000) -> DataFrame:
    c = F.col
    return top_n_per_key(digests, n, [c("COUNT_STAR").desc(), c("DIGEST").asc_nulls_first(),
                                      c("FIRST_SEEN"), c("DIGEST_TEXT")],
                         salt_by=["DIGEST", "FIRST_SEEN", "DIGEST_TEXT"], rank_col="rank")
