"""Key/value snapshots: knobs (A3), status counters (A4), engine metrics (A6),
single-row views (A5), derived ratios (H5), parameter lists (B12), replica
status (B21) and the extension check lives in rollups (D8).

Duplicates are resolved with ``max_by(value, ord)`` per (K, name): a partial
aggregate, so no group is ever collected whole.  The long form
``(K, name, value)`` is the relational output; ``pack_map`` turns it into one
map per snapshot only where the consumer wants a document, and the number of
settings of a database engine is bounded by the engine (hundreds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import iso_timestamp
from fleetlens.keys import K

# Status counters read by the derived ratios.
BUFFER_READS = "innodb_buffer_pool_reads"
BUFFER_READ_REQUESTS = "innodb_buffer_pool_read_requests"
READ_COUNTERS = ("com_select",)
WRITE_COUNTERS = ("com_insert", "com_update", "com_delete", "com_replace")


def knob_snapshot(kv: DataFrame, name: str = "name", value: str = "setting", order: str = "ord") -> DataFrame:
    """A3: one setting per (K, name); a repeated name keeps the last row."""
    return kv.groupBy(*K, F.col(name).alias("name")).agg(F.max_by(F.col(value), F.col(order)).alias("setting"))


def status_counters(kv: DataFrame) -> DataFrame:
    """A4: status counters with lower-case names; case-colliding names keep the last."""
    lowered = kv.withColumn("Variable_name", F.lower("Variable_name"))
    return lowered.groupBy(*K, F.col("Variable_name").alias("name")) \
        .agg(F.max_by(F.col("Value"), F.col("ord")).alias("value"))


def transaction_metrics(metrics: DataFrame) -> DataFrame:
    """Engine metrics of subsystem 'transaction' as (K, name, count)."""
    return metrics.filter(F.col("subsystem") == "transaction").select(*K, "name", "count")


def pack_map(long: DataFrame, name: str = "name", value: str = "setting", alias: str = "settings") -> DataFrame:
    """(K, name, value) -> one MAP per K, sorted by name (names must already be unique).

    Timestamps are rendered in ISO form, as in the posted document.
    """
    v = F.col(value)
    if dict(long.dtypes)[value].startswith("timestamp"):
        v = iso_timestamp(v)
    entries = F.array_sort(F.collect_list(F.struct(F.col(name), v)))
    return long.filter(F.col(name).isNotNull()).groupBy(*K).agg(F.map_from_entries(entries).alias(alias))


def single_row_view(df: DataFrame, view: str, spine: DataFrame) -> DataFrame:
    """A5: a global view must have exactly one row per snapshot of the spine.

    Returns (K, view, n_rows, row) for the violations (n_rows != 1): none or
    several; ``row`` is the smallest of several.
    """
    cols = [c for c in df.columns if c not in K]
    g = df.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*cols)).alias("row"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return spine.select(*K).distinct().join(g, K, "left").filter(n != 1).select(
        *K, F.lit(view).alias("view"), n.alias("n_rows"), "row")


def derived_ratios(status_long: DataFrame) -> DataFrame:
    """H5: buffer-pool miss ratio and read/write ratio per snapshot.

    miss = round(reads / requests, 4) * 100 (0.0 without requests);
    read_write = round(r / w, 4) where a zero count counts as 1; a missing
    counter counts as 0.  Values are parsed as integers.
    """
    v = F.col("value").cast("bigint")
    n = F.col("name")

    def total(names):
        return F.coalesce(F.sum(F.when(n.isin(*names), v)), F.lit(0).cast("bigint"))

    g = status_long.groupBy(*K).agg(
        total([BUFFER_READS]).alias("_reads"),
        total([BUFFER_READ_REQUESTS]).alias("_requests"),
        total(READ_COUNTERS).alias("_r"),
        total(WRITE_COUNTERS).alias("_w"),
    )
    r = F.when(F.col("_r") == 0, F.lit(1)).otherwise(F.col("_r"))
    w = F.when(F.col("_w") == 0, F.lit(1)).otherwise(F.col("_w"))
    miss = F.when(F.col("_requests") == 0, F.lit(0.0)) \
        .otherwise(F.round(F.col("_reads") / F.col("_requests"), 4) * 100)
    return g.select(*K, miss.alias("buffer_miss_ratio"), F.round(r / w, 4).alias("read_write_ratio"))


def user_set_parameters(params: DataFrame) -> DataFrame:
    """Parameters set by the user that have a name -> (K, name)."""
    return params.filter((F.col("source") == "user") & F.col("name").isNotNull()).select(*K, "name").distinct()


def replication_status(spine: DataFrame, replica: DataFrame, replica_cols, primary: DataFrame,
                       primary_cols) -> DataFrame:
    """First row of the replica status and of the primary status as JSON text, '' without one."""
    out = spine.select(*K)
    for df, cols, alias in ((replica, replica_cols, "replica_status"), (primary, primary_cols, "master_status")):
        first = df.groupBy(*K).agg(F.to_json(F.min_by(F.struct(*cols), F.struct(*cols))).alias("_row"))
        out = out.join(first, K, "left").withColumn(alias, F.coalesce("_row", F.lit(""))).drop("_row")
    return out
