"""Per-snapshot roll-ups: counter sums (D1-D2), row-count distribution (D3),
extension check (D8), metric period averages (D7) and latency histograms (D9).

All are plain ``groupBy`` aggregations: Spark computes partial aggregates on
the map side, so a snapshot holding a third of all rows still only ships one
partial row per task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.keys import K

# Column lists of the engine's statistics views.
DB_COUNTERS = ["numbackends", "xact_commit", "xact_rollback", "blks_read", "blks_hit", "tup_returned",
               "tup_fetched", "tup_inserted", "tup_updated", "tup_deleted", "conflicts", "temp_files",
               "temp_bytes", "deadlocks", "blk_read_time", "blk_write_time"]
DB_CONFLICTS = ["confl_tablespace", "confl_lock", "confl_snapshot", "confl_bufferpin", "confl_deadlock"]
TABLE_COUNTERS = ["seq_scan", "seq_tup_read", "idx_scan", "idx_tup_fetch", "n_tup_ins", "n_tup_upd",
                  "n_tup_del", "n_tup_hot_upd", "n_live_tup", "n_dead_tup", "n_mod_since_analyze",
                  "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count"]
TABLE_IO_COUNTERS = ["heap_blks_read", "heap_blks_hit", "idx_blks_read", "idx_blks_hit", "toast_blks_read",
                     "toast_blks_hit", "tidx_blks_read", "tidx_blks_hit"]
INDEX_COUNTERS = ["idx_scan", "idx_tup_read", "idx_tup_fetch"]
INDEX_IO_COUNTERS = ["idx_blks_read", "idx_blks_hit"]
ROW_COUNT_BOUNDS = (1e4, 1e5, 1e6, 1e7, 1e8)
ROW_COUNT_COLUMNS = ["num_tables", "num_empty_tables", "num_tables_row_count_0_10k",
                     "num_tables_row_count_10k_100k", "num_tables_row_count_100k_1m",
                     "num_tables_row_count_1m_10m", "num_tables_row_count_10m_100m",
                     "num_tables_row_count_100m_inf", "max_row_num", "min_row_num"]


# How partial values of the row-count columns combine.
ROW_COUNT_MERGE = {c: "sum" for c in ROW_COUNT_COLUMNS[:8]} | {"max_row_num": "max", "min_row_num": "min"}


def _spine_join(spine: DataFrame | None, agg: DataFrame) -> DataFrame:
    if spine is None:
        return agg
    return spine.select(*K).join(agg, K, "left")


def sum_counters(df: DataFrame, cols: Sequence[str], spine: DataFrame | None = None,
                 keys: Sequence[str] = K) -> DataFrame:
    """SUM of each counter per snapshot, as PostgreSQL computes it.

    Integer counters are summed as DECIMAL(38,0) (PostgreSQL's numeric sum of
    bigint, and no ANSI overflow) and returned as double; double columns are
    summed as double.  NULLs are skipped; a view with no rows gives NULLs
    (via the left join from the snapshot spine).
    """
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        if types[c] in ("double", "float"):
            aggs.append(F.sum(F.col(c)).alias(c))
        else:
            aggs.append(F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c))
    return _spine_join(spine, df.groupBy(*keys).agg(*aggs))


def row_count_aggs(bounds: Sequence[float] = ROW_COUNT_BOUNDS, col: str = "n_live_tup") -> list:
    """The ten aggregates of D3 (also used by the streaming form)."""
    n = F.col(col)
    edges = [0.0, *bounds]
    bucket = [F.count_if(n == 0)]
    for lo, hi in zip(edges, edges[1:]):
        bucket.append(F.count_if((n > F.lit(lo)) & (n <= F.lit(hi))))
    bucket.append(F.count_if(n > F.lit(edges[-1])))
    return [F.count(F.lit(1)).alias(ROW_COUNT_COLUMNS[0]),
            *[b.alias(name) for b, name in zip(bucket, ROW_COUNT_COLUMNS[1:8])],
            F.max(n).alias("max_row_num"), F.min(n).alias("min_row_num")]


def row_count_distribution(tables: DataFrame, bounds: Sequence[float] = ROW_COUNT_BOUNDS,
                           spine: DataFrame | None = None, col: str = "n_live_tup") -> DataFrame:
    """D3: number of tables per row-count bucket (upper bounds inclusive).

    NULL or negative counts fall in no bucket but still count in num_tables;
    the buckets of every snapshot therefore add up to at most num_tables.
    """
    agg = tables.groupBy(*K).agg(*row_count_aggs(bounds, col))
    out = _spine_join(spine, agg)
    if spine is None:
        return out
    return out.select(*K, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ROW_COUNT_COLUMNS[:8]],
                      "max_row_num", "min_row_num")


def extension_present(extensions: DataFrame, name: str = "pg_stat_statements",
                      spine: DataFrame | None = None) -> DataFrame:
    """Exactly one row for the extension -> true; a snapshot without extension rows -> false."""
    found = extensions.groupBy(*K).agg((F.count_if(F.col("extname") == name) == 1).alias("extension_present"))
    return _spine_join(spine, found).select(*K, F.coalesce("extension_present", F.lit(False)).alias("extension_present"))


def metric_period_avg(samples: DataFrame, period_s: int = 60, keys: Sequence[str] = ("db_key", "metric"),
                      ts: str = "ts", value: str = "value") -> DataFrame:
    """Average per metric per fixed period (tumbling window, start aligned to epoch)."""
    start = F.window(F.col(ts), f"{int(period_s)} seconds").start
    return samples.groupBy(*keys, start.alias("period_start")) \
        .agg(F.avg(value).alias("avg_value"), F.count(F.lit(1)).alias("samples"))


# The engine's statement histogram has 450 buckets; the first ends at 10 us (in ps) and
# 50 buckets make a power of ten.
HISTOGRAM_BUCKETS, HISTOGRAM_FIRST_PS, HISTOGRAM_PER_DECADE = 450, 1e7, 50


def latency_histogram(samples: DataFrame, first: float = HISTOGRAM_FIRST_PS, keys: Sequence[str] = ("db_key",),
                      value: str = "value", buckets: int = HISTOGRAM_BUCKETS,
                      per_decade: int = HISTOGRAM_PER_DECADE) -> DataFrame:
    """Histogram of durations over the engine's fixed logarithmic buckets, empty ones kept.

    Bucket 0 holds [0, first), bucket i [first * 10^((i-1)/per_decade), ...),
    the last one everything beyond.  Raw rows are counted per (key, bucket)
    before the shuffle, and the running sums run over ``buckets`` rows per key
    whatever the data.  Negative and NULL durations are in no bucket.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    step = F.floor(F.log10(v / F.lit(first)) * per_decade) + 1
    b = F.when(v < first, F.lit(0)).otherwise(F.least(step, F.lit(buckets - 1))).cast("int")
    per = samples.filter(v >= 0).groupBy(*keys, b.alias("bucket_number")).agg(F.count(F.lit(1)).alias("n"))
    every = per.select(*keys).distinct().withColumn("bucket_number", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    full = every.join(per, keys + ["bucket_number"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    edge = lambda i: F.lit(first) * F.pow(F.lit(10.0), i / F.lit(float(per_decade)))
    i = F.col("bucket_number")
    return full.select(
        *keys, "bucket_number",
        F.when(i == 0, F.lit(0.0)).otherwise(edge(i - 1)).alias("bucket_timer_low"),
        F.when(i < buckets - 1, edge(i)).alias("bucket_timer_high"),
        n.alias("count_bucket"),
        F.sum(n).over(w).alias("count_bucket_and_lower"),
        (F.sum(n).over(w) / F.sum(n).over(Window.partitionBy(*keys))).alias("bucket_quantile"),
    )


def histogram_ps_to_ms(hist: DataFrame) -> DataFrame:
    """D9 as served by MySQL: only the timer bounds change unit (ps -> ms)."""
    return hist.withColumn("bucket_timer_low", F.col("bucket_timer_low") / F.lit(1e9)) \
        .withColumn("bucket_timer_high", F.col("bucket_timer_high") / F.lit(1e9))
