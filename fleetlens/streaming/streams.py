"""Structured Streaming forms of the polling jobs.

The reference polls on fixed intervals; here landed snapshots arrive as files
and each job is a streaming query over a file source with a checkpoint:

* I1 ``latest_metric_stream``     sums and counts per period
* I2 ``heartbeat_error_stream``   error counts per (agent, beat); the beat
  spine (all beats, also those without errors) is joined on read
* I3 ``long_running_stream``      the batch operator per micro-batch, and once
  more over what the batches left (top n of the top n)
* I4 ``landing_stream``           file source -> partitioned JSON sink
* I5 ``snapshot_counters_stream`` per-snapshot roll-ups

Files come in any order, so no watermark decides which rows count: each
micro-batch appends partial aggregates to a merge log (``mergelog``: few
folders, replays count once), and readers merge them by key.  Late rows
change the result whenever they come, and no state is kept between batches.

``base`` is the job's folder (``input``, ``ckpt``, ``out``).  A caller who
passes the same one again goes on where the last run stopped; without it each
call takes a fresh folder below ``spark.checkpoint.dir``.

Production triggers follow the reference's intervals (``processingTime``);
tests and the registered queries use ``availableNow`` so a query drains its
input and stops.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.keys import K
from fleetlens.session import checkpoint_dir
from fleetlens.streaming.mergelog import MergeLog

# The reference's job intervals (seconds).
DB_LEVEL_INTERVAL_S = 60
TABLE_LEVEL_INTERVAL_S = 3600
LONG_RUNNING_INTERVAL_S = 120
QUERY_INTERVAL_S = 3600
SCHEMA_INTERVAL_S = 3600
HEARTBEAT_INTERVAL_S = 60


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming job below the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlens/{name}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, mode: str = "append") -> str:
    """Land a snapshot relation as parquet files (the stream's input)."""
    df.write.mode(mode).parquet(path)
    return path


def file_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None] | None, ckpt: str,
        output_mode: str = "update", trigger: dict | None = None, path: str | None = None,
        fmt: str = "parquet", partition_by=None, options: dict | None = None, block: bool = True):
    """Start a query with a checkpoint.

    With the default ``availableNow`` trigger it drains its input and returns;
    with a ``processingTime`` trigger (the polling intervals) pass
    ``block=False`` to get the running ``StreamingQuery`` back.
    """
    w = stream.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode)
    w = w.trigger(**(trigger or {"availableNow": True}))
    if sink is not None:
        w = w.foreachBatch(sink)
        q = w.start()
    else:
        w = w.format(fmt)
        for k, v in (options or {}).items():
            w = w.option(k, v)
        if partition_by:
            w = w.partitionBy(*partition_by)
        q = w.start(path)
    if not block:
        return q
    q.awaitTermination()
    return q


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends every update with its batch id (idempotent per batch)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
    return sink


def merging_sink(log: MergeLog, op: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends what ``op`` makes of a batch to ``log``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        log.append(op(batch), batch_id)
    return sink


def partials(spark: SparkSession, rows: DataFrame, name: str, op: Callable[[DataFrame], DataFrame],
             merge: Callable[[DataFrame], DataFrame], base: str | None, trigger: dict | None,
             max_files: int | None) -> DataFrame:
    """Lands ``rows``, streams them through ``op`` batch by batch and returns the merged partial results."""
    base = base or work_dir(spark, name)
    src = materialize(rows, f"{base}/input")
    log = MergeLog(spark, f"{base}/out", merge)
    run(file_stream(spark, src, rows.schema, max_files), merging_sink(log, op), f"{base}/ckpt", "append", trigger)
    return merge(log.rows() if log.state()[2] else op(rows.limit(0)))


# I5 ----------------------------------------------------------------------------
def snapshot_counters_stream(spark: SparkSession, snapshots: DataFrame, aggs: list, merge: dict[str, str], name: str,
                             spine: DataFrame | None = None, base: str | None = None, trigger: dict | None = None,
                             max_files: int | None = None) -> DataFrame:
    """Per-snapshot aggregates (D1-D3) as snapshot rows arrive.

    ``merge`` names how each aggregate's partial values combine (sum, min or
    max).  Snapshots of the spine without rows come with NULLs, counts with 0.
    """
    out = partials(spark, snapshots, name, lambda b: b.groupBy(*K).agg(*aggs),
                   lambda p: p.groupBy(*K).agg(*[getattr(F, how)(c).alias(c) for c, how in merge.items()]),
                   base, trigger, max_files)
    if spine is None:
        return out
    zero = F.lit(0).cast("bigint")
    return spine.select(*K).join(out, K, "left").select(
        *K, *[F.coalesce(F.col(c), zero).alias(c) if how == "sum" else F.col(c) for c, how in merge.items()])


# I1 ----------------------------------------------------------------------------
def latest_metric_stream(spark: SparkSession, samples: DataFrame, now: str, window_s: int, period_s: int,
                         wanted: DataFrame | None = None, base: str | None = None, trigger: dict | None = None,
                         max_files: int | None = None) -> DataFrame:
    """The newest period average of each wanted metric among the samples in [now - window, now]."""
    from fleetlens.operators.observations import samples_in_window

    def sums(batch: DataFrame) -> DataFrame:
        start = F.window("ts", f"{int(period_s)} seconds").start
        return samples_in_window(batch, wanted, now, window_s).groupBy(
            "db_key", "metric", start.alias("period_start")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))

    def merge(p: DataFrame) -> DataFrame:
        return p.groupBy("db_key", "metric", "period_start").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    per = partials(spark, samples, "latest_metric", sums, merge, base, trigger, max_files).withColumn(
        "avg_value", F.col("s") / F.col("n"))
    return per.groupBy("db_key", "metric").agg(F.max_by("avg_value", "period_start").alias("value"),
                                               F.max("period_start").alias("period_start"))


# I2 ----------------------------------------------------------------------------
def heartbeat_error_stream(spark: SparkSession, errors: DataFrame, activity: DataFrame, interval_s: int,
                           base: str | None = None, trigger: dict | None = None,
                           max_files: int | None = None) -> DataFrame:
    """Raw errors assigned to beats and counted by a stream, joined to the full beat spine."""
    from fleetlens.operators.observations import beat_status, heartbeat_beats, heartbeat_errors

    keys = ["organization_id", "db_key", "heartbeat_time"]

    def counts(batch: DataFrame) -> DataFrame:
        return heartbeat_errors(batch, activity, interval_s).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_errors"))

    per = partials(spark, errors, "heartbeat", counts,
                   lambda p: p.groupBy(*keys).agg(F.sum("n_errors").alias("n_errors")), base, trigger, max_files)
    j = heartbeat_beats(activity, interval_s).join(per, keys, "left")
    n = F.coalesce(F.col("n_errors"), F.lit(0).cast("bigint"))
    return j.select("organization_id", "db_key", "agent_starttime", "heartbeat_time",
                    beat_status(F.col("is_last"), n).alias("agent_status"), n.alias("n_errors"))


# I3 ----------------------------------------------------------------------------
def long_running_stream(spark: SparkSession, activity: DataFrame, op: Callable[[DataFrame], DataFrame],
                        base: str | None = None, trigger: dict | None = None,
                        max_files: int | None = None) -> DataFrame:
    """The long-running filter on every arriving batch of session rows, and its limit over all batches.

    ``trigger={"processingTime": "120 seconds"}`` reproduces the polling interval.
    """
    return partials(spark, activity, "long_running", op, op, base, trigger, max_files)


# I4 ----------------------------------------------------------------------------
def landing_stream(spark: SparkSession, obs: DataFrame, base: str | None = None, trigger: dict | None = None,
                   max_files: int | None = None) -> DataFrame:
    """Documents appended to the landing zone as they arrive (A8 layout).

    The zone is a merge log whose runs are landing folders: a repeated batch
    counts once, and small batches are landed together later.
    """
    from fleetlens.operators.observations import land, read_landing

    base = base or work_dir(spark, "landing")
    src = materialize(obs, f"{base}/input")
    s = file_stream(spark, src, obs.schema, max_files)

    columns = obs.columns
    log = MergeLog(spark, f"{base}/zone", lambda rows: rows.select(*columns),
                   write=lambda df, path: land(df, path, mode="overwrite"), read=lambda paths: read_landing(spark, *paths))
    run(s, merging_sink(log, lambda b: b), f"{base}/ckpt", "append", trigger)
    return log.rows()
