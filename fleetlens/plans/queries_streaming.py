"""Registered queries for the streaming forms.

Each runs a Structured Streaming query with ``trigger(availableNow=True)``
over files landed from the stand-ins, then returns the sink's result; the
oracles are those of the batch forms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import activity as A
from fleetlens.operators import rollups as R
from fleetlens.plans import queries as Q
from fleetlens.plans import queries_observations as QO
from fleetlens.plans.queries import query
from fleetlens.sources import standins as V
from fleetlens.streaming import beats as B
from fleetlens.streaming import streams as S


BATCHES = 4      # input files, one per micro-batch
LANDINGS = 3     # of the stateful heartbeat, one run each


@query("snapshot_counters_stream")
def q_snapshot_counters_stream(spark, d):
    return S.snapshot_counters_stream(spark, V.pg_stat_user_tables(spark, d).repartition(BATCHES),
                                      R.row_count_aggs(Q.ROW_BOUNDS), R.ROW_COUNT_MERGE, "snapshot_counters",
                                      spine=V.pg_snapshot_spine(spark, d), max_files=1)


@query("latest_metric_stream")
def q_latest_metric_stream(spark, d):
    return S.latest_metric_stream(spark, V.metric_samples(spark, d).repartition(BATCHES), QO.METRIC_NOW,
                                  QO.METRIC_WINDOW_S, QO.METRIC_PERIOD_S, QO.wanted_metrics(spark, d), max_files=1)


@query("heartbeat_stream")
def q_heartbeat_stream(spark, d):
    return S.heartbeat_error_stream(spark, V.agent_errors(spark, d).repartition(BATCHES), V.agent_activity(spark, d),
                                    QO.HEARTBEAT_INTERVAL_S, max_files=1)


@query("heartbeat_stateful_stream")
def q_heartbeat_stateful_stream(spark, d):
    """Errors land up to two intervals late, out of order; the last landing's clock is past all beats."""
    activity, iv = V.agent_activity(spark, d), QO.HEARTBEAT_INTERVAL_S
    delay = F.make_dt_interval(secs=F.pmod(F.xxhash64("error_id"), F.lit(2 * iv)).cast("decimal(18,6)"))
    rows = B.signals(V.agent_errors(spark, d), activity, F.col("timestamp") + delay)
    first, last = activity.agg(F.min(B.micros(F.col("first_seen"))), F.max(B.micros(F.col("last_seen")))).first()
    if first is None:
        return B.heartbeat_stateful_stream(spark, [rows], iv)
    end = last + 3 * iv * 1_000_000
    cuts = [first - 1] + [first + (last - first) * i // LANDINGS for i in range(1, LANDINGS)] + [end]
    return B.heartbeat_stateful_stream(spark, [
        rows.filter(F.col("arrived_at").between(lo + 1, hi)).union(B.tick(spark, hi))
        for lo, hi in zip(cuts, cuts[1:])], iv)


@query("long_running_stream")
def q_long_running_stream(spark, d):
    return S.long_running_stream(spark, V.pg_stat_activity(spark, d).repartition(BATCHES),
                                 lambda b: A.long_running_pg(b, Q.N_LONG_RUNNING, Q.LR_MINUTES_PG), max_files=1)


@query("landing_stream")
def q_landing_stream(spark, d):
    return S.landing_stream(spark, V.observation_log(spark, d).repartition(BATCHES), max_files=1).select(
        "organization_id", "db_key", "type_dir", "dt", "hr", "obs_type", "observation_time", "payload", "id")
