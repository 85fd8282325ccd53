"""Session activity: long-running statements (B6, B7, F7), vacuum activity
(B5, C8, H1), vacuum progress (B22) and tables being vacuumed (C9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import minutes_to_ps, pg_version_text, version_at_least
from fleetlens.functions.text import scrub_vacuum_query
from fleetlens.keys import K
from fleetlens.operators.topn import target_semi, top_n_per_key

# The columns of the long-running samples and of the vacuum sessions.
PG_LONG_RUNNING_COLUMNS = ["pid", "query_id", "backend_start", "query_start", "datid", "datname", "state",
                           "state_change", "wait_event", "wait_event_type", "backend_type", "xact_start"]
MYSQL_LONG_RUNNING_COLUMNS = ["THREAD_ID", "EVENT_ID", "EVENT_NAME", "TIMER_START", "TIMER_END", "TIMER_WAIT",
                              "LOCK_TIME", "DIGEST", "DIGEST_TEXT", "ROWS_AFFECTED", "ROWS_SENT", "ROWS_EXAMINED",
                              "CREATED_TMP_DISK_TABLES", "CREATED_TMP_TABLES", "SELECT_FULL_JOIN",
                              "SELECT_FULL_RANGE_JOIN", "SELECT_RANGE", "SELECT_RANGE_CHECK", "SELECT_SCAN",
                              "SORT_MERGE_PASSES", "SORT_RANGE", "SORT_ROWS", "SORT_SCAN", "NO_INDEX_USED",
                              "NO_GOOD_INDEX_USED"]
VACUUM_COLUMNS = ["usename", "datid", "datname", "pid", "wait_event_type", "wait_event", "state", "query"]


def exclude_self(activity: DataFrame, own: DataFrame) -> DataFrame:
    """Drop the collector's own backend (pid NOT IN (pg_backend_pid()))."""
    return activity.join(own.select(*K, "pid"), K + ["pid"], "left_anti")


def long_running_pg(activity: DataFrame, n: int = 10000, minutes: int = 2) -> DataFrame:
    """B6 + F7: sessions started more than ``minutes`` before the snapshot.

    No state filter (idle sessions pass).  query_id exists from version 14
    (B20).  The reference's LIMIT has no order; here the oldest sessions come
    first with pid as tie-break, so the result is deterministic.
    """
    c = F.col
    cutoff = c("observation_time") - F.make_dt_interval(mins=F.lit(int(minutes)))
    old = activity.filter(c("query_start") < cutoff)
    if "server_version" in activity.columns:
        old = old.withColumn("query_id", F.when(version_at_least(pg_version_text(c("server_version")), 14),
                                                c("query_id")))
    top = top_n_per_key(old, n, [c("query_start").asc(), c("pid").asc()], salt_by=["pid"])
    return top.select(*K, *PG_LONG_RUNNING_COLUMNS)


def long_running_mysql(statements: DataFrame, n: int = 10000, minutes: int = 2) -> DataFrame:
    """B7 + F7: current statements with a digest running longer than ``minutes``."""
    c = F.col
    old = statements.filter(c("DIGEST").isNotNull() & (c("TIMER_WAIT") > minutes_to_ps(minutes)))
    top = top_n_per_key(old, n, [c("TIMER_WAIT").desc(), c("THREAD_ID").asc()], salt_by=["THREAD_ID"])
    return top.select(*K, *MYSQL_LONG_RUNNING_COLUMNS)


def vacuum_activity(activity: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Sessions whose query mentions 'vacuum ' (any case), own session
    excluded (C8), query text scrubbed (H1)."""
    v = activity.filter(F.col("query").ilike("%vacuum %"))
    if own is not None:
        v = exclude_self(v, own)
    return v.select(*K, *[scrub_vacuum_query(F.col("query")).alias("query") if c == "query" else c
                          for c in VACUUM_COLUMNS])


def raw_view(df: DataFrame, key: str, order: str) -> DataFrame:
    """A view kept raw, one row per (K, key); of duplicates the last by ``order`` (the row's position)."""
    rest = [c for c in df.columns if c not in (*K, key, order)]
    last = df.groupBy(*K, key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return last.select(*K, key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def vacuuming_tables(table_stats: DataFrame, progress: DataFrame) -> DataFrame:
    """Tables that a running vacuum works on."""
    t = target_semi(table_stats, progress.select(*K, "relid"))
    return t.select(*K, "relid", "last_autovacuum", "n_dead_tup", "relname")
