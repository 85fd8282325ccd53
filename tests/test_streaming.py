"""Streaming forms over several micro-batches equal their batch forms."""

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from fleetlens.operators import activity as A
from fleetlens.operators import observations as O
from fleetlens.operators import rollups as R
from fleetlens.session import checkpoint_dir
from fleetlens.sources import standins as V
from fleetlens.streaming import streams as S


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _rounded(df):
    return df.withColumn("value", F.round("value", 9))


def test_snapshot_counters_stream_many_batches(spark):
    ts = V.pg_stat_user_tables(spark, SF_SMALL).repartition(6)
    bounds = (25, 30, 35, 40, 45)
    stream = S.snapshot_counters_stream(spark, ts, R.row_count_aggs(bounds), R.ROW_COUNT_MERGE, "test_counters",
                                        max_files=1)
    batch = R.row_count_distribution(V.pg_stat_user_tables(spark, SF_SMALL), bounds)
    assert _same(stream.select(*batch.columns), batch)


def test_latest_metric_stream_many_batches(spark):
    """Unordered files, samples after now and before the window, a cut first period."""
    samples = V.metric_samples(spark, SF_SMALL)
    now = "2024-01-15 10:20:30"
    stream = S.latest_metric_stream(spark, samples.repartition(5, "metric"), now, 86400, 3600, max_files=1)
    batch = O.latest_metric(samples, None, now, 86400, 3600)
    assert batch.count() > 0 and _same(_rounded(stream.select(*batch.columns)), _rounded(batch))


def test_streams_go_on_where_they_stopped(spark):
    """A second run with the same folder reads only what is new and merges it."""
    samples = V.metric_samples(spark, SF_SMALL)
    now, base = "2024-01-15 10:20:30", S.work_dir(spark, "restart")
    S.latest_metric_stream(spark, samples.filter("ts > '2024-01-15 00:00:00'"), now, 86400, 3600, base=base)
    stream = S.latest_metric_stream(spark, samples.filter("ts <= '2024-01-15 00:00:00'"), now, 86400, 3600, base=base)
    batch = O.latest_metric(samples, None, now, 86400, 3600)
    assert _same(_rounded(stream.select(*batch.columns)), _rounded(batch))


def test_long_running_limit_holds_over_batches(spark):
    act = V.pg_stat_activity(spark, SF_SMALL)
    op = lambda b: A.long_running_pg(b, 2, 0)
    stream = S.long_running_stream(spark, act.repartition(3), op, max_files=1)
    assert _same(stream, op(act))


def test_streams_write_below_checkpoint_dir(spark):
    base = S.work_dir(spark, "probe")
    assert base.startswith(checkpoint_dir(spark).rstrip("/"))


def test_stream_windows_do_not_depend_on_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        now = "2024-01-31 00:00:00"
        stream = S.latest_metric_stream(spark, V.metric_samples(spark, SF_SMALL), now, 86400, 3600)
        batch = O.latest_metric(V.metric_samples(spark, SF_SMALL), None, now, 86400, 3600)
        assert _same(_rounded(stream.select(*batch.columns)), _rounded(batch))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
