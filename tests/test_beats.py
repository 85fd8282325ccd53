"""Stateful heartbeats against the batch form: restarts, disorder, quiet agents, late ends."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.operators import observations as O
from fleetlens.streaming import beats as B

T = dt.datetime(2024, 1, 1, 0, 0, 7, 250)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


def frames(spark):
    """Three agents: errors out of order, before the start, on a beat and after the end; a quiet agent; a short one."""
    errors = [("o", "a", i, "E", "m", "s", at(m), at(a)) for i, (m, a) in enumerate(
        [(0.5, 0.6), (2.2, 7.5), (3, 3.1), (1.9, 3.2), (-3, 0.1), (9.9, 9.95), (30, 30), (5.5, 5.6), (5.6, 5.7)])]
    errors += [("o", "c", 50, "E", "m", "s", at(0.1), at(0.2)), ("o", "none", 51, "E", "m", "s", at(1), at(1))]
    e = spark.createDataFrame(errors, "organization_id string, db_key string, error_id long, name string, message string, "
                              "stacktrace string, timestamp timestamp_ntz, arrival timestamp_ntz")
    activity = spark.createDataFrame([("o", "a", at(0), at(10.5)), ("o", "b", at(1), at(8)), ("o", "c", at(0), at(0))],
                                     "organization_id string, db_key string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    return e, activity


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def rows(df):
    return sorted(tuple(r) for r in df.select("organization_id", "db_key", "agent_starttime", "heartbeat_time",
                                              "agent_status", "n_errors").collect())


def test_like_batch_after_restarts_and_disorder(spark):
    e, activity = frames(spark)
    s = B.signals(e, activity, F.col("arrival"))
    cuts = [us(at(m)) for m in (-100, 4.3, 7.9, 100)]
    slices = [s.filter(F.col("arrived_at").between(lo + 1, hi)).union(B.tick(spark, hi)) for lo, hi in zip(cuts, cuts[1:])]
    base = B.work_dir(spark, "test_beats")
    seen = [rows(B.heartbeat_stateful_stream(spark, [x], 60, base)) for x in slices]
    want = rows(O.agent_heartbeat(e, activity, 60))
    assert seen[-1] == want
    # After 4.3 minutes: the beats that have passed, also without errors; the late error is not known yet.
    assert [r for r in seen[0] if r[1] == "b"] == [r for r in want if r[1] == "b" and r[3] <= at(4.3)]
    first = {r[3]: r[5] for r in seen[0] if r[1] == "a"}
    assert first == {at(1): 2, at(2): 1, at(3): 0, at(4): 1}
    assert {r[3]: r[5] for r in seen[1] if r[1] == "a"}[at(3)] == 1


def test_an_end_that_comes_late_takes_beats_back(spark):
    e, activity = frames(spark)
    s = B.signals(e, activity, F.col("arrival"))
    late = s.filter("kind = 'end'").withColumn("arrived_at", F.lit(us(at(200))))
    got = B.heartbeat_stateful_stream(spark, [s.filter("kind <> 'end'").union(B.tick(spark, us(at(100)))),
                                              late.union(B.tick(spark, us(at(201))))], 60)
    assert rows(got) == rows(O.agent_heartbeat(e, activity, 60))


def test_no_signals(spark):
    assert B.heartbeat_stateful_stream(spark, [spark.createDataFrame([], B.SIGNALS)], 60).count() == 0
