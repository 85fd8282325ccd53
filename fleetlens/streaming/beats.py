"""I2 as a stateful stream: heartbeats that appear as time passes.

The input is a stream of signals (organization_id, db_key, kind, at, salt_key,
arrived_at) in microseconds of the wall clock:

* ``start`` / ``end``  an agent's first and last sign of life
* ``error``            an error that the agent has queued
* ``tick``             no agent: the landing job's clock has reached ``arrived_at``

``arrived_at`` is the landing job's clock, so it never falls behind the
watermark, whatever order the errors' own times come in.  Each agent's state
holds its life, the errors that wait for their beat, and those that came before
its start; an event-time timer posts the beats that are due, also those without
errors, and each error is counted once.  An error whose beat was posted already
(it arrived late) is posted as an addition to that beat.

An agent may hold most of the errors: its state is cut into ``SALTS`` parts by
a hash of the error, each with the agent's life; part 0 posts the beats, all
parts post counts, readers add them up.  A task sees one part's rows as Arrow
batches and counts them by beat in numpy; no row is kept but early ones.

Posted rows are ranges of beats that have passed (first and last), counts of one
beat (first and number of errors) and the number of an agent's final beat, so
an agent that was quiet for a year posts one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.streaming.mergelog import MergeLog
from fleetlens.streaming.streams import file_stream, merging_sink, run, work_dir

SALTS = 8
SIGNALS = "organization_id string, db_key string, kind string, at long, salt_key long, arrived_at long"
POSTED = ("organization_id string, db_key string, agent_start long, first_beat long, last_beat long, n_errors long, "
          "final_beat long")
_AGENT = ["organization_id", "db_key"]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column) -> Column:
    """Microseconds of a wall-clock timestamp, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def wall_clock(us: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=F.floor(us / 86_400_000_000).cast("int"), secs=(F.pmod(us, F.lit(86_400_000_000)) / 1_000_000).cast("decimal(18,6)"))


def signals(errors: DataFrame, activity: DataFrame, arrival: Column) -> DataFrame:
    """Signals of agents' lives and errors; ``arrival``: when an error's row lands, over the columns of ``errors``.

    A life without a first sign is no agent; errors without a time are left to
    the batch form, which has no beat for them either.
    """
    life = activity.filter("first_seen is not null").select(
        *_AGENT, F.explode(F.array(
            F.struct(F.lit("start").alias("kind"), micros(F.col("first_seen")).alias("at")),
            F.struct(F.lit("end").alias("kind"), micros(F.coalesce("last_seen", "first_seen")).alias("at")))).alias("s")
    ).select(*_AGENT, "s.kind", "s.at", F.lit(0).cast("long").alias("salt_key"), F.col("s.at").alias("arrived_at"))
    raised = errors.filter("timestamp is not null").select(
        *_AGENT, F.lit("error").alias("kind"), micros(F.col("timestamp")).alias("at"),
        F.xxhash64("error_id").alias("salt_key"), micros(arrival).alias("arrived_at"))
    return life.union(raised)


def tick(spark: SparkSession, at: int) -> DataFrame:
    return spark.createDataFrame([(None, None, "tick", at, 0, at)], SIGNALS)


class Beats(StatefulProcessor):
    """State and timers of one part of an agent."""

    def __init__(self, interval_s: int):
        self.interval = interval_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "start long, final long, posted long")  # final 0: still alive
        self.waiting = handle.getMapState("waiting", "beat long", "n long")
        self.early = handle.getListState("early", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, final, posted = self.life.get() if self.life.exists() else (None, 0, 0)
        times, end = [], None
        for batch in rows:
            at, kind = batch["at"].to_numpy(), batch["kind"].to_numpy()
            if key[0] is None and (kind == "tick").any():
                return
            if (kind == "start").any():
                start = int(at[kind == "start"].min())
            if (kind == "end").any():
                end = int(at[kind == "end"].max())
            times.append(at[kind == "error"])
        times = np.concatenate(times) if times else np.empty(0, dtype=np.int64)
        if start is None:
            self.early.appendList([(int(t),) for t in times])
            return
        if self.early.exists():
            times = np.concatenate([times, [t for (t,) in self.early.get()]]).astype(np.int64)
            self.early.clear()
        out = []
        if end is not None:
            final = max(1, -((start - end) // self.interval))
            out.append((start, None, None, 0, final))
        # An error at a beat's own time is the next one's.
        beats, counts = np.unique(np.maximum((times - start) // self.interval + 1, 1), return_counts=True)
        for beat, n in zip(beats.tolist(), counts.tolist()):
            if beat <= posted or final and posted >= final:
                out.append((start, beat, None, n, None))
            else:
                self.waiting.updateValue((beat,), ((self.waiting.getValue((beat,))[0] if self.waiting.containsKey((beat,))
                                                    else 0) + n,))
        out += self._post(key, start, final, posted, timerValues)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, final, posted = self.life.get()
        out = self._post(key, start, final, posted, timerValues)
        if out:
            yield self._frame(key, out)

    def _post(self, key, start: int, final: int, posted: int, timers) -> list[tuple]:
        """Posts the beats that the clock has passed and waits for the next one."""
        due = max(posted, (timers.getCurrentWatermarkInMs() * 1000 - start) // self.interval)
        if final:
            due = max(posted, min(due, final))
        out = []
        if due > posted:
            if key[2] == 0:
                out.append((start, posted + 1, due, 0, None))
            passed = [(b, n) for (b,), (n,) in self.waiting.iterator() if b <= due or final and due >= final]
            for beat, n in passed:
                out.append((start, beat, None, n, None))
                self.waiting.removeKey((beat,))
        self.life.update((start, final, due))
        if not final or due < final:
            self.handle.registerTimer(-(-(start + (due + 1) * self.interval) // 1000))
        return out

    @staticmethod
    def _frame(key, out: list[tuple]) -> pd.DataFrame:
        cols = pd.DataFrame(out, columns=["agent_start", "first_beat", "last_beat", "n_errors", "final_beat"], dtype="Int64")
        cols.insert(0, "organization_id", key[0])
        cols.insert(1, "db_key", key[1])
        return cols

    def close(self) -> None:
        pass


def merge_posted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_AGENT, "agent_start", "first_beat", "last_beat", "final_beat").agg(F.sum("n_errors").alias("n_errors"))


def posted_beats(rows: DataFrame, interval_s: int) -> DataFrame:
    """I2's columns of the beats posted so far, from posted rows."""
    from fleetlens.operators.observations import beat_status

    known = merge_posted(rows).join(rows.groupBy(*_AGENT).agg(F.max("final_beat").alias("_final")), _AGENT)
    beat = F.least("first_beat", "_final")  # errors after the end are the last beat's; least() skips nulls
    counts = known.filter("n_errors > 0").groupBy(*_AGENT, beat.alias("beat")).agg(F.sum("n_errors").alias("n"))
    spine = known.filter("last_beat is not null and (_final is null or first_beat <= _final)").select(
        *_AGENT, "agent_start", "_final", F.explode(F.sequence("first_beat", F.least("last_beat", "_final"))).alias("beat"))
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return spine.join(counts, [*_AGENT, "beat"], "left").select(
        *_AGENT, wall_clock(F.col("agent_start")).alias("agent_starttime"),
        wall_clock(F.col("agent_start") + F.col("beat") * interval_s * 1_000_000).alias("heartbeat_time"),
        beat_status(F.coalesce(F.col("beat") == F.col("_final"), F.lit(False)), n).alias("agent_status"), n.alias("n_errors"))


def post_beats(spark: SparkSession, base: str, interval_s: int, trigger: dict | None = None,
               salts: int = SALTS) -> DataFrame:
    """Takes the signals that have landed below ``base``/input and returns the rows posted so far.

    Called again, it goes on where the last run stopped.  State is kept in the
    job's checkpoint folder.
    """
    part = F.when(F.col("kind") == "error", F.array(F.pmod("salt_key", F.lit(salts)))).when(
        F.col("kind") == "tick", F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    stream = (file_stream(spark, f"{base}/input", SIGNALS).withColumn("clock", F.timestamp_micros("arrived_at"))
              .withWatermark("clock", "0 seconds").withColumn("salt", F.explode(part)))
    log = MergeLog(spark, f"{base}/out", merge_posted)
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        beats = stream.groupBy(*_AGENT, "salt").transformWithStateInPandas(Beats(interval_s), POSTED, "Append", "EventTime")
        run(beats, merging_sink(log, lambda b: b), f"{base}/ckpt", "append", trigger)
    finally:
        spark.conf.set(_PROVIDER, old)
    return log.rows() if log.state()[2] else spark.createDataFrame([], POSTED)


def heartbeat_stateful_stream(spark: SparkSession, landed: list[DataFrame], interval_s: int,
                              base: str | None = None) -> DataFrame:
    """Lands the signals in turn, posts beats after each landing, and returns I2's columns of all posted beats."""
    base = base or work_dir(spark, "beats")
    posted = None
    for rows in landed:
        rows.select([f.split()[0] for f in SIGNALS.split(", ")]).write.mode("append").parquet(f"{base}/input")
        posted = post_beats(spark, base, interval_s)
    return posted_beats(posted, interval_s)
