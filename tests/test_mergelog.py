"""The merge log: few folders after many batches, replays, interrupted merges, restarts."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import observations as O
from fleetlens.sources import standins as V
from fleetlens.streaming import streams as S
from fleetlens.streaming.mergelog import KEPT, MergeLog
from sf_paths import SF_SMALL


def _sum(p):
    return p.groupBy("k").agg(F.sum("n").alias("n"))


def _batch(spark, i):
    return spark.createDataFrame([("all", 1), (f"k{i % 5}", i)], "k string, n long").coalesce(1)


def _want(n):
    out = {"all": n}
    for i in range(n):
        out[f"k{i % 5}"] = out.get(f"k{i % 5}", 0) + i
    return out


def _totals(log):
    return {r.k: r.n for r in log.merge(log.rows()).collect()}


def _folders(base):
    return sum(1 for root, dirs, _ in os.walk(base) for d in dirs if d.startswith(("slot=", "turn=")))


def test_folders_stay_few(spark, tmp_path):
    log = MergeLog(spark, str(tmp_path / "log"), _sum, fan=3)
    seen = []
    for i in range(30):
        log.append(_batch(spark, i), i)
        seen.append(_folders(log.base))
    assert _totals(log) == _want(30)
    assert len(log.state()[2]) <= 2 * 4 and max(seen) <= KEPT + 4 * 5
    assert max(seen[15:]) <= max(seen[:15]) + 5     # another level, not another folder a batch


def test_replays_and_a_merge_that_broke_off(spark, tmp_path):
    broken = []

    def merge(p):
        if broken:
            raise RuntimeError("executor lost")
        return _sum(p)

    base = str(tmp_path / "log")
    log = MergeLog(spark, base, merge, fan=3)
    for i in range(2):
        log.append(_batch(spark, i), i)
        log.append(_batch(spark, i), i)              # a replay
    broken.append(1)
    with pytest.raises(RuntimeError):
        log.append(_batch(spark, 2), 2)              # the batch is in, its merge is not
    assert MergeLog(spark, base, _sum).state()[1] == 2 and _totals(MergeLog(spark, base, _sum)) == _want(3)
    again = MergeLog(spark, base, _sum, fan=3)       # restart: the batch is replayed, the merge made again
    again.append(_batch(spark, 2), 2)
    assert _totals(again) == _want(3) and [r.level for r in again.state()[2]] == [1]
    version, _, runs = again.state()
    again._write(_batch(spark, 3), again._slot(0))   # written, but the manifest never came
    assert _totals(again) == _want(3) and again.state() == (version, 2, runs)
    again.append(_batch(spark, 3), 3)
    assert _totals(again) == _want(4)


def test_landing_stream_over_batches_and_a_restart(spark):
    obs, base = V.observation_log(spark, SF_SMALL), S.work_dir(spark, "landing_restart")
    first, second = obs.filter("id % 2 = 0"), obs.filter("id % 2 = 1")
    S.landing_stream(spark, first.repartition(3), base=base, max_files=1)
    back = S.landing_stream(spark, second, base=base)
    names = ["id", "organization_id", "db_key", "obs_type", "observation_time", "payload"]
    assert back.count() == obs.count() and back.select(*names).exceptAll(obs.select(*names)).count() == 0
    assert O.hourly_latest(back).count() == O.hourly_latest(obs).count()
