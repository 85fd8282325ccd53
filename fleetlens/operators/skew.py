"""Joins with small-valued keys: a few keys hold most rows of the large side.

``(K, relnamespace)``, ``(K, atttypid)`` or ``(K, relam)`` have two to five
values a snapshot, so a snapshot with a third of the fleet's columns would send
them to that many tasks.  Where the looked-up side is small enough Spark
broadcasts it and nothing is dealt by key.  Beyond that size the heavy keys are
found by a sketch, their rows dealt over several tasks each, and only their
looked-up rows repeated as often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch can name, and what it tracks to find them.
TOP, TRACKED = 1000, 100_000
MAX_SPLITS = 4096


def estimated_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the planner sees it (files read, not rows that remain)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
    for unit, size in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("b", 1)):
        if text.endswith(unit):
            return int(text[:-len(unit)]) * size
    return int(text)


def key_hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in on])


def heavy_keys(df: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """(_kh, _splits): hashes of the keys that hold more than half a task's share, and over how many tasks to deal them.

    At most ``TOP`` rows: a key of more than 1/(2 parts) of all rows is among
    the first 2 parts, and keys beyond the sketch's reach are too small to matter.
    """
    found = df.select(key_hash(on).alias("_kh")).agg(F.expr(f"approx_top_k(_kh, {TOP}, {TRACKED})").alias("t"),
                                                     F.count(F.lit(1)).alias("n"))
    row = found.first()
    share = max(1.0, row.n / (2.0 * parts))
    heavy = [(t["item"], int(min(MAX_SPLITS, -(-t["count"] // share)))) for t in row.t or [] if t["count"] > share]
    return df.sparkSession.createDataFrame(heavy, "_kh long, _splits int")


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """``big.join(small, on, how)`` (left, inner or left_semi) that no key of ``big`` can overload.

    Null keys meet nothing, as in any join; they too are dealt over tasks.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"{how}: the looked-up side's own rows cannot be kept when it is repeated")
    on = list(on)
    if estimated_bytes(small) <= broadcast_limit(small):
        return big.join(small, on, how)
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(big, on, parts)
    # At most TOP rows, so these two joins deal nothing.
    kh = key_hash(on)
    left = big.withColumn("_kh", kh).join(F.broadcast(heavy), "_kh", "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in big.columns]),
                                                      F.col("_splits")), F.lit(0)).cast("int")).drop("_kh", "_splits")
    right = small.withColumn("_kh", kh).join(F.broadcast(heavy), "_kh", "left")
    salts = F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)
    right = right.withColumn("_salt", F.explode(salts)).drop("_kh", "_splits")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
