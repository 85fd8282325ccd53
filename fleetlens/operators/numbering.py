"""Positions of rows in an order, per key, without gathering a key in one task.

Rows are dealt to tasks by ranges of (key, order) and written; a key of any
size is simply several ranges.  Inside a range a row's place is known when it
is written, so only the number of rows per (key, range) is summed up, and no
window runs over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.shared import write_once

ROW_BITS = 33       # of monotonically_increasing_id: the place inside a partition


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position",
             placed: Sequence[str | Column] = ("*",)) -> DataFrame:
    """Adds ``name``: 1, 2, ... per ``keys`` in ``order`` (nulls in keys are keys; a total order up to equal rows).

    ``placed``: what to keep of a row, the keys among it.  It is computed once, when the row is in place, and not
    for the sample that finds the ranges.
    """
    keys = list(keys)
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    rows = write_once(df.repartitionByRange(*by).sortWithinPartitions(*by)
                      .select(*placed, F.monotonically_increasing_id().alias("_g")), "numbered")
    part = F.shiftright("_g", ROW_BITS)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of a key
    runs = (rows.groupBy(*keys, part.alias("_p")).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .select(F.struct(*keys).alias("_k"), "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
                    .alias("_shift")))
    same = [F.col(k).eqNullSafe(F.col("_k")[k]) for k in keys]
    return (rows.withColumn("_q", part).join(runs, [F.col("_q") == F.col("_p"), *same])
            .withColumn(name, (F.col("_g") + F.col("_shift")).cast("bigint")).drop("_g", "_q", "_p", "_k", "_shift"))
