"""Landed snapshot tables: how catalog snapshots are stored and read at scale.

Every relation (one row per catalog row, prefixed by K) is written as parquet
files clustered by hour, organisation and database (``sources.clustered``), so
a job on one organisation, one database or a time range opens only the files
whose manifest entry may hold them, and folders do not multiply with the fleet.
The row groups' min/max statistics serve the remaining filters.  Rows with a
null key or time are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.keys import K
from fleetlens.sources import clustered as C


def _dims() -> dict:
    return {"hour": F.date_trunc("hour", F.col("observation_time")), "org": F.col("organization_id"), "db": F.col("db_key")}


def _keys() -> dict:
    return {"org": F.col("organization_id"), "db": F.col("db_key"), "time": F.col("observation_time")}


def write_snapshot(df: DataFrame, path: str, batch: str | None = None, rows_per_file: int = 5_000_000) -> str:
    """Append a snapshot relation below ``path`` as one batch; the same ``batch`` again replaces it (a replay)."""
    return C.write_clustered(df, path, _dims(), _keys(), batch, rows_per_file)


def compact_snapshots(spark: SparkSession, path: str, rows_per_file: int = 5_000_000) -> str:
    """Rewrites all batches as one, on one curve."""
    return C.compact_clustered(spark, path, _dims(), _keys(), rows_per_file=rows_per_file)


def read_snapshot(spark: SparkSession, path: str, cols: Sequence[str] | None = None,
                  organization_id: str | None = None, db_key: str | None = None,
                  since: str | None = None, until: str | None = None, all_columns: bool = False) -> DataFrame:
    """Read a landed relation; ``since`` and ``until`` are days, both included.

    The manifest leaves out files before any is opened, and the same filters
    then hold row by row.  ``all_columns``: the union of the column sets of all
    batches (servers of several versions), null where one is missing.  Key columns keep their type, so the databases '007'
    and '7' stay apart.
    """
    day = F.to_date("observation_time")
    files, rows = [], []
    if organization_id is not None:
        files.append(C.may_hold("org", organization_id, organization_id))
        rows.append(F.col("organization_id") == organization_id)
    if db_key is not None:
        files.append(C.may_hold("db", db_key, db_key))
        rows.append(F.col("db_key") == db_key)
    if since is not None:
        files.append(F.to_date("max_time") >= F.to_date(F.lit(since)))
        rows.append(day >= F.to_date(F.lit(since)))
    if until is not None:
        files.append(F.to_date("min_time") <= F.to_date(F.lit(until)))
        rows.append(day <= F.to_date(F.lit(until)))
    where = None
    for f in files:
        where = f if where is None else where & f
    df = C.read_clustered(spark, path, where, all_columns)
    for r in rows:
        df = df.filter(r)
    keep = list(K) + [c for c in (cols or df.columns) if c not in K]
    return df.select(*keep)
