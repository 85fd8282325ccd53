"""Tables that a job writes once to the shared folder and reads several times."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from fleetlens.session import checkpoint_dir


def write_once(df: DataFrame, name: str, folders: Sequence[str] = ()) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: computed once, whatever reads it.

    Unlike a cache it survives a lost executor, and its size is known to the
    planner, so a small table is broadcast by its readers and a large one not.
    ``folders``: columns whose values are folders, so that a filter on them counts in that size.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/fleetlens/shared/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
