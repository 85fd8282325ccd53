"""The two closed registries of the reference as plain dictionaries.

J1: row post-processing by view name (``df.transform``).
J2: metric sources by name (``(spark, sf_dir, **conf) -> DataFrame``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import scrub_vacuum_query


def _scrub_activity(df: DataFrame) -> DataFrame:
    return df.withColumn("query", scrub_vacuum_query(F.col("query")))


ROW_POSTPROCESS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "pg_stat_activity": _scrub_activity,
}


def _cloud_metrics(spark: SparkSession, sf_dir: str, now: str, window_s: int = 600,
                   period_s: int = 60) -> DataFrame:
    from fleetlens.operators.observations import latest_metric
    from fleetlens.sources.standins import metric_samples

    return latest_metric(metric_samples(spark, sf_dir), None, now, window_s, period_s)


METRIC_SOURCES: dict[str, Callable[..., DataFrame]] = {
    "cloudwatch": _cloud_metrics,
}
