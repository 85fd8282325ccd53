"""Statement statistics: latency per statement (B13, B14) and latency
histogram scaling; the top-n variants (F5, F6) live in ``topn``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expr import (mysql_statement_key, pg_statement_key, pg_version_text, ps_to_ms,
                                      version_at_least)
from fleetlens.keys import K


def statement_latency_pg(statements: DataFrame) -> DataFrame:
    """Queryid 'userid_dbid_queryid', calls, mean time in ms.

    mean_exec_time exists from version 13, mean_time before (B20).
    """
    c = F.col
    new = version_at_least(pg_version_text(c("server_version")), 13)
    return statements.select(
        *K,
        pg_statement_key("userid", "dbid", "queryid").alias("queryid"),
        c("calls"),
        F.when(new, c("mean_exec_time")).otherwise(c("mean_time")).alias("avg_time_ms"),
    )


def statement_latency_mysql(digests: DataFrame) -> DataFrame:
    """Queryid 'schema_digest' (NULL digest -> NULL), calls, avg ms to 6 decimals."""
    c = F.col
    return digests.select(
        *K,
        mysql_statement_key("SCHEMA_NAME", "DIGEST").alias("queryid"),
        c("COUNT_STAR").alias("calls"),
        F.round(ps_to_ms(c("AVG_TIMER_WAIT")), 6).alias("avg_time_ms"),
    )
