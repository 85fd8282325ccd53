"""Scalar Column expressions (no Python UDF; everything stays in codegen).

H3 statement keys, H4 unit conversions, H7 ISO timestamps, H9-H11 version
parsing, H12 object prefix, B10 sentinel, B16 fillfactor, B17 alignment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the monitored engines' behaviour.
PS_PER_MS = 1_000_000_000           # MySQL timers are picoseconds
PS_PER_MINUTE = 60_000_000_000_000
SIXTY_FOUR_BIT_PATTERN = "mingw32|64-bit|x86_64|ppc64|ia64|amd64"
DEFAULT_FILLFACTOR = 100
OBSERVATION_TYPES = ("db", "table", "query", "long_running_query", "schema")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H3 -------------------------------------------------------------------------
def pg_statement_key(userid, dbid, queryid) -> Column:
    """PostgreSQL CONCAT(a,'_',b,'_',c): NULL parts become ''."""
    part = lambda x: F.coalesce(_c(x).cast("string"), F.lit(""))
    return F.concat(part(userid), F.lit("_"), part(dbid), F.lit("_"), part(queryid))


def mysql_statement_key(schema, digest) -> Column:
    """MySQL CONCAT(IFNULL(schema,'NULL'),'_',digest): NULL digest gives NULL."""
    return F.concat(F.coalesce(_c(schema), F.lit("NULL")), F.lit("_"), _c(digest))


# H4 -------------------------------------------------------------------------
def ps_to_ms(col) -> Column:
    return _c(col) / F.lit(float(PS_PER_MS))


def minutes_to_ps(minutes: int) -> Column:
    return F.lit(int(minutes) * PS_PER_MINUTE).cast("bigint")


# H7 -------------------------------------------------------------------------
def iso_timestamp(col) -> Column:
    """datetime.isoformat(): 'T' separator, microseconds only when non-zero."""
    ts = _c(col)
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def space_timestamp(col) -> Column:
    """str(datetime): the rendering of table, query and schema documents."""
    ts = _c(col)
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# H9 / H10 / H11 ---------------------------------------------------------------
def mysql_version_text(version) -> Column:
    """Text before the first '-' ('8.0.22-log' -> '8.0.22')."""
    return F.split_part(_c(version), F.lit("-"), F.lit(1))


def pg_version_text(version) -> Column:
    """Text before the first blank ('12 (Ubuntu 12.6)' -> '12')."""
    return F.split_part(_c(version), F.lit(" "), F.lit(1))


def version_major(version_text) -> Column:
    return F.split_part(_c(version_text), F.lit("."), F.lit(1)).try_cast("int")


def version_minor(version_text) -> Column:
    m = F.split_part(_c(version_text), F.lit("."), F.lit(2))
    return F.coalesce(F.nullif(m, F.lit("")).try_cast("int"), F.lit(0))


def version_at_least(version_text, major: int, minor: int = 0) -> Column:
    """Integer comparison of (major, minor): 8.0.22 >= 8.0 is true (fixes float compare)."""
    ma, mi = version_major(version_text), version_minor(version_text)
    return (ma > major) | ((ma == major) & (mi >= minor))


def engine_version_key(engine, version) -> Column:
    """Metric catalog name '<engine>-<version>' from the instance description."""
    eng0 = F.translate(_c(engine), ".-", "__")
    eng = F.when(eng0 == "aurora", F.lit("aurora_mysql")).otherwise(eng0)
    ver = F.translate(_c(version), ".-", "__")
    p1 = F.split_part(ver, F.lit("_"), F.lit(1))
    p12 = F.concat(p1, F.lit("_"), F.split_part(ver, F.lit("_"), F.lit(2)))
    v = (F.when(eng == "aurora_postgresql", p1)
         .when(eng.contains("aurora"), p12)
         .when(eng.contains("postgres") & ver.contains("9_6"), p12)
         .when(eng.contains("postgres"), p1)
         .when(eng.contains("mysql"), p12)
         .otherwise(ver))
    return F.concat(eng, F.lit("-"), v)


# H12 ------------------------------------------------------------------------
def object_prefix(org, db_key, obs_type, ts) -> Column:
    """'<org>/<db>/<TYPE>/<yyyyMMdd>/<HH>/data' in UTC (session time zone)."""
    t = _c(obs_type)
    typ = F.when(F.lower(t).isin(*OBSERVATION_TYPES), F.upper(t)).otherwise(F.lit("UNKNOWN"))
    return F.concat_ws("/", _c(org), _c(db_key), typ, F.date_format(_c(ts), "yyyyMMdd"),
                       F.date_format(_c(ts), "HH"), F.lit("data"))


# B10 / B16 / B17 ----------------------------------------------------------------
def sentinel_to_null(col, sentinel: int = -1) -> Column:
    return F.nullif(_c(col), F.lit(sentinel))


def fillfactor(reloptions) -> Column:
    """fillfactor=N from the blank-joined reloptions, smallint, default 100."""
    txt = F.array_join(_c(reloptions), " ")
    val = F.nullif(F.regexp_extract(txt, r"fillfactor=([0-9]+)", 1), F.lit(""))
    return F.coalesce(val.try_cast("smallint").cast("int"), F.lit(DEFAULT_FILLFACTOR))


def max_alignment(version) -> Column:
    return F.when(_c(version).rlike(SIXTY_FOUR_BIT_PATTERN), F.lit(8)).otherwise(F.lit(4))
