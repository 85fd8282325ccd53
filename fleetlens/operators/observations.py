"""Documents: envelope (A1, A2), metric catalog (A7, C15), landing (A8-A10,
H12), metric-source merge (C13), assembly (C14), logical-database union (G1),
latest metric value (I1, batch form) and agent heartbeat (I2, batch form).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.expr import OBSERVATION_TYPES, engine_version_key, iso_timestamp, object_prefix
from fleetlens.keys import K
from fleetlens.operators.numbering import numbered
from fleetlens.operators.rollups import metric_period_avg
from fleetlens.sources.clustered import clustered, curve, spread
from fleetlens.sources.envelopes import Item, order_column, pack
from fleetlens.sources.shared import write_once

ENVELOPE_SCHEMA = "columns array<string>, rows array<array<string>>"
DEFAULT_PAGE_ROWS = 10000


# A1 ---------------------------------------------------------------------------
def envelope_explode(docs: DataFrame, item: str | None, schema: str | T.StructType,
                     payload: str = "payload") -> DataFrame:
    """``{"columns": [...], "rows": [[...]]}`` text -> typed rows.

    Values are addressed by column *name* (the order of ``columns`` may differ
    between documents) and converted with ``try_cast``.
    """
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    d = docs if item is None else docs.filter(F.col("item") == item)
    keep = [c for c in d.columns if c != payload]
    env = d.select(*keep, F.from_json(F.col(payload), ENVELOPE_SCHEMA).alias("_e"))
    rows = env.select(*keep, F.col("_e.columns").alias("_c"), F.posexplode("_e.rows").alias("row_pos", "_r"))
    m = F.map_from_arrays(F.col("_c"), F.col("_r"))
    return rows.select(*keep, "row_pos", *[m[f.name].try_cast(f.dataType).alias(f.name) for f in st.fields])


# A2 ---------------------------------------------------------------------------
def with_pages(df: DataFrame, order: Sequence[str], page_rows: int = DEFAULT_PAGE_ROWS,
               keys: Sequence[str] = K) -> DataFrame:
    """Add ``page``: rows of a group in ``order``, ``page_rows`` to a page.

    Pages are ranges of the order, so one after the other they are the whole
    list.  The numbering deals a group over many tasks (``numbering.numbered``).
    """
    rows = numbered(df, keys, [order_column(o).asc_nulls_first() for o in order], "_position")
    return rows.withColumn("page", F.floor((F.col("_position") - 1) / F.lit(page_rows)).cast("bigint")).drop("_position")


def envelope_pack(df: DataFrame, item: str, cols: Sequence[str], order: Sequence[str],
                  page_rows: int = DEFAULT_PAGE_ROWS) -> DataFrame:
    """Rows -> ``{columns, rows}`` JSON per (K, item, page), values as text, rows sorted by ``order``.

    A snapshot with more than ``page_rows`` rows is split into pages of that
    many, ranges of the order, so no collected group holds more.
    """
    return pack([Item(item, df, order, cols)], K, page_rows, typed=False)


def records_json(df: DataFrame, cols: Sequence, order: Sequence[str], alias: str,
                 page_rows: int = DEFAULT_PAGE_ROWS, keys: Sequence[str] = K) -> DataFrame:
    """H8: records as JSON array text per (keys, page), NULL fields omitted, sorted by ``order``."""
    c = F.col
    keys = list(keys)
    paged = with_pages(df, order, page_rows, keys).select(
        *keys, "page", F.struct(*[order_column(o).alias(f"_o{i}") for i, o in enumerate(order)],
                                F.struct(*cols).alias("_r")).alias("_e"))
    g = paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list("_e")).alias("_l"),
                                         F.count(F.lit(1)).alias("n_rows"))
    return g.select(*keys, "page", "n_rows", F.to_json(F.transform("_l", lambda e: e["_r"])).alias(alias))


# A7 / C15 -----------------------------------------------------------------------
# Fixed value: the name format of the catalog files.
CATALOG_FILE_PATTERN = r"cloudwatch_metrics(_cluster)?/rds_([a-z_]+)-([0-9_]+)\.json$"


def read_metric_catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw catalog entries (name, Metric, file) from the per engine/version JSON arrays.

    Only ``name`` and ``Metric`` are declared: Spark column names are case
    insensitive, so ``description`` and ``Description`` cannot both be read.
    """
    raw = (spark.read.option("multiLine", True).schema("name string, Metric string")
           .json(path).withColumn("file", F.input_file_name()))
    return raw


def normalize_catalog(raw: DataFrame) -> DataFrame:
    """(engine_key, level, metric), one row per distinct metric (quirks Q1, Q2)."""
    f = F.col("file")
    return raw.select(
        F.concat(F.regexp_extract(f, CATALOG_FILE_PATTERN, 2), F.lit("-"),
                 F.regexp_extract(f, CATALOG_FILE_PATTERN, 3)).alias("engine_key"),
        F.when(F.regexp_extract(f, CATALOG_FILE_PATTERN, 1) == "", F.lit("instance"))
         .otherwise(F.lit("cluster")).alias("level"),
        F.coalesce(F.col("name"), F.col("Metric")).alias("metric"),
    ).filter(F.col("metric").isNotNull()).dropDuplicates()


def metric_catalog(spark: SparkSession, path: str) -> DataFrame:
    return normalize_catalog(read_metric_catalog_files(spark, path))


def catalog_lookup(instances: DataFrame, catalog: DataFrame) -> DataFrame:
    """Wanted metrics per instance; cluster metrics only with a cluster id.

    ``instances``: (db_key, engine, version, cluster_id).
    """
    inst = instances.withColumn("engine_key", engine_version_key(F.col("engine"), F.col("version")))
    cat = catalog.withColumnRenamed("engine_key", "_ck")
    # The key is a long CASE expression; a plain equality would let the optimizer infer
    # IS NOT NULL(key) and copy the whole expression below the aggregation into the scan.
    # The null-safe comparison (the key is never NULL) keeps it computed once per instance.
    j = inst.join(cat, inst["engine_key"].eqNullSafe(cat["_ck"])).drop("_ck")
    return j.filter((F.col("level") == "instance") | (F.coalesce(F.col("cluster_id"), F.lit("")) != "")) \
        .select("db_key", "engine_key", "level", "metric").distinct()


# I1 (batch) ---------------------------------------------------------------------
def samples_in_window(samples: DataFrame, wanted: DataFrame | None, now: str, window_s: int) -> DataFrame:
    """Samples in [now - window, now] of the wanted metrics."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    lo = now_ts - F.make_dt_interval(secs=F.lit(window_s))
    s = samples.filter((F.col("ts") >= lo) & (F.col("ts") <= now_ts))
    if wanted is not None:
        s = s.join(wanted.select("db_key", "metric"), ["db_key", "metric"], "left_semi")
    return s


def latest_metric(samples: DataFrame, wanted: DataFrame | None, now: str, window_s: int = 600,
                  period_s: int = 60) -> DataFrame:
    """Newest period average of each wanted metric in [now - window, now].

    Metrics without a point in the window are absent.  ``max_by`` is a partial
    aggregate, so a metric with many periods is never collected whole.
    """
    avg = metric_period_avg(samples_in_window(samples, wanted, now, window_s), period_s)
    return avg.groupBy("db_key", "metric").agg(F.max_by("avg_value", "period_start").alias("value"),
                                               F.max("period_start").alias("period_start"))


# I2 (batch) ---------------------------------------------------------------------
def _hour_ntz(ts: Column) -> Column:
    """Hour of a wall-clock timestamp (independent of the session time zone); null without one."""
    return ts - F.make_dt_interval(mins=F.minute(ts), secs=F.date_part(F.lit("SECOND"), ts))


def _micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def _beat_count(first: Column, last: Column, interval_s: int) -> Column:
    n = F.ceil(_micros_between(first, last) / F.lit(interval_s * 1_000_000)).cast("bigint")
    return F.greatest(n, F.lit(1).cast("bigint"))


def heartbeat_beats(activity: DataFrame, interval_s: int = 60) -> DataFrame:
    """Beat times per agent: start + k * interval for k = 1..N, the last is final.

    ``activity``: (organization_id, db_key, first_seen, last_seen); an agent
    starts when it is first seen.  The spine of one agent is its lifetime
    divided by the interval (not data sized).
    """
    iv = F.make_dt_interval(secs=F.lit(interval_s))
    base = activity.select("organization_id", "db_key", F.col("first_seen").alias("agent_starttime"),
                           _beat_count(F.col("first_seen"), F.col("last_seen"), interval_s).alias("_n"))
    beats = base.select("organization_id", "db_key", "agent_starttime", "_n",
                        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("beat"))
    return beats.select("organization_id", "db_key", "agent_starttime", "beat",
                        (F.col("agent_starttime") + iv * F.col("beat")).alias("heartbeat_time"),
                        (F.col("beat") == F.col("_n")).alias("is_last"))


def heartbeat_errors(errors: DataFrame, activity: DataFrame, interval_s: int = 60) -> DataFrame:
    """Each error assigned to the beat that reports it (once, in arrival order by timestamp, id).

    The first beat after the error reports it.  The last beat also takes what
    arrives with it or later, and the first what came before the start, so no
    error is lost.
    """
    start = activity.select("organization_id", "db_key", F.col("first_seen").alias("_start"),
                            _beat_count(F.col("first_seen"), F.col("last_seen"), interval_s).alias("_n"))
    e = errors.join(start, ["organization_id", "db_key"])
    passed = F.floor(_micros_between(F.col("_start"), F.col("timestamp")) / F.lit(interval_s * 1_000_000))
    beat = F.greatest(F.least(passed.cast("bigint") + 1, F.col("_n")), F.lit(1).cast("bigint"))
    iv = F.make_dt_interval(secs=F.lit(interval_s))
    return e.select("organization_id", "db_key", (F.col("_start") + iv * beat).alias("heartbeat_time"),
                    "error_id", "name", "message", "stacktrace", "timestamp")


def beat_status(is_last: Column, n: Column) -> Column:
    return (F.when(is_last & (n > 0), F.lit("terminating_error")).when(is_last, F.lit("terminating_ok"))
            .when(n > 0, F.lit("error")).otherwise(F.lit("ok")))


def agent_heartbeat(errors: DataFrame, activity: DataFrame, interval_s: int = 60) -> DataFrame:
    """Status per beat: ok / error, terminating_ok / terminating_error on the last."""
    beats = heartbeat_beats(activity, interval_s)
    per = heartbeat_errors(errors, activity, interval_s).groupBy("organization_id", "db_key", "heartbeat_time") \
        .agg(F.count(F.lit(1)).alias("n_errors"))
    j = beats.join(per, ["organization_id", "db_key", "heartbeat_time"], "left")
    n = F.coalesce(F.col("n_errors"), F.lit(0).cast("bigint"))
    return j.select("organization_id", "db_key", "agent_starttime", "heartbeat_time",
                    beat_status(F.col("is_last"), n).alias("agent_status"), n.alias("n_errors"))


def heartbeat_document(errors: DataFrame, activity: DataFrame, agent_version: str, interval_s: int = 60,
                       page_rows: int = DEFAULT_PAGE_ROWS) -> DataFrame:
    """I2 as the posted document: one JSON text per beat and error page (page 0 where there are no errors).

    Fields: organization_id, db_key, agent_status, agent_starttime,
    heartbeat_time (ISO), agent_version and the errors with data and timestamp.
    """
    keys = ["organization_id", "db_key", "heartbeat_time"]
    err = heartbeat_errors(errors, activity, interval_s)
    counted = agent_heartbeat(errors, activity, interval_s)
    rec = F.struct(F.struct("name", "message", "stacktrace").alias("data"),
                   iso_timestamp(F.col("timestamp")).alias("timestamp"))
    paged = with_pages(err, ["timestamp", "error_id"], page_rows, keys).select(
        *keys, "page", F.struct(F.col("timestamp").alias("_t"), "error_id", rec.alias("_r")).alias("_e"))
    lists = paged.groupBy(*keys, "page").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda x: x["_r"])
                                             .alias("errors"))
    j = counted.join(lists, keys, "left")
    empty = F.array().cast(lists.schema["errors"].dataType)
    doc = F.struct("organization_id", "db_key", "agent_status", iso_timestamp(F.col("agent_starttime")).alias(
        "agent_starttime"), iso_timestamp(F.col("heartbeat_time")).alias("heartbeat_time"),
        F.lit(agent_version).alias("agent_version"), F.coalesce("errors", empty).alias("errors"))
    return j.select(*keys, F.coalesce(F.col("page"), F.lit(0)).cast("bigint").alias("page"),
                    F.to_json(doc).alias("document"))


def pack_errors(errors_long: DataFrame, page_rows: int = DEFAULT_PAGE_ROWS) -> DataFrame:
    """The error list of each beat as the document's JSON array (time, id order).

    Errors of one interval of one agent are paged like every other list, so a
    burst of errors never becomes one unbounded group.
    """
    rec = [F.struct("name", "message", "stacktrace").alias("data"), F.col("timestamp")]
    return records_json(errors_long, rec, ["timestamp", "error_id"], "errors", page_rows,
                        keys=["organization_id", "db_key", "heartbeat_time"])


# A8 - A10 -----------------------------------------------------------------------
def landing_type(t: Column) -> Column:
    return F.when(F.lower(t).isin(*OBSERVATION_TYPES), F.upper(t)).otherwise(F.lit("UNKNOWN"))


def landing_columns(obs: DataFrame, ts: str = "observation_time") -> DataFrame:
    """A8 layout: partition columns of org/db/TYPE/yyyyMMdd/HH (UTC)."""
    t = F.col("obs_type")
    return obs.select("*", landing_type(t).alias("type_dir"), F.date_format(ts, "yyyyMMdd").alias("dt"),
                      F.date_format(ts, "HH").alias("hr"),
                      object_prefix(F.col("organization_id"), F.col("db_key"), t, F.col(ts)).alias("object_key"))


LANDING_PARTITIONS = ["type_dir", "dt"]      # the hour stays a column, see landing_layout
# Document types that the object store holds compressed.
COMPRESSED_TYPES = ("QUERY", "LONG_RUNNING_QUERY", "SCHEMA")


def _landing_dims() -> dict[str, Column]:
    return {"hour": F.col("hr"), "org": F.col("organization_id"), "db": F.col("db_key")}


def landing_layout(rows: DataFrame, z: DataFrame | None = None) -> DataFrame:
    """``rows`` of ``landing_columns`` for type/day folders, inside a folder along the curve of hour, organisation and database.

    Folders multiply neither with the fleet nor with the hours; a document keeps its object name
    in ``object_key``.  Ranges end with a row hash, so a hot folder, hour or database is written by
    many tasks; a document without a key or a time is kept, in the folder for none.
    """
    return clustered(rows, _landing_dims(), before=tuple(LANDING_PARTITIONS), z=z)


def land(obs: DataFrame, path: str, compression: str = "gzip", mode: str = "append", rows_per_file: int = 1_000_000) -> None:
    """A8 + A9: append every document as JSON; query, long-running and schema documents compressed, others plain.

    All documents are kept (the reference overwrote all but the last one of an
    hour, quirk Q4; ``hourly_latest`` reproduces that on read).
    """
    packed = F.coalesce(F.col("type_dir").isin(*COMPRESSED_TYPES), F.lit(False))
    rows = spread(obs, "landing", landing_columns)
    z = curve(rows, _landing_dims())
    for part, codec, how in ((rows.filter(packed), compression, mode), (rows.filter(~packed), "none", "append")):
        (landing_layout(part, z).write.mode(how).option("compression", codec).option("timestampNTZFormat", TS_FORMAT)
         .option("maxRecordsPerFile", rows_per_file).partitionBy(*LANDING_PARTITIONS).json(path))


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
LANDING_SCHEMA = ("organization_id string, db_key string, type_dir string, dt string, hr string, "
                  "obs_type string, observation_time timestamp_ntz, payload string, id bigint, object_key string")


def read_landing(spark: SparkSession, *paths: str) -> DataFrame:
    """Read landing zones back; the schema keeps dt/hr as text (no inference)."""
    out = None
    for path in paths:      # each has type/day folders of its own
        one = spark.read.schema(LANDING_SCHEMA).option("timestampNTZFormat", TS_FORMAT).json(path)
        out = one if out is None else out.unionByName(one)
    return out


def serialize(obs: DataFrame, version: Column | None = None) -> DataFrame:
    """Document JSON text (NULL fields omitted) with the epoch-seconds summary.

    A payload that is JSON text is nested as such; other text stays a string.
    """
    summary = F.struct((version if version is not None else F.lit(None).cast("string")).alias("version"),
                       F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                       F.col("observation_time")).alias("observation_time"))
    data = F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant"))
    doc = F.struct(data.alias("data"), summary.alias("summary"), "db_key", "organization_id")
    return obs.select("id", "obs_type", F.to_json(doc).alias("document"))


def hourly_latest(obs: DataFrame) -> DataFrame:
    """A10: the last document of each (org, db, type, hour), as the fixed object name kept it."""
    hour = _hour_ntz(F.col("observation_time"))
    g = obs.groupBy("organization_id", "db_key", "obs_type", hour.alias("hour")).agg(
        F.max_by(F.struct("observation_time", "id", "payload"), F.struct("observation_time", "id")).alias("_l"))
    return g.select("organization_id", "db_key", "obs_type", "hour", "_l.observation_time", "_l.id", "_l.payload")


UPSERT_BUCKETS = 64


def upsert_hourly_latest(obs: DataFrame, path: str, buckets: int = UPSERT_BUCKETS) -> None:
    """A10 kept up to date: merges ``obs`` into the table at ``path``, rewriting only the folders it touches.

    Folders are hours and key buckets.  The touched ones are read, merged and
    replaced by a dynamic partition overwrite; all other files stay as they
    are.  Merging keeps the latest document, so a landing that is repeated
    after a failure changes nothing.
    """
    spark, parts = obs.sparkSession, ["hour_dir", "bucket"]
    bucket = F.pmod(F.xxhash64("organization_id", "db_key", "obs_type"), F.lit(buckets)).cast("int")
    new = hourly_latest(obs).withColumns({"hour_dir": F.date_format("hour", "yyyyMMddHH"), "bucket": bucket})
    new = write_once(new, "upsert")
    merged = new
    try:
        old = read_hourly_latest(spark, path, folders=True)
    except AnalysisException:       # the first landing
        old = None
    if old is not None:
        touched = new.select(*parts).distinct().withColumnsRenamed({p: f"_{p}" for p in parts})
        same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts]
        last = F.struct("observation_time", "id")
        both = old.join(F.broadcast(touched) if touched.count() <= BROADCAST_FOLDERS else touched, same, "left_semi").unionByName(new)
        merged = write_once(both.groupBy("organization_id", "db_key", "obs_type", "hour", *parts).agg(
            F.max_by(F.struct("observation_time", "id", "payload"), last).alias("_l")).select(
            "organization_id", "db_key", "obs_type", "hour", "_l.*", *parts), "upsert")
    (merged.repartition(*parts, F.pmod(F.xxhash64("organization_id", "db_key"), F.lit(8))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


#: Touched folders up to this number prune the old table's folders by a broadcast.
BROADCAST_FOLDERS = 100_000


def read_hourly_latest(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """The table of ``upsert_hourly_latest``."""
    schema = ("organization_id string, db_key string, obs_type string, hour timestamp_ntz, observation_time timestamp_ntz, "
              "id bigint, payload string, hour_dir string, bucket int")
    df = spark.read.schema(schema).parquet(path)        # an error where there is none yet
    return df if folders else df.drop("hour_dir", "bucket")


# C13 / C14 / G1 -------------------------------------------------------------------
def metric_source_merge(base: DataFrame, external: Mapping[str, DataFrame] | DataFrame) -> DataFrame:
    """Global metric map merged with external sources; on equal names the external value wins.

    Long form ``(K, name, value)``; priority 0 for the base, 1.. for sources.
    """
    srcs = external.values() if isinstance(external, Mapping) else [external]
    u = base.select(*K, "name", "value", F.lit(0).alias("_p"))
    for i, s in enumerate(srcs, start=1):
        u = u.unionByName(s.select(*K, "name", "value", F.lit(i).alias("_p")))
    return u.groupBy(*K, "name").agg(F.max_by("value", "_p").alias("value"))


def observation_assemble(spine: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """C14: one document per snapshot from optional parts (left joins from the spine).

    Each part is (K, fields...) with at most one row per K; a missing part
    leaves its struct NULL (and absent from the JSON text) without touching the
    others.
    """
    doc = spine.select(*K)
    for name, part in parts.items():
        fields = [c for c in part.columns if c not in K]
        doc = doc.join(part.select(*K, F.struct(*fields).alias(name)), K, "left")
    return doc


def logical_db_union(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: rows of all logical databases with their name; missing columns become NULL (Q10).

    Rows carry the database's name in K, so there is one frame per column set
    (server version), not per database: any number of databases is one scan.
    """
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
