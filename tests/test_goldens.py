"""Golden values from the reference's own unit tests, re-run on Spark."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.functions import expr as X
from fleetlens.functions.text import scrub_vacuum_query, truncate_lines
from fleetlens.operators import bloat as BL
from fleetlens.operators import observations as O
from fleetlens.operators import status as SS

KROW = dict(organization_id="o", db_key="d", logical_database_name="l")


def _widths(spark, rows):
    data = [Row(**KROW, observation_time=None, relid=r, attnum=i, attname=f"c{i}", attalign=a, avg_width=w)
            for i, (r, a, w) in enumerate(rows)]
    return spark.createDataFrame(data, "organization_id string, db_key string, logical_database_name string, "
                                       "observation_time timestamp_ntz, relid bigint, attnum int, attname string, "
                                       "attalign string, avg_width int")


@pytest.mark.parametrize("cols,expected", [
    ([("i", 4), ("d", 8), ("i", 4), ("i", 4), ("i", 4)], 4),
    ([("i", 5), ("d", 8), ("d", 19), ("i", 121), ("s", 2), ("s", 2), ("c", 1), ("c", 2)], 8),
    ([("i", 8), ("d", 8), ("d", 3), ("c", 121), ("i", 8)], 0),
])
def test_tuple_padding_single(spark, cols, expected):
    df = _widths(spark, [(1234, a, w) for a, w in cols])
    assert BL.tuple_padding(df).collect()[0]["padding"] == expected


def test_tuple_padding_grouped(spark):
    rows = [(1234, "i", 5), (1234, "i", 3), (1234, "d", 3), (1234, "c", 7), (1234, "i", 2),
            (2234, "i", 1), (2234, "d", 2), (2234, "d", 3), (2234, "d", 4), (2234, "i", 5)]
    got = {r["relid"]: r["padding"] for r in BL.tuple_padding(_widths(spark, rows)).collect()}
    assert got == {1234: 12, 2234: 21}


def test_tuple_padding_unknown_alignment_fails(spark):
    with pytest.raises(Exception):
        BL.tuple_padding(_widths(spark, [(1, "i", 4), (1, "x", 4)])).collect()


def test_bloat_ratio_golden(spark):
    df = spark.createDataFrame(
        [Row(**KROW, observation_time=None, relid=1234, tblpages=324633, reltuples=44150088.0, bs=8192.0,
             page_hdr=24, fillfactor=100, is_na=False, tpl_data_size=24.0, tpl_hdr_size=23.0, ma=8, padding=4)],
        "organization_id string, db_key string, logical_database_name string, observation_time timestamp_ntz, "
        "relid bigint, tblpages bigint, reltuples double, bs double, page_hdr int, fillfactor int, is_na boolean, "
        "tpl_data_size double, tpl_hdr_size double, ma int, padding bigint")
    got = BL.bloat_ratio(df).collect()[0]["bloat_ratio"]
    assert got == pytest.approx(0.09764872948837611, rel=1e-12)


def test_bloat_ratio_is_na_and_zero_pages(spark):
    base = dict(KROW, observation_time=None, relid=1, reltuples=-1.0, bs=8192.0, page_hdr=24, fillfactor=100,
                tpl_data_size=9000.0, tpl_hdr_size=23.0, ma=8, padding=0)
    schema = ("organization_id string, db_key string, logical_database_name string, observation_time timestamp_ntz, "
              "relid bigint, reltuples double, bs double, page_hdr int, fillfactor int, tpl_data_size double, "
              "tpl_hdr_size double, ma int, padding bigint, tblpages bigint, is_na boolean")
    df = spark.createDataFrame([Row(**base, tblpages=0, is_na=False),
                                Row(**{**base, "relid": 2}, tblpages=10, is_na=True)], schema)
    got = {r["relid"]: r["bloat_ratio"] for r in BL.bloat_ratio(df).collect()}
    assert got == {1: 0.0, 2: None}


SCRUB_CASES = [
    ("vacuum oorder;", "vacuum oorder"),
    ("--some comments\nvacuum oorder;", "vacuum oorder"),
    ("--some comments\n vacuum oorder;", "vacuum oorder"),
    ("--some comments\nVACUUM oorder;", "vacuum oorder"),
    ("--some comments\nVACUUM OORDER;", "vacuum oorder"),
    ("VACUUM OORDER", "vacuum oorder"),
    ("--some comments\n\t\t VACUUM TPCC.OORDER\t\n--comment", "vacuum tpcc.oorder"),
    ("vacuum tl1;", "vacuum tl1"),
    ("autovacuum: VACUUM public.t", "autovacuum: VACUUM public.t"),
    ("select 1", "select 1"),
    ("vacuum ;", "vacuum ;"),
]


def test_scrub_vacuum_query(spark):
    df = spark.createDataFrame([(q,) for q, _ in SCRUB_CASES], "query string")
    got = [r[0] for r in df.select(scrub_vacuum_query(F.col("query"))).collect()]
    assert got == [e for _, e in SCRUB_CASES]


def test_truncate_lines(spark):
    long = "\n".join(f"l{i}" for i in range(200)) + "\n"
    short = "a\r\nb\nc"
    df = spark.createDataFrame([(long,), (short,)], "t string")
    got = [r[0] for r in df.select(truncate_lines(F.col("t"))).collect()]
    lines = long.splitlines()
    assert got[0] == "\n".join(lines[:50] + ["...ignore 50 lines here..."] + lines[-100:])
    assert got[1] == short


def _status(spark, pairs):
    rows = [Row(**KROW, observation_time=None, Variable_name=n, Value=str(v), ord=i) for i, (n, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "organization_id string, db_key string, logical_database_name string, "
                                       "observation_time timestamp_ntz, Variable_name string, Value string, ord int")


def test_derived_ratios_golden(spark):
    st = _status(spark, [("Innodb_buffer_pool_reads", 25), ("Innodb_buffer_pool_read_requests", 100),
                         ("com_select", 1), ("com_insert", 1), ("com_update", 1), ("com_delete", 1),
                         ("com_replace", 1)])
    r = SS.derived_ratios(SS.status_counters(st)).collect()[0]
    assert r["buffer_miss_ratio"] == 25.0 and r["read_write_ratio"] == 0.25


def test_derived_ratios_missing_counters(spark):
    r = SS.derived_ratios(SS.status_counters(_status(spark, [("Uptime", 5)]))).collect()[0]
    assert r["buffer_miss_ratio"] == 0.0 and r["read_write_ratio"] == 1.0


def test_status_counters_last_case_wins(spark):
    st = _status(spark, [("Com_select", 1), ("COM_SELECT", 7)])
    assert SS.status_counters(st).collect()[0]["value"] == "7"


def test_versions(spark):
    df = spark.createDataFrame([("12 (Ubuntu 12.6-0ubuntu0.20.04.1)",), ("8.0.22-log",), ("5.7.34",)], "v string")
    r = df.select(X.pg_version_text("v").alias("pg"), X.mysql_version_text("v").alias("my")).collect()
    assert r[0]["pg"] == "12" and r[1]["my"] == "8.0.22"
    q = df.select(X.version_at_least(X.mysql_version_text(X.pg_version_text("v")), 8, 0).alias("ge")).collect()
    assert [x["ge"] for x in q] == [True, True, False]


def test_engine_version_key(spark):
    df = spark.createDataFrame([("aurora-mysql", "5.6.mysql_aurora.1.22.2"), ("aurora-postgresql", "12.6"),
                                ("aurora", "5.6.10a"), ("postgres", "9.6.3"), ("postgres", "14.2"),
                                ("mysql", "8.0.28")], "e string, v string")
    got = [r[0] for r in df.select(X.engine_version_key("e", "v")).collect()]
    assert got == ["aurora_mysql-5_6", "aurora_postgresql-12", "aurora_mysql-5_6", "postgres-9_6", "postgres-14",
                   "mysql-8_0"]


def test_object_prefix(spark):
    df = spark.createDataFrame([("o", "d", "long_running_query"), ("o", "d", "weird")], "org string, db string, t string")
    df = df.withColumn("ts", F.lit("2024-01-21 05:07:00").cast("timestamp_ntz"))
    got = [r[0] for r in df.select(X.object_prefix("org", "db", "t", "ts")).collect()]
    assert got == ["o/d/LONG_RUNNING_QUERY/20240121/05/data", "o/d/UNKNOWN/20240121/05/data"]


def test_latest_metric_golden(spark):
    now = "2024-01-31 00:00:00"
    samples = [("db", "WriteIOPS", 0, 1234.0), ("db", "WriteIOPS", 60, 2234.0), ("db", "WriteIOPS", 120, 3234.0),
               ("db", "CPUUtilization", 70, 5555.0), ("db", "CPUUtilization", 130, 6666.0),
               ("db", "CPUCreditUsage", 300, 94041.0), ("db", "ReplicaLag", 90, 7890.0),
               ("db", "FreeMemory", 900, 1.0)]
    df = spark.createDataFrame(samples, "db_key string, metric string, ago int, value double") \
        .withColumn("ts", F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.col("ago")))
    got = {r["metric"]: r["value"] for r in O.latest_metric(df, None, now, 600, 60).collect()}
    assert got == {"WriteIOPS": 1234.0, "CPUUtilization": 5555.0, "CPUCreditUsage": 94041.0, "ReplicaLag": 7890.0}


def test_logical_db_union_twice(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "relid bigint, n bigint")
    named = lambda x: df.withColumn("logical_database_name", F.lit(x))
    u = O.logical_db_union([named("postgres"), named("other").drop("n")])
    rows = sorted((r["logical_database_name"], r["relid"], r["n"]) for r in u.collect())
    assert rows == [("other", 1, None), ("other", 2, None), ("postgres", 1, 10), ("postgres", 2, 20)]


def test_metric_source_merge_external_wins(spark):
    sch = ("organization_id string, db_key string, logical_database_name string, observation_time timestamp_ntz, "
           "name string, value string")
    base = spark.createDataFrame([Row(**KROW, observation_time=None, name="a", value="1"),
                                  Row(**KROW, observation_time=None, name="b", value="2")], sch)
    ext = spark.createDataFrame([Row(**KROW, observation_time=None, name="a", value="9")], sch)
    got = {r["name"]: r["value"] for r in O.metric_source_merge(base, {"cw": ext}).collect()}
    assert got == {"a": "9", "b": "2"}


def test_envelope_round_trip(spark):
    import datetime
    t = datetime.datetime(2024, 1, 31)
    rows = [Row(**KROW, observation_time=t, id=i, name=f"n{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "organization_id string, db_key string, logical_database_name string, "
                                     "observation_time timestamp_ntz, id bigint, name string")
    packed = O.envelope_pack(df, "item", ["name", "id"], ["id"], page_rows=3)
    pages = packed.collect()
    assert len(pages) <= 3 and sum(r["n_rows"] for r in pages) == 7
    back = O.envelope_explode(packed, "item", "id bigint, name string")
    assert sorted((r["id"], r["name"]) for r in back.collect()) == [(i, f"n{i}") for i in range(7)]


def test_metric_catalog_files(spark, tmp_path):
    inst = tmp_path / "cloudwatch_metrics"
    clus = tmp_path / "cloudwatch_metrics_cluster"
    inst.mkdir()
    clus.mkdir()
    (inst / "rds_mysql-8_0.json").write_text(
        '[{"name": "BinLogDiskUsage", "description": "x"}, {"name": "CPUUtilization", "description": "y"},'
        ' {"Metric": "BinLogDiskUsage", "Description": "z"}]')
    (clus / "rds_mysql-8_0.json").write_text("[]")
    (clus / "rds_aurora_mysql-5_7.json").write_text('[{"Metric": "VolumeBytesUsed", "Description": "v"}]')
    cat = O.metric_catalog(spark, str(tmp_path) + "/*/*.json")
    got = sorted(tuple(r) for r in cat.collect())
    assert got == [("aurora_mysql-5_7", "cluster", "VolumeBytesUsed"), ("mysql-8_0", "instance", "BinLogDiskUsage"),
                   ("mysql-8_0", "instance", "CPUUtilization")]
    inst_df = spark.createDataFrame([("db1", "mysql", "8.0.28", ""), ("db2", "aurora-mysql", "5.7.mysql_aurora.2.1", "c")],
                                    "db_key string, engine string, version string, cluster_id string")
    look = sorted((r["db_key"], r["metric"]) for r in O.catalog_lookup(inst_df, cat).collect())
    assert look == [("db1", "BinLogDiskUsage"), ("db1", "CPUUtilization"), ("db2", "VolumeBytesUsed")]


def test_landing_round_trip(spark, tmp_path):
    obs = spark.createDataFrame(
        [("o1", "d1", "db", "2024-01-21 05:07:00.123456", "{}", 1), ("o1", "d1", "db", "2024-01-21 05:59:00", "{2}", 2),
         ("o1", "d1", "table", "2024-01-21 06:00:00", "{3}", 3)],
        "organization_id string, db_key string, obs_type string, t string, payload string, id bigint") \
        .withColumn("observation_time", F.col("t").cast("timestamp_ntz")).drop("t")
    O.land(obs, str(tmp_path / "zone"))
    back = O.read_landing(spark, str(tmp_path / "zone"))
    got = sorted((r["type_dir"], r["dt"], r["hr"], r["id"], str(r["observation_time"])) for r in back.collect())
    assert got == [("DB", "20240121", "05", 1, "2024-01-21 05:07:00.123456"), ("DB", "20240121", "05", 2,
                   "2024-01-21 05:59:00"), ("TABLE", "20240121", "06", 3, "2024-01-21 06:00:00")]
    latest = O.hourly_latest(back.select("organization_id", "db_key", "obs_type", "observation_time", "payload", "id"))
    assert sorted(r["id"] for r in latest.collect()) == [2, 3]


def test_heartbeat_statuses(spark):
    act = spark.createDataFrame([("o", "a", "2024-01-01 00:10:00", "2024-01-01 03:30:00")],
                                "organization_id string, db_key string, f string, l string") \
        .select("organization_id", "db_key", F.col("f").cast("timestamp_ntz").alias("first_seen"),
                F.col("l").cast("timestamp_ntz").alias("last_seen"))
    err = spark.createDataFrame([("o", "a", 1, "E", "m", "s", "2024-01-01 00:20:00"),
                                 ("o", "a", 2, "E", "m", "s", "2024-01-01 03:10:00")],
                                "organization_id string, db_key string, error_id bigint, name string, message string, "
                                "stacktrace string, t string") \
        .withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")
    got = [(str(r["heartbeat_time"]), r["agent_status"], r["n_errors"])
           for r in O.agent_heartbeat(err, act, 3600).orderBy("heartbeat_time").collect()]
    assert got == [("2024-01-01 01:10:00", "error", 1), ("2024-01-01 02:10:00", "ok", 0),
                   ("2024-01-01 03:10:00", "ok", 0), ("2024-01-01 04:10:00", "terminating_error", 1)]
    errs = O.pack_errors(O.heartbeat_errors(err, act, 3600)).orderBy("heartbeat_time").collect()
    assert [r["n_rows"] for r in errs] == [1, 1]
    assert errs[0]["errors"].startswith('[{"data":{"name":"E","message":"m","stacktrace":"s"},"timestamp":')


def test_heartbeat_of_a_short_life_and_an_error_on_the_last_beat(spark):
    act = spark.sql("""SELECT 'o' AS organization_id, 'a' AS db_key, timestamp_ntz'2024-01-01 00:10:05' AS first_seen,
                       timestamp_ntz'2024-01-01 00:10:35' AS last_seen""")
    err = spark.sql("""SELECT 'o' AS organization_id, 'a' AS db_key, 1 AS error_id, 'E' AS name, 'm' AS message,
                       's' AS stacktrace, timestamp_ntz'2024-01-01 00:11:05' AS timestamp""")
    got = [(str(r.heartbeat_time), r.agent_status, r.n_errors) for r in O.agent_heartbeat(err, act, 60).collect()]
    assert got == [("2024-01-01 00:11:05", "terminating_error", 1)]
    doc = O.heartbeat_document(err, act, "1.0", 60).first().document
    assert doc == ('{"organization_id":"o","db_key":"a","agent_status":"terminating_error",'
                   '"agent_starttime":"2024-01-01T00:10:05","heartbeat_time":"2024-01-01T00:11:05","agent_version":"1.0",'
                   '"errors":[{"data":{"name":"E","message":"m","stacktrace":"s"},"timestamp":"2024-01-01T00:11:05"}]}')


def test_payloads_are_nested(spark):
    obs = spark.sql("""SELECT 1 AS id, 'db' AS obs_type, '{"a": [1, "x"]}' AS payload, 'd' AS db_key,
                       'o' AS organization_id, timestamp_ntz'1970-01-01 00:00:07' AS observation_time""")
    assert O.serialize(obs, F.lit("14.2")).first().document == (
        '{"data":{"a":[1,"x"]},"summary":{"version":"14.2","observation_time":7},"db_key":"d","organization_id":"o"}')


def test_empty_views_are_reported(spark):
    from fleetlens.keys import K
    from fleetlens.operators import rollups as R
    from fleetlens.operators import status as SS
    spine = spark.sql("SELECT 'o' organization_id, concat('d', id) db_key, 'l' logical_database_name, "
                      "timestamp_ntz'2024-01-01 00:00:00' observation_time FROM range(3)")
    view = spine.filter("db_key = 'd0'").withColumn("x", F.lit(1)).union(
        spine.filter("db_key = 'd1'").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))))
    got = {r.db_key: r.n_rows for r in SS.single_row_view(view, "v", spine).collect()}
    assert got == {"d1": 2, "d2": 0}
    ext = spine.filter("db_key = 'd0'").withColumn("extname", F.lit("pg_stat_statements"))
    assert {r.db_key: r.extension_present for r in R.extension_present(ext, spine=spine).collect()} == {
        "d0": True, "d1": False, "d2": False}
    assert K


def test_histogram_has_fixed_buckets(spark):
    from fleetlens.operators import rollups as R
    df = spark.createDataFrame([("a", 5.0e6), ("a", 1.0e7), ("a", 3.0e20), ("a", None)], "db_key string, value double")
    got = R.latency_histogram(df).orderBy("bucket_number").collect()
    assert len(got) == 450 and [r.bucket_number for r in got if r.count_bucket] == [0, 1, 449]
    assert got[-1].bucket_timer_high is None and got[-1].bucket_quantile == 1.0
