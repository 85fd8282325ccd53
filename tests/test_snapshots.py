"""Landed snapshot tables: round trip, pruning by the manifest, null keys, hot databases, replays, column sets."""

from datetime import datetime

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from fleetlens.operators import observations as O
from fleetlens.sources import clustered as C
from fleetlens.sources import snapshots as SN
from fleetlens.sources import standins as V

COLUMNS = "organization_id string, db_key string, logical_database_name string, t string, v int"


def _frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).withColumn("observation_time", F.col("t").cast("timestamp_ntz")).drop("t")


def _same(a, b):
    return a.exceptAll(b.select(*a.columns)).count() == 0 and b.select(*a.columns).exceptAll(a).count() == 0


def test_round_trip_and_pruning(spark, tmp_path):
    ts = V.pg_stat_user_tables(spark, SF_SMALL)
    path = str(tmp_path / "pg_stat_user_tables")
    SN.write_snapshot(ts, path, rows_per_file=10)
    assert _same(ts, SN.read_snapshot(spark, path))
    one = SN.read_snapshot(spark, path, ["relid", "n_live_tup"], organization_id="org0", db_key="Brand#11", since="2024-01-31")
    assert _same(one, ts.filter("db_key = 'Brand#11'").select(*one.columns)) and one.count() > 0
    files = C.manifest_of(spark, path).count()
    assert len(one.inputFiles()) < files / 3          # only files that may hold the database are opened
    assert SN.read_snapshot(spark, path, since="2024-02-01").count() == 0
    assert SN.read_snapshot(spark, path, until="2024-01-31").count() == ts.count()


def test_every_dimension_prunes(spark, tmp_path):
    rows = [(f"o{o}", f"d{d:02d}", "l", f"2024-01-{day:02d} {h:02d}:30:00", o) for o in range(4) for d in range(16)
            for day in (1, 2) for h in range(0, 24, 3)]
    path = str(tmp_path / "grid")
    SN.write_snapshot(_frame(spark, rows), path, rows_per_file=8)
    files = C.manifest_of(spark, path).count()
    for query in ({"organization_id": "o2"}, {"db_key": "d07"}, {"since": "2024-01-02"}):
        got = SN.read_snapshot(spark, path, **query)
        assert len(got.inputFiles()) <= 0.8 * files and got.count() > 0
    both = SN.read_snapshot(spark, path, organization_id="o2", db_key="d07", since="2024-01-02")
    assert both.count() == 8 and len(both.inputFiles()) <= 0.35 * files


def test_null_keys_and_times_are_kept(spark, tmp_path):
    rows = [("o", "d", "l", "2024-01-01 00:00:00", 1), ("o", None, "l", "2024-01-01 00:00:00", 2), (None, "d", None, None, 3),
            (None, None, None, None, 4), (None, None, None, None, 4)]
    path = str(tmp_path / "nulls")
    df = _frame(spark, rows)
    SN.write_snapshot(df, path)
    assert _same(df, SN.read_snapshot(spark, path))
    assert sorted(r.v for r in SN.read_snapshot(spark, path, db_key="d").collect()) == [1, 3]
    assert [r.v for r in SN.read_snapshot(spark, path, since="2023-01-01", db_key="d").collect()] == [1]


def test_a_hot_database_is_many_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("o").alias("organization_id"), F.when(F.col("id") % 3 < 2, "hot").otherwise(
        F.col("id").cast("string")).alias("db_key"), F.lit("l").alias("logical_database_name"), F.col("id").cast("int").alias("v"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("observation_time"))
    path = str(tmp_path / "hot")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        SN.write_snapshot(rows, path)
    finally:
        spark.conf.unset(name)
    sizes = [r.n_rows for r in C.manifest_of(spark, path).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2 * 4000 / len(sizes)
    assert SN.read_snapshot(spark, path, db_key="hot").count() == rows.filter("db_key = 'hot'").count()


def test_keys_stay_text(spark, tmp_path):
    path = str(tmp_path / "keys")
    SN.write_snapshot(_frame(spark, [("1", "007", "d", "2024-01-01 00:00:00", 1), ("1", "7", "d", "2024-01-01 00:00:00", 2)]),
                      path, rows_per_file=1)
    assert [r.v for r in SN.read_snapshot(spark, path, db_key="007").collect()] == [1]
    assert {(r.organization_id, r.db_key) for r in SN.read_snapshot(spark, path).collect()} == {("1", "007"), ("1", "7")}


def test_a_replayed_batch_counts_once_and_compaction_keeps_all(spark, tmp_path):
    path = str(tmp_path / "replay")
    a = _frame(spark, [("o", f"d{i}", "l", "2024-01-01 00:00:00", i) for i in range(5)])
    b = _frame(spark, [("o", f"d{i}", "l", "2024-01-02 00:00:00", i) for i in range(5)])
    for df, batch in ((a, "a"), (b, "b"), (a, "a")):
        SN.write_snapshot(df, path, batch)
    assert _same(a.unionByName(b), SN.read_snapshot(spark, path))
    SN.compact_snapshots(spark, path)
    assert C.manifest_of(spark, path).select("batch").distinct().count() == 1
    assert _same(a.unionByName(b), SN.read_snapshot(spark, path))


def test_column_sets_of_several_versions(spark, tmp_path):
    path = str(tmp_path / "versions")
    base = _frame(spark, [("o", "d", "l", "2024-01-01 00:00:00", 1)])
    SN.write_snapshot(base, path, "v1")
    SN.write_snapshot(base.withColumn("n_dead", F.lit(7)), path, "v2")
    SN.write_snapshot(base.drop("v").withColumn("ins", F.lit("x")), path, "v3")
    got = {(r.v, r.n_dead, r.ins) for r in SN.read_snapshot(spark, path, all_columns=True).collect()}
    assert got == {(1, None, None), (1, 7, None), (None, None, "x")}


def test_landing_keeps_documents_without_key_or_time(spark, tmp_path):
    obs = spark.createDataFrame([("o", "d", "db", "2024-01-01 05:00:00", "{}", 1), (None, "d", "query", "2024-01-01 05:00:00", "{}", 2),
                                 ("o", None, "schema", None, "{}", 3), (None, None, None, None, None, 4)],
                                "organization_id string, db_key string, obs_type string, t string, payload string, id long")
    obs = obs.withColumn("observation_time", F.col("t").cast("timestamp_ntz")).drop("t")
    O.land(obs, str(tmp_path / "zone"))
    back = O.read_landing(spark, str(tmp_path / "zone"))
    assert _same(obs, back) and back.count() == 4
    assert {(r.id, r.type_dir, r.dt, r.hr) for r in back.collect()} == {
        (1, "DB", "20240101", "05"), (2, "QUERY", "20240101", "05"), (3, "SCHEMA", None, None), (4, "UNKNOWN", None, None)}


def test_upsert_rewrites_only_touched_folders(spark, tmp_path):
    path = str(tmp_path / "latest")
    obs = V.observation_log(spark, SF_SMALL).filter("observation_time < '2024-01-08'")
    first, second = obs.filter("id % 3 > 0"), obs.filter("id % 3 = 0 AND hour(observation_time) < 6")
    O.upsert_hourly_latest(first, path, buckets=4)
    before = set(O.read_hourly_latest(spark, path).inputFiles())
    O.upsert_hourly_latest(second, path, buckets=4)
    table = O.read_hourly_latest(spark, path)
    assert _same(O.hourly_latest(first.unionByName(second)), table)
    kept = before & set(table.inputFiles())
    late = {f for f in before if int(f.split("hour_dir=")[1][8:10]) >= 6}
    assert late and late <= kept < before           # untouched files keep their names
    O.upsert_hourly_latest(second, path, buckets=4)  # a repeated landing
    assert _same(O.hourly_latest(first.unionByName(second)), O.read_hourly_latest(spark, path))


def test_upsert_keeps_documents_without_a_time(spark, tmp_path):
    path = str(tmp_path / "latest")
    obs = spark.createDataFrame([("o", "d", "db", None, "a", 1), (None, "d", "db", None, "b", 2)],
                                "organization_id string, db_key string, obs_type string, t string, payload string, id long")
    obs = obs.withColumn("observation_time", F.col("t").cast("timestamp_ntz")).drop("t")
    for _ in range(2):
        O.upsert_hourly_latest(obs, path, buckets=2)
    assert sorted(r.payload for r in O.read_hourly_latest(spark, path).collect()) == ["a", "b"]


def test_a_batch_is_read_once_and_dealt(spark, tmp_path):
    """However few files a batch comes in: its rows are made once, then many tasks have them."""
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return (f"o{i % 2}", f"d{i % 50}", "db", datetime(2024, 1, 1 + i % 3, i % 24), "{}", i)

    obs = spark.createDataFrame(spark.sparkContext.parallelize(range(600), 1).map(row),
                                "organization_id string, db_key string, obs_type string, observation_time timestamp_ntz, "
                                "payload string, id long")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        O.land(obs, str(tmp_path / "zone"))
        assert seen.value == 600
        dealt = C.spread(obs, "dealt").groupBy(F.input_file_name()).count().collect()
    finally:
        spark.conf.unset(name)
    assert _same(obs, O.read_landing(spark, str(tmp_path / "zone")))
    assert sum(r["count"] for r in dealt) == 600 and max(r["count"] for r in dealt) < 2 * 600 / len(dealt) and len(dealt) == 8


def test_the_curve_holds_values_not_their_combinations(spark):
    rows = [(f"o{o}", f"d{d}", "l", f"2024-01-01 {h:02d}:30:00", o) for o in range(4) for d in range(16) for h in range(24)]
    rows += [(None, None, "l", None, 0)]
    df = _frame(spark, rows)
    z = C.curve(df, SN._dims())
    assert z.count() == 5 + 17 + 25
    assert _same(df, C.clustered(df, SN._dims(), z=z)) and C.clustered(df, SN._dims(), z=z).count() == len(rows)


def test_an_empty_batch_is_landed(spark, tmp_path):
    obs = V.observation_log(spark, SF_SMALL).limit(0)
    O.land(obs, str(tmp_path / "zone"))
    assert O.read_landing(spark, str(tmp_path / "zone")).count() == 0
    SN.write_snapshot(_frame(spark, []), str(tmp_path / "snapshots"))
    assert SN.read_snapshot(spark, str(tmp_path / "snapshots")).count() == 0
