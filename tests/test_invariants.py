"""Invariants on the stand-ins at sf0.001."""

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from fleetlens.keys import K
from fleetlens.operators import rollups as R
from fleetlens.operators import topn as T
from fleetlens.plans.queries import QUERIES
from fleetlens.sources import standins as V


def test_row_count_buckets_partition(spark):
    d = R.row_count_distribution(V.pg_stat_user_tables(spark, SF_SMALL), (25, 30, 35, 40, 45))
    cols = R.ROW_COUNT_COLUMNS[1:8]
    bad = d.filter(sum(F.col(c) for c in cols) != F.col("num_tables")).count()
    assert bad == 0


def test_top_n_is_subset_and_bounded(spark):
    ts = V.pg_stat_user_tables(spark, SF_SMALL)
    top = T.top_tables(ts, 3)
    assert top.groupBy(*K).count().filter("count > 3").count() == 0
    assert top.join(ts, K + ["relid"], "left_anti").count() == 0
    # salting does not change the result
    plain = T.top_n_per_key(ts.filter("n_live_tup + seq_scan + idx_scan > 0"), 3,
                            [F.col("n_live_tup").desc(), (F.col("seq_scan") + F.col("idx_scan")).desc(),
                             F.col("relid")], rank_col="rank").select(*K, "relid", "rank")
    assert plain.exceptAll(top).count() == 0 and top.exceptAll(plain).count() == 0


def test_semi_join_subset(spark):
    df = QUERIES["target_semi"](spark, SF_SMALL)
    src = V.pg_statio_user_tables(spark, SF_SMALL)
    assert df.exceptAll(src).count() == 0


def test_empty_target_set_keeps_nothing(spark):
    ts = V.pg_stat_user_tables(spark, SF_SMALL)
    assert T.target_semi(ts, ts.limit(0).select(*K, "relid")).count() == 0


def test_top_tables_drops_index_less_tables(spark):
    ts = V.pg_stat_user_tables(spark, SF_SMALL)
    top = T.top_tables(ts, 10 ** 6)
    assert top.join(ts.filter("idx_scan IS NULL"), K + ["relid"], "left_semi").count() == 0
    zero = T.top_tables(ts, 10 ** 6, count_missing_as_zero=True)
    assert zero.count() > top.count()


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["organization_id", "db_key", "logical_database_name", "observation_time", "relid",
                          "bloat_ratio"]
    assert df.count() > 0


def test_column_lookups_match_at_most_once(spark):
    from fleetlens.operators.inventory import multi_matches
    assert multi_matches(V.catalog_attrdef(spark, SF_SMALL), K + ["adrelid", "adnum"]).count() == 0
    assert multi_matches(V.catalog_collation(spark, SF_SMALL), K + ["oid"]).count() == 0
    assert multi_matches(V.catalog_type(spark, SF_SMALL), K + ["oid"]).count() == 0


def test_stream_with_processing_time_trigger_runs_until_stopped(spark):
    from fleetlens.streaming import streams as S
    base = S.work_dir(spark, "pt")
    src = S.materialize(V.pg_stat_user_tables(spark, SF_SMALL), f"{base}/input")
    s = S.file_stream(spark, src, V.pg_stat_user_tables(spark, SF_SMALL).schema)
    q = S.run(s.groupBy(*K).count(), S.versioned_sink(f"{base}/out"), f"{base}/ckpt", "update",
              {"processingTime": "1 second"}, block=False)
    try:
        q.processAllAvailable()
        assert q.isActive
    finally:
        q.stop()
    assert spark.read.parquet(f"{base}/out").count() > 0
