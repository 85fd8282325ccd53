"""A snapshot holding most rows: results must equal the unsalted plan and stay whole."""

from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from fleetlens.operators import rollups as R
from fleetlens.operators import topn as T
from fleetlens.sources import standins as V


def _skewed(spark):
    """Index statistics where ~90% of the rows belong to one snapshot."""
    idx = V.pg_stat_user_indexes(spark, SF_SMALL)
    hot = F.when(F.col("indexrelid") % 10 != 0, F.lit("HOT")).otherwise(F.col("db_key"))
    return idx.withColumn("db_key", hot).withColumn("logical_database_name", F.lit("db0"))


def test_salted_top_n_equals_plain_on_skew(spark):
    df = _skewed(spark)
    order = [F.col("index_size").desc_nulls_first(), F.col("indexrelid")]
    salted = T.top_n_per_key(df, 50, order, salt_by=["indexrelid"], salts=32, rank_col="r")
    plain = T.top_n_per_key(df, 50, order, rank_col="r")
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    hot = salted.filter(F.col("db_key") == "HOT")
    assert hot.count() == 50 and hot.agg(F.max("r")).first()[0] == 50


def test_counters_whole_on_skew(spark):
    df = _skewed(spark)
    sums = R.sum_counters(df, ["idx_scan"]).agg(F.sum("idx_scan")).first()[0]
    assert sums == df.agg(F.sum("idx_scan")).first()[0]
