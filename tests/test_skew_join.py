"""Lookups by keys of few values: equal results, and no task with much more than the median."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import inventory as INV
from fleetlens.operators import skew
from fleetlens.sources import standins as V
from sf_paths import SF_SMALL

PARTS = "spark.sql.shuffle.partitions"


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", PARTS)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set(PARTS, "32")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _big(spark):
    """A third of the rows in one snapshot with three types, a sixth without a key, the rest spread."""
    i = F.col("id")
    k = F.when(i % 6 < 2, "hot").when(i % 6 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), i % 997))
    return spark.range(60_000).select(k.alias("k"), (i % 3).alias("t"), i.alias("v"))


def _small(spark):
    ks = spark.range(997).select(F.concat(F.lit("s"), "id").alias("k")).union(spark.sql("select 'hot' union all select null"))
    return ks.crossJoin(spark.range(2).withColumnRenamed("id", "t")).withColumn("name", F.concat_ws("-", "k", "t"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_equal_to_the_plain_join(spark, no_broadcast, how):
    got, want = skew.lookup_join(_big(spark), _small(spark), ["k", "t"], how), _big(spark).join(_small(spark), ["k", "t"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_task_has_much_more_than_the_median(spark, no_broadcast):
    def sizes(df):
        return sorted(Counter(r.p for r in df.select(F.spark_partition_id().alias("p")).collect()).values())

    plain = sizes(_big(spark).join(_small(spark), ["k", "t"], "left"))
    split = sizes(skew.lookup_join(_big(spark), _small(spark), ["k", "t"]))
    assert plain[-1] > 3 * plain[len(plain) // 2]
    assert sum(split) == 60_000 and split[-1] <= 2 * split[len(split) // 2]


def test_small_sides_are_left_to_the_planner(spark):
    small = spark.range(2).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit("x").alias("name"))
    plan = skew.lookup_join(_big(spark), small, ["k", "t"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "_salt" not in text


def test_inventories_are_equal_with_split_keys(spark, no_broadcast):
    args = [f(spark, SF_SMALL) for f in (V.catalog_attribute, V.catalog_class, V.catalog_namespace, V.catalog_attrdef,
                                         V.catalog_type, V.catalog_collation)]
    split = INV.column_inventory(*args).collect()
    assert "_salt" in INV.column_inventory(*args)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert Counter(map(tuple, split)) == Counter(map(tuple, INV.column_inventory(*args).collect())) and split
