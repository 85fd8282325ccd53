"""Numbering and pages: one group over many tasks, whole lists, no window over a group's rows."""

from pyspark.sql import functions as F

from fleetlens.operators.numbering import numbered
from fleetlens.operators.observations import with_pages


def test_positions_of_a_hot_key(spark):
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
                               .alias("k"), (F.hash("id") % 1000).alias("v"), "id")
    got = numbered(df.repartition(13), ["k"], [F.col("v").desc(), F.col("id")]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.k, []).append((r.position, -r.v, r.id))
    assert len(got) == n and None in groups
    for rows in groups.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_a_hot_key_is_dealt_over_tasks_and_no_window_sorts_its_rows(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")       # so that small ranges stay apart
    out = numbered(spark.range(50_000).select(F.lit("hot").alias("k"), "id"), ["k"], [F.col("id")])
    spark.conf.unset(name)
    sizes = [r["count"] for r in out.groupBy(F.shiftright(F.expr("position - 1"), 14)).count().collect()]
    assert sum(sizes) == 50_000 and len(out.inputFiles()) > 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # The only window runs over counts: one row per key and range.
    assert plan.count("Window [") == 1 and "Aggregate" in plan[plan.index("Window ["):]


def test_ties_equal_rows_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [(None, None)] * 3, "k string, v int")
    assert sorted(r.position for r in numbered(df, ["k"], [F.col("v")]).collect()) == [1, 1, 2, 2, 3, 3, 4, 5]
    assert numbered(df.filter("v > 9"), ["k"], [F.col("v")]).count() == 0


def test_pages_follow_flags_and_names(spark):
    df = spark.createDataFrame([("k", i % 2 == 0, f"n{i:02d}") for i in range(10)], "k string, f boolean, n string")
    rows = with_pages(df, ["!f", "n"], 4, ["k"]).orderBy("page", F.desc("f"), "n").collect()
    assert [r.n for r in rows] == [f"n{i:02d}" for i in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]
    assert [r.page for r in rows] == [0] * 4 + [1] * 4 + [2] * 2
