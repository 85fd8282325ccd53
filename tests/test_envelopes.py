"""Envelopes: items packed together and read back without a column list."""

import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from fleetlens.sources import envelopes as E

KEYS = ["db"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(p) if not isinstance(p, str) else p) for i, p in rows],
                                 "item string, payload string")


def test_columns_and_types_are_found(spark):
    d = docs(spark, ("a", {"columns": ["id", "name", "ratio"], "rows": [[1, "x", None], [2, None, 0.5]]}),
             ("a", {"columns": ["name", "id", "extra"], "rows": [["y", 3, True], ["z", 4, False]]}),
             ("b", {"columns": ["only"], "rows": []}), ("c", {"columns": ["mixed"], "rows": [[1], ["one"]]}),
             ("c", "no envelope"), ("c", {"columns": ["mixed", "list"], "rows": [[True, [1, 2]]]}))
    found = {i: [(f.name, f.dataType.simpleString()) for f in s.fields] for i, s in E.discover(d).items()}
    assert found == {"a": [("id", "bigint"), ("name", "string"), ("ratio", "decimal(1,1)"), ("extra", "boolean")],
                     "b": [("only", "string")], "c": [("mixed", "string"), ("list", "array<bigint>")]}
    rows = {r.id: r for r in E.item_frames(d)["a"].collect()}
    assert (rows[1].name, rows[2].ratio, rows[3].extra, rows[1].extra, rows[3].ratio) == ("x", Decimal("0.5"), True, None, None)
    assert sorted(str(r.mixed) for r in E.item_frames(d)["c"].collect()) == ["1", "one", "true"]
    assert E.item_frames(d)["b"].count() == 0


def test_short_and_long_rows(spark):
    d = docs(spark, ("a", {"columns": ["x", "y"], "rows": [[1], [2, 3, 4], []]}))
    assert sorted((str(r.x), str(r.y)) for r in E.item_frames(d)["a"].collect()) == [("1", "None"), ("2", "3"), ("None", "None")]


def test_wide_item_round_trip(spark):
    """28 columns of every kind: numbers, flags, text, times, exact decimals, columns that are null everywhere."""
    names = [f"c{i}" for i in range(28)]
    df = spark.range(50).select(
        F.lit("d1").alias("db"), *[(F.col("id") * i).alias(n) for i, n in enumerate(names[:20])],
        (F.col("id") % 2 == 0).alias(names[20]), F.lit(None).cast("string").alias(names[21]),
        F.concat(F.lit('quo"te\né '), "id").alias(names[22]), (F.col("id") / 4).alias(names[23]),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias(names[24]), F.lit(Decimal("1.50")).alias(names[25]),
        F.lit(dt.date(2024, 2, 29)).alias(names[26]), F.when(F.col("id") > 40, F.col("id")).alias(names[27]))
    packed = E.pack([E.Item("wide", df, ["c1"])], KEYS, 7)
    assert packed.count() == 8
    back = E.item_frames(packed)["wide"]
    assert [c for c in back.columns if c in names] == names
    got = {r.c1: r for r in back.collect()}
    for r in df.collect():
        g = got[r.c1]
        assert all(g[n] == r[n] for n in names[:24] if n != "c23") and float(g.c23) == r.c23 and g.c27 == r.c27
        assert (g.c24, g.c25, g.c26) == (str(r.c24), "1.50", "2024-02-29")
    places = {r.c1: r.page * 7 + r.row_pos for r in back.collect()}
    assert places == {i: i for i in range(50)}


def test_items_of_several_orders_are_one_numbering(spark):
    a = spark.createDataFrame([("d", 3, "x"), ("d", 1, "y"), ("d", None, "z")], "db string, n int, s string")
    b = spark.createDataFrame([("d", "q", 2.5), ("d", "p", 1.5), (None, "r", 0.5)], "db string, t string, v double")
    got = {(r.db, r["item"]): json.loads(r.payload) for r in
           E.pack([E.Item("a", a, ["n"]), E.Item("b", b, ["t"], ["v", "t"])], KEYS, 10).collect()}
    assert got["d", "a"] == {"columns": ["n", "s"], "rows": [[None, "z"], [1, "y"], [3, "x"]]}
    assert got["d", "b"] == {"columns": ["v", "t"], "rows": [[1.5, "p"], [2.5, "q"]]}
    assert got[None, "b"]["rows"] == [[0.5, "r"]]


def test_flat_rows_have_the_text_of_variants_without_variants(spark):
    from pyspark.sql import functions as F

    rows = [('a"b', "{x}", 1, True), ('"k":', "k", None, None), ("}", "{", 2, False), (None, "\\", -3, True),
            ('\\"k":', '"', 9, None), ("é\n\t\x01\u2028/</", 'k":"k', 0, True), ('{"k":1}', "[]", 5, False), ("", "", 1, True)]
    df = spark.createDataFrame([(1, *r) for r in rows], "id int, a string, b string, n bigint, f boolean")
    packed = E.pack([E.Item("x", df, ["a", "b"], ["b", "n", "f", "a"])], ["id"], 100)
    want = df.orderBy(F.col("a").asc_nulls_first(), "b").select(
        F.to_json(F.array(*[F.col(c).cast("variant") for c in ("b", "n", "f", "a")]))).collect()
    assert packed.first()["payload"] == '{"columns":["b","n","f","a"],"rows":[' + ",".join(r[0] for r in want) + "]}"
    text = E._row([F.col(c) for c in ("b", "n", "f", "a")], [df.schema[c].dataType for c in ("b", "n", "f", "a")])
    assert "variant" not in df.select(text)._jdf.queryExecution().optimizedPlan().toString()


def _by_variants(d, item):
    """The rows of ``d`` read by variants alone: no page counts as plain."""
    def refuse(payload):
        raise E._NotPlain

    plain, E._plain_page = E._plain_page, refuse
    try:
        found = E.discover(d)
        cells = [F.try_variant_get(F.col("_m")[f.name], "$", f.dataType.simpleString()).alias(f.name) for f in found[item].fields]
        rows = E._opened(d.filter(F.col("item") == item), "payload").select("_c", F.posexplode("_rows").alias("row_pos", "_v"))
        return found, rows.select("row_pos", E._by_name("_c", "_v").alias("_m")).select("row_pos", *cells)
    finally:
        E._plain_page = plain


def test_plain_pages_are_read_as_variants_are(spark):
    ok = [[1, "x", True, None], [None, "é\"\\\n", False, None], [-2 ** 63, "", None, None], [2 ** 63 - 1], [1, "y", True, None, 9]]
    odd = ['{"columns":["n","s","b","z"],"rows":[[1.5,"a",true,2]]}', '{"columns":["n","s"],"rows":[["7","a"]]}',
           '{"columns":["n"],"rows":[[9223372036854775808]]}', '{"columns":["n"],"rows":[[NaN]]}', "no envelope", "[]", "",
           '{"columns":["n"],"columns":["s"],"rows":[[3]]}', '{"columns":["n"],"rows":[[4],5]}', '{"columns":["n","o"],"rows":[[4,{"a":1}]]}',
           '{"columns":["n",3],"rows":[[8,9]]}', '{"columns":["n"],"rows":null}',
           '{"columns":["s"],"rows":[["\\ud83d\\ude00"],["\\ud800"]]}', '{"columns":["n"],"rows":[[10]]} ', "{'columns':['n'],'rows':[[11]]}",
           '{"columns":["q"],"rows":[]}', '{"rows":[[1]]}', '{"columns":["n"],"rows":[[1.50],[1e3],[true]]}']
    plain = {"columns": ["n", "s", "b", "z"], "rows": ok}
    for case in ([], odd[:1], odd[1:2], odd[2:10], odd):
        d = docs(spark, ("a", plain), *[("a", o) for o in case]).repartition(2)
        found, want = _by_variants(d, "a")
        assert E.discover(d) == found, case
        got = E.item_frame(d, "a", found["a"]).drop("item")
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), case
    null = spark.createDataFrame([("a", None)], "item string, payload string")
    assert E.discover(null) == {} and E.item_frame(null, "a", found["a"]).count() == 0


def test_plain_pages_do_not_pass_cell_by_cell_through_variants(spark):
    """Types of plain pages: a task hands on a row or two, however many pages and rows it read."""
    pages = [("a", {"columns": ["n", "s"], "rows": [[i, "x" if i % 2 else None] for i in range(50)]})] * 20
    thin = docs(spark, *pages).coalesce(1).mapInArrow(E._thinned, "item string, payload string").collect()
    assert [json.loads(r.payload) for r in thin] == [{"columns": ["n", "s"], "rows": [[1, ""]]}]


def test_row_texts_and_column_names_do_not_travel_with_the_rows(spark):
    """Names of columns are no column of the written rows, and the text of a row is made after the ranges are found."""
    from unittest import mock
    from fleetlens.operators import numbering

    df = spark.range(20).select(F.lit("d").alias("db"), "id", (F.col("id") * 2).alias("twice"))
    written = []
    with mock.patch.object(numbering, "write_once", lambda f, name: written.append(f) or f):
        E.pack([E.Item("x", df, ["id"])], KEYS, 10)
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert set(written[0].columns) == {"db", "item", "_i", "_row", "_g"}
    assert "to_json" not in plan[plan.index("RepartitionByExpression"):].lower()
