"""Envelope documents: many items packed at once, and typed frames without a column list.

A landed item is ``{"columns": [...], "rows": [[...], ...]}`` with JSON values.
``discover`` finds the columns and types of every item in the documents
themselves (types are merged over all rows by ``schema_of_variant_agg``, a
partial aggregate), as a reader of a new server version must: which columns a
``SELECT *`` item has is known to the server only.

Defined cases: a column that some documents lack is null in their rows; rows
shorter than the columns are null at the end and longer ones are cut; a column
that is null everywhere is text; values of different kinds are read as text; a
payload that is no envelope has no rows; an item without rows keeps its columns.

Documents are read as variants.  Those that hold whole numbers, flags, text and
nulls alone, as most do, are read page by page in Arrow batches instead, to the
same rows; every other document, malformed ones too, goes by the variants.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.expr import space_timestamp
from fleetlens.operators.numbering import numbered
from fleetlens.sources.shared import write_once


# ------------------------------------------------------------------ packing ----
@dataclass(frozen=True)
class Item:
    """One item of a document: its rows, their order and the columns (by default all but the keys)."""

    name: str
    df: DataFrame
    order: Sequence[str]
    columns: Sequence[str] = field(default_factory=tuple)

    def names(self, keys: Sequence[str]) -> list[str]:
        return list(self.columns) or [c for c in self.df.columns if c not in keys]


def order_column(name: str) -> Column:
    """A column of an order list; ``!name`` puts true before false."""
    return ~F.col(name[1:]) if name.startswith("!") else F.col(name)


def _cell(c: Column, kind: T.DataType) -> Column:
    """A value as the posted JSON has it: numbers and flags as such, dates and exact decimals as text."""
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        c = space_timestamp(c)
    elif isinstance(kind, (T.DateType, T.DecimalType)):
        c = c.cast("string")
    return c


def _flat(kinds: Sequence[T.DataType]) -> bool:
    return all(isinstance(k, (T.IntegralType, T.BooleanType, T.StringType)) for k in kinds)


def _values(cells: Sequence[Column], kinds: Sequence[T.DataType]) -> Column:
    """A row's values: an object of equal names where they are flat, else variants."""
    if not _flat(kinds):
        return F.array(*[c.cast("variant") for c in cells])
    return F.struct(*[c.alias("k") for c in cells])


def _values_text(values: Column, kinds: Sequence[T.DataType]) -> Column:
    """JSON text of ``_values``: a list."""
    if not _flat(kinds):
        return F.to_json(values)
    # An object of flat values is written several times faster than variants; its names are taken out again.  Inside
    # a text a quote has a backslash before it, so a quoted name before a colon is found nowhere else.
    named = F.to_json(values, {"ignoreNullFields": "false"})
    return F.concat(F.lit("["), F.rtrim(F.ltrim(F.replace(named, F.lit('"k":'), F.lit("")), F.lit("{")), F.lit("}")), F.lit("]"))


def _row(cells: Sequence[Column], kinds: Sequence[T.DataType]) -> Column:
    return _values_text(_values(cells, kinds), kinds)


def _slots(df: DataFrame, order: Sequence[str]) -> list[tuple[str, Column]]:
    """(kind, value) per order column: whole numbers, real numbers or text, so that items of all types sort together."""
    out = []
    for o in order:
        c = order_column(o)
        kind = df.select(c).schema[0].dataType
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            out.append(("bigint", c.cast("bigint")))
        elif isinstance(kind, (T.FractionalType,)):
            out.append(("double", c.cast("double")))
        else:
            out.append(("string", c.cast("string")))
    return out


def pack(items: Sequence[Item], keys: Sequence[str], page_rows: int, typed: bool = True) -> DataFrame:
    """(keys, item, page, n_rows, payload): the rows of all items in their order, ``page_rows`` to a page.

    The items are one union that is numbered once.  ``typed`` keeps JSON types;
    otherwise every value is text.  Rows travel as values; their text is
    written when they are in place, and column names once a page.
    """
    keys = list(keys)
    slots = [_slots(i.df, i.order) for i in items]
    used = sorted({(at, kind) for own in slots for at, (kind, _) in enumerate(own)})
    frames, texts, columns = [], [], []
    for i, (item, own) in enumerate(zip(items, slots)):
        names, kinds = item.names(keys), {f.name: f.dataType for f in item.df.schema.fields}
        value = dict(((at, kind), c) for at, (kind, c) in enumerate(own))
        cells = [_cell(F.col(n), kinds[n]) if typed else F.col(n).cast("string") for n in names]
        types = [f.dataType for f in item.df.select(*cells).schema.fields]
        frames.append(item.df.select(
            *keys, F.lit(item.name).alias("item"), F.lit(i).alias("_i"),
            *[value.get(slot, F.lit(None)).cast(slot[1]).alias(f"_o{slot[0]}{slot[1]}") for slot in used],
            _values(cells, types).alias(f"_v{i}")))
        texts.append(F.when(F.col("_i") == i, _values_text(F.col(f"_v{i}"), types)))
        columns.append(F.to_json(F.array(*[F.lit(n) for n in names])))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    order = [F.col(f"_o{at}{kind}").asc_nulls_first() for at, kind in used]
    rows = numbered(rows, [*keys, "item"], order, placed=[*keys, "item", "_i", F.coalesce(*texts).alias("_row")])
    page = F.floor((F.col("position") - 1) / F.lit(page_rows)).cast("bigint")
    g = rows.groupBy(*keys, "item", page.alias("page")).agg(
        F.first("_i").alias("_i"), F.count(F.lit(1)).alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("position", "_row"))).alias("_l"))
    payload = F.concat(F.lit('{"columns":'), F.get(F.array(*columns), "_i"), F.lit(',"rows":['),
                       F.array_join(F.transform("_l", lambda e: e["_row"]), ","), F.lit("]}"))
    return g.select(*keys, "item", "page", "n_rows", payload.alias("payload"))


# -------------------------------------------------------------- plain pages ----
#: Types that a plain page's cells are read to without variants, with the Python type that alone gives them.
PLAIN = {"bigint": (int, pa.int64()), "boolean": (bool, pa.bool_()), "string": (str, pa.string())}
_NULL = type(None)


class _NotPlain(ValueError):
    """The page needs variants."""


def _not_plain(_: str) -> None:
    raise _NotPlain


#: A real number's digits and a repeated name matter to variants: numbers but whole ones are refused, objects come as lists.
_DECODER = json.JSONDecoder(parse_float=_not_plain, parse_constant=_not_plain, object_pairs_hook=list)


def _plain_page(payload: str | None) -> tuple[list[str], int, list[tuple]]:
    """Column names, number of rows and values by column; ``_NotPlain`` if the text is more than a list of names and rows."""
    try:
        pairs = _DECODER.decode(payload)
        found = dict(pairs)
        names, rows = found["columns"], found["rows"]
    except (ValueError, TypeError, KeyError, RecursionError):
        raise _NotPlain from None
    if (len(found) < len(pairs) or type(names) is not list or type(rows) is not list or len(set(map(str, names))) < len(names)
            or not set(map(type, names)) <= {str} or not set(map(type, rows)) <= {list}):
        raise _NotPlain
    cells = list(zip_longest(*rows)) if set(map(len, rows)) - {len(names)} else list(zip(*rows))
    cells += [(None,) * len(rows)] * (len(names) - len(cells))
    return names, len(rows), cells[:len(names)]


#: A value of each type that plain cells have besides null: all that a merge of their types needs.
_SAMPLES = {int: 1, bool: True, str: ""}


def _kinds(cells: Sequence) -> set[type]:
    """The types among ``cells``, without null's."""
    kinds = set(map(type, cells))
    if int in kinds:
        whole = cells if len(kinds) == 1 else [c for c in cells if type(c) is int]
        if min(whole) < -2 ** 63 or max(whole) >= 2 ** 63:
            raise _NotPlain
    if not kinds <= {int, bool, str, _NULL}:
        raise _NotPlain
    return kinds - {_NULL}


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (item, payload) of the same columns and types: a task's plain pages of one item and column list are one
    document with a row or two, any other page stays whole."""
    def out(item: str | None, payload: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([payload], pa.string())], names=["item", "payload"])

    found: dict[tuple, list[set[type]]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            item, payload = (batch.column(c)[i].as_py() for c in range(2))
            try:
                names, _, cells = _plain_page(payload)
                payload.encode()
                page = [_kinds(c) for c in cells]
                "".join(names).encode()
            except (_NotPlain, UnicodeEncodeError):
                yield out(item, payload)
                continue
            known = found.setdefault((item, *names), [set() for _ in names])
            for own, kinds in zip(known, page):
                own |= kinds
    for (item, *names), known in found.items():
        samples = [[v for kind, v in _SAMPLES.items() if kind in own] for own in known]
        yield out(item, json.dumps({"columns": names, "rows": list(zip_longest(*samples))}, ensure_ascii=False))


def _plain_reader(fields: Sequence[tuple[str, str]], n_keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads pages (kept columns, payload) to (kept columns, _at, a column per plain field, _rest): a plain page gives its
    rows with ``_at``, any other one row with the payload in ``_rest``.  ``fields``: (name, type)."""

    def cells_of(payload: str | None) -> tuple[int, list[pa.Array]]:
        names, n, cells = _plain_page(payload)
        own, out = dict(zip(names, cells)), []
        for name, kind in fields:
            values = own.get(name, (None,) * n)
            python, arrow = PLAIN.get(kind, (_NULL, None))
            if not set(map(type, values)) <= {python, _NULL}:
                raise _NotPlain
            if arrow is not None:
                try:
                    out.append(pa.array(values, arrow))
                except (ValueError, OverflowError):     # no long, or text that is no Unicode
                    raise _NotPlain from None
        return n, out

    plain = [PLAIN[kind][1] for _, kind in fields if kind in PLAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:n_keep], "_at", *[f"_cell{i}" for i in range(len(plain))], "_rest"]
            for i in range(batch.num_rows):
                payload = batch.column(n_keep)[i].as_py()
                try:
                    n, cells = cells_of(payload)
                    at, rest = pa.array(np.arange(n, dtype="int32")), pa.nulls(n, pa.string())
                except _NotPlain:
                    n, cells, at, rest = 1, [pa.nulls(1, t) for t in plain], pa.nulls(1, pa.int32()), pa.array([payload], pa.string())
                if n:
                    same = pa.array(np.full(n, i, "int32"))
                    kept = [batch.column(k).take(same) for k in range(n_keep)]
                    yield pa.RecordBatch.from_arrays([*kept, at, *cells, rest], names=names)

    return run


# ---------------------------------------------------------------- discovery ----
def _opened(docs: DataFrame, payload: str) -> DataFrame:
    keep = [c for c in docs.columns if c != payload]
    v = F.try_parse_json(payload)
    return docs.select(*keep, F.try_variant_get(v, "$.columns", "array<string>").alias("_c"),
                       F.try_variant_get(v, "$.rows", "array<array<variant>>").alias("_rows"))


def _by_name(columns: str, row: str) -> Column:
    pairs = F.arrays_zip(F.col(columns).alias("c"), F.col(row).alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda e: e["c"].isNotNull()))


def envelope_schema(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """(item, position, column, type) of every item in ``docs`` (item, payload): types merged over all rows.

    Columns come in the order of the first column list (in text order) that
    has them, so servers of several versions give one order.
    """
    pages = docs.select("item", F.col(payload).alias("payload"))
    d = _opened(write_once(pages.mapInArrow(_thinned, "item string, payload string"), "envelope_kinds"), "payload")
    shapes = d.filter(F.col("_c").isNotNull()).groupBy("item", "_c").agg(F.count(F.lit(1)).alias("n"))
    names = (shapes.select("item", "_c", F.posexplode("_c").alias("at", "column"))
             .groupBy("item", "column").agg(F.min(F.struct("_c", "at")).alias("first")))
    rows = d.select("item", "_c", F.explode("_rows").alias("_v"))
    # One value a row and column: types are merged per (item, column), so no object of all columns is built.
    cells = rows.select("item", F.explode(_by_name("_c", "_v")).alias("column", "value"))
    types = cells.groupBy("item", "column").agg(F.schema_of_variant_agg("value").alias("type"))
    kind = F.when(F.col("type").isNull() | F.col("type").isin("VOID", "VARIANT"), "STRING").otherwise(F.col("type"))
    # A column list and a place in it are the item's order; the number of columns is the server's, not the data's.
    at = Window.partitionBy("item").orderBy("first", "column")
    return names.join(types, ["item", "column"], "left").select(
        "item", F.row_number().over(at).alias("position"), "column", kind.alias("type"))


def discover(docs: DataFrame, payload: str = "payload") -> dict[str, T.StructType]:
    """Schema of every item of ``docs``: one small row per item and column comes to the driver."""
    found = envelope_schema(docs, payload).orderBy("item", "position").collect()
    out: dict[str, T.StructType] = {}
    for r in found:
        kind = T._parse_datatype_string("struct<x:" + r["type"].replace("OBJECT<", "struct<") + ">")["x"].dataType
        out.setdefault(r["item"], T.StructType()).add(r["column"], kind)
    return out


def item_frame(docs: DataFrame, item: str, schema: T.StructType, payload: str = "payload") -> DataFrame:
    """The rows of one item with its discovered columns (row_pos: the row's place in its document)."""
    keep = [c for c in docs.columns if c != payload]
    fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    plain = [(name, kind) for name, kind in fields if kind in PLAIN]
    shape = T.StructType([*docs.select(*keep).schema.fields, T.StructField("_at", T.IntegerType()),
                          *[T.StructField(f"_cell{i}", T._parse_datatype_string(kind)) for i, (_, kind) in enumerate(plain)],
                          T.StructField("_rest", T.StringType())])
    pages = docs.filter(F.col("item") == item).select(*keep, payload)
    read = pages.mapInArrow(_plain_reader(fields, len(keep)), shape)
    # Rows of plain pages are complete; a page in _rest is opened here.
    rows = _opened(read, "_rest").select(*keep, "_at", *[f"_cell{i}" for i in range(len(plain))], "_c",
                                         F.posexplode_outer("_rows").alias("_pos", "_v"))
    rows = rows.filter(F.col("_at").isNotNull() | F.col("_pos").isNotNull())
    m = rows.select("*", _by_name("_c", "_v").alias("_m"))
    place = {name: i for i, (name, _) in enumerate(plain)}
    cells = []
    for name, kind in fields:
        cell = F.try_variant_get(F.col("_m")[name], "$", kind)
        if name in place:
            cell = F.when(F.col("_at").isNotNull(), F.col(f"_cell{place[name]}")).otherwise(cell)
        cells.append(cell.alias(name))
    return m.select(*keep, F.coalesce("_at", "_pos").alias("row_pos"), *cells)


def item_frames(docs: DataFrame, payload: str = "payload") -> dict[str, DataFrame]:
    """A typed frame for every item found in ``docs``, which are written once."""
    docs = write_once(docs, "envelopes")
    return {item: item_frame(docs, item, schema, payload) for item, schema in discover(docs, payload).items()}
