"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.session import checkpoint_dir

#: A word: a run without ASCII white space (the same set that ``bytes.split`` cuts at).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's shared folder and read it back.

    Cuts lineage with files that survive a lost executor; each call takes a
    folder of its own.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's text modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterator[tuple]], schema: str | StructType,
             batch_rows: int = 2000) -> DataFrame:
    """``mapInArrow`` over the rows of ``df`` as tuples; ``fn`` yields output tuples.

    ``fn`` sees one partition as a stream, so a task holds one Arrow batch and
    at most ``batch_rows`` finished rows.
    """
    fields = schema if not isinstance(schema, str) else df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)

        def rows():
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        out: list[tuple] = []

        def flush():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for row in fn(rows()):
            out.append(row)
            if len(out) >= batch_rows:
                yield flush()
                out.clear()
        if out:
            yield flush()

    return df.mapInArrow(run, fields)


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, per entry of ``sums``, the sum over all rows before this one in ``order``.

    No task sees all rows: rows are dealt by range, each range is summed, the
    range totals (one row per task) are accumulated, and a window inside each
    range does the rest.  ``order`` must be a total order up to equal rows.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
                        .withColumns({f"_v_{k}": v for k, v in sums.items()}), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (parts.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
              .select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums]))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.join(totals, "_range")
            .withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
            .drop("_range", *[f"_v_{k}" for k in sums], *[f"_b_{k}" for k in sums]))
