"""Files clustered along a space-filling curve, with a manifest of what each file holds.

Rows are ordered by the interleaved bits of their hour's, organisation's and
database's rank, so a file covers a small box of all three and a filter on any
of them prunes.  Files are ranges of (curve, row hash): a hot database of one
hour, whose rows share one point of the curve, is still many files, and rows
are counted nowhere beforehand.  After its files a batch writes its manifest
(per file: rows, smallest and largest keys, nulls), which makes the batch
visible as a whole; a batch that is written again replaces itself.

Null keys and times are kept: they have a rank of their own, before all others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.numbering import numbered
from fleetlens.sources.shared import write_once

BITS = 10           # of each dimension: 1024 steps


def interleave(ranks: list[Column], bits: int = BITS) -> Column:
    """Bits of the ranks in turn, the highest first."""
    out = F.lit(0).cast("bigint")
    for bit in reversed(range(bits)):
        for r in ranks:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(r, bit).bitwiseAND(1))
    return out


def spread(rows: DataFrame, name: str, op: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What ``op`` makes of ``rows``, written once and dealt by row hash.

    A batch that comes as one file of one row group is read by one task, and once only: all that follows
    reads the dealt files, in as many tasks as there are rows for.
    """
    return write_once(op(rows.repartition(F.xxhash64(*[F.col(c) for c in rows.columns]))), name)


def curve(rows: DataFrame, dims: Mapping[str, Column]) -> DataFrame:
    """Written table (_dim, _v, _step): the step on its dimension's axis of every different value of ``dims``.

    A value's step is 0 .. 2^BITS - 1 by its place among the different values of its column.  The table grows
    with the values, not with their combinations, which are almost as many as the rows.
    """
    values = reduce(lambda a, b: a.unionByName(b), [
        rows.select(F.lit(f"_d{i}").alias("_dim"), c.cast("string").alias("_v")) for i, c in enumerate(dims.values())]).distinct()
    place = write_once(numbered(values, ["_dim"], [F.col("_v").asc_nulls_first()]), "places")
    total = place.groupBy(F.col("_dim").alias("_of")).agg(F.max("position").alias("_n"))       # a row per dimension
    step = F.floor((F.col("position") - 1) * (1 << BITS) / F.col("_n")).cast("bigint")
    return write_once(place.join(F.broadcast(total), F.col("_dim") == F.col("_of")).select("_dim", "_v", step.alias("_step")),
                      "curve", folders=("_dim",))      # each dimension has its own size: small ones are broadcast


def clustered(rows: DataFrame, dims: Mapping[str, Column], before: tuple[str, ...] = (), z: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt and sorted by (``before``, curve of ``dims``, row hash); ``z``: the steps of ``curve``, if they are there."""
    columns = rows.columns
    z = curve(rows, dims) if z is None else z
    placed = rows.withColumn("_h", F.xxhash64(*[F.col(c) for c in columns]))
    for i, c in enumerate(dims.values()):
        own = z.filter(F.col("_dim") == f"_d{i}").select(F.col("_v").alias(f"_v{i}"), F.col("_step").alias(f"_s{i}"))
        placed = placed.join(own, c.cast("string").eqNullSafe(F.col(f"_v{i}"))).drop(f"_v{i}")
    placed = placed.select(*columns, "_h", interleave([F.col(f"_s{i}") for i in range(len(dims))]).alias("_z"))
    by = [*[F.col(c).asc_nulls_first() for c in before], F.col("_z"), F.col("_h")]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).select(*columns)


def write_clustered(df: DataFrame, path: str, dims: Mapping[str, Column], keys: Mapping[str, Column],
                    batch: str | None = None, rows_per_file: int = 5_000_000) -> str:
    """Adds ``df`` as parquet files below ``path``; returns the batch's name.

    ``keys``: what the manifest holds per file (name -> column).  Names of
    batches are the caller's; one that is used again replaces its files.
    """
    batch = batch or uuid.uuid4().hex
    text = {name: F.col(f"_k{i}") for i, name in enumerate(dims)}      # times become text once, not in every pass
    rows = spread(df, "batch", lambda d: d.withColumns({f"_k{i}": c.cast("string") for i, c in enumerate(dims.values())}))
    (clustered(rows, text).select(*df.columns).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
     .parquet(f"{path}/data/batch={batch}"))
    files = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data/batch={batch}")
    stats = [x for k, c in keys.items() for x in (F.min(c).alias(f"min_{k}"), F.max(c).alias(f"max_{k}"),
                                                  F.count_if(c.isNull()).alias(f"nulls_{k}"))]
    manifest = files.withColumn("_file", F.col("_metadata.file_path")).groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), *stats)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/batch={batch}")
    return batch


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """The files of all finished batches: one row each."""
    return spark.read.parquet(f"{path}/_manifest")


def may_hold(name: str, low=None, high=None) -> Column:
    """Files that may hold values of a key in [low, high] (an open end: None)."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(f"max_{name}") >= low)
    if high is not None:
        out = out & (F.col(f"min_{name}") <= high)
    return out


def read_clustered(spark: SparkSession, path: str, where: Column | None = None, all_columns: bool = False) -> DataFrame:
    """The rows of the files that ``where`` keeps in the manifest: only those are opened.

    The file names come to the driver, as for every read of files.  Batches may
    differ in their columns (server versions): ``all_columns`` gives the union
    of the column sets found in the files, null where a file lacks one.
    """
    found = manifest_of(spark, path)
    schema = spark.read.option("mergeSchema", all_columns).parquet(f"{path}/data").drop("batch").schema
    files = [r.file for r in (found if where is None else found.filter(where)).select("file").collect()]
    reader = spark.read.schema(schema)
    return reader.parquet(*files) if files else spark.createDataFrame([], schema)


def compact_clustered(spark: SparkSession, path: str, dims: Mapping[str, Column], keys: Mapping[str, Column],
                      batch: str | None = None, rows_per_file: int = 5_000_000) -> str:
    """All batches as one new batch on one curve; the old ones leave the manifest after it is complete."""
    old = [r.batch for r in manifest_of(spark, path).select("batch").distinct().collect()]
    new = write_clustered(read_clustered(spark, path), path, dims, keys, batch, rows_per_file)
    empty = spark.createDataFrame([], manifest_of(spark, path).drop("batch").schema)
    for name in old:
        if name != new:
            empty.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/batch={name}")
    return new
