"""Line deduplication with levelled sorted runs of line hashes.

A run is a table of (h, n), h the 128-bit MD5 of a line's key and n the number
of documents that have it, bucketed and sorted by h.  Each batch of documents
is merge-anti-joined with the runs: keys that a run already shows in
``settled`` documents need no further count and are left out.  What remains is
written as the batch's own run at level 0.  Where a level has ``fan`` runs,
they are merged into one run of the next level, so there are few runs and a
key is rewritten once a level.  Runs share one bucketing, so only the batch is
shuffled by a join.

A manifest (one small folder a version, written after its runs) names the
live runs and the batches that they hold: a job that lost its driver goes on
from the last version, and a batch added twice counts once.

Defined cases: a null or empty text is one empty line; a key is the line
without ASCII white space at both ends, A-Z lower-cased; empty keys are never
dropped; a key counts once for each row that has it, so repeated rows count
each; an empty table gives an empty result; further columns stay, but for
n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

import string
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise
from fleetlens.session import checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The MD5 of each line's key as text; null for empty keys."""
    def key(line: Column) -> Column:
        trimmed = F.btrim(line, F.lit(BLANKS))
        return F.when(trimmed != "", F.md5(trimmed.cast("binary")))

    return F.transform(lines_of(lower_ascii(text)), key)


def own_keys(docs: DataFrame, *columns: Column) -> DataFrame:
    """(columns, h): a row per document and different key in it."""
    keys = F.array_compact(F.array_distinct(line_keys(F.coalesce("text", F.lit("")))))
    return docs.select(*columns, F.explode(keys).alias("h")).withColumn("h", F.unhex("h"))


class LineRuns:
    """The runs of one index, below ``folder`` (by default a new one in the shared folder)."""

    def __init__(self, spark: SparkSession, settled: int, fan: int = 3, folder: str | None = None):
        self.spark, self.settled, self.fan = spark, settled, fan
        self.folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/llm-lines-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.batches, self.runs = 0, [], []
        try:
            found = spark.read.parquet(f"{self.folder}/manifest")
        except AnalysisException:  # a new index
            return
        last = found.groupBy().agg(F.max("version")).first()[0]
        for row in found.filter(F.col("version") == last).collect():  # one row a run
            self.version, self.batches, self.buckets = last, list(row.batches), row.buckets
            self.runs.append((row.level, self._register(row.path), row.path))

    def _register(self, path: str) -> str:
        name = f"llm_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (h BINARY, n BIGINT) USING parquet "
                       f"CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, run: DataFrame, level: int) -> tuple[int, str, str]:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"llm_run_{uuid.uuid4().hex}"
        (run.select("h", "n").repartition(self.buckets, "h").sortWithinPartitions("h").write.format("parquet")
         .option("path", path).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name))
        return level, name, path

    def _drop(self, runs: list) -> None:
        for _, name, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")  # of the catalog only: the files stay for readers of older versions

    def add(self, keys: DataFrame, batch: str) -> None:
        """Adds a batch (a row per document and key h); a batch that is already in does nothing."""
        if batch in self.batches:
            return
        own = keys.groupBy("h").agg(F.count("*").alias("n"))
        for _, name, _ in self.runs:
            known = self.spark.table(name).filter(F.col("n") >= self.settled)
            own = own.join(known.select("h").hint("merge"), "h", "left_anti")
        runs, old, level = [*self.runs, self._write(own, 0)], [], 0
        while len(same := [r for r in runs if r[0] == level]) >= self.fan:
            runs = [r for r in runs if r[0] != level] + [self._write(self._merged(same), level + 1)]
            old, level = old + same, level + 1
        self.version, self.batches, self.runs = self.version + 1, [*self.batches, batch], runs
        rows = [(r[0], r[2], self.buckets, self.batches) for r in runs]
        (self.spark.createDataFrame(rows, "level int, path string, buckets int, batches array<string>").coalesce(1)
         .write.parquet(f"{self.folder}/manifest/version={self.version}"))
        self._drop(old)

    def _merged(self, runs: list) -> DataFrame:
        """Runs as one: a merge join of the first two needs no exchange, each further one deals the merged side anew."""
        out, *rest = [self.spark.table(name) for _, name, _ in runs]
        for more in rest:
            both = out.join(more.select("h", F.col("n").alias("m")).hint("merge"), "h", "full_outer")
            out = both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def counts(self) -> DataFrame:
        """(h, n) over all runs; n is exact below ``settled`` and at least that much above."""
        return self._merged(self.runs)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (with a column h) that no run has."""
        for _, name, _ in self.runs:
            keys = keys.join(self.spark.table(name).select("h").hint("merge"), "h", "left_anti")
        return keys

    def close(self) -> None:
        self._drop(self.runs)


def frequent_lines(docs: DataFrame, min_docs: int, batches: int = 4, fan: int = 3) -> DataFrame:
    """Written table (h): keys found in ``min_docs`` documents or more; the documents are dealt into batches by id."""
    runs = LineRuns(docs.sparkSession, min_docs, fan)
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        runs.add(own_keys(docs.filter(dealt == b)), f"batch-{b}")
    out = materialise(runs.counts().filter(F.col("n") >= min_docs).select("h"), "frequent")
    runs.close()
    return out


def drop_lines(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """``docs`` with its text cut and n_lines, n_dropped added: lines whose key is in ``frequent`` (h) go.

    Equal texts lose equal lines, so the cut is made once per different text
    that has such a line and met by the text's MD5.
    """
    whole = F.coalesce("text", F.lit(""))
    name = F.unhex(F.md5(whole.cast("binary")))
    hit = materialise(own_keys(docs, name.alias("_t")).join(frequent, "h", "left_semi").select("_t").distinct(), "hit")
    texts = (docs.select(name.alias("_t"), whole.alias("text")).join(hit, "_t", "left_semi")
             .groupBy("_t").agg(F.first("text").alias("text")))
    pairs = F.arrays_zip(lines_of(F.col("text")).alias("line"), line_keys(F.col("text")).alias("key"))
    lines = texts.select("_t", F.posexplode(pairs).alias("pos", "p")).select(
        "_t", "pos", "p.line", F.unhex("p.key").alias("h"))
    kept = (lines.join(frequent, "h", "left_anti").groupBy("_t")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
            .select("_t", F.size("l").alias("_n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("_kept")))
    cut = materialise(hit.join(kept, "_t", "left").select(
        "_t", F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_kept", F.lit("")).alias("_kept")), "cut")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), name.alias("_t"), whole.alias("_whole"),
                       F.size(lines_of(whole)).cast("long").alias("n_lines")).join(cut, "_t", "left")
    text = F.coalesce("_kept", "_whole")
    return rows.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns
                         if c not in ("n_lines", "n_dropped")], "n_lines",
                       (F.col("n_lines") - F.coalesce("_n", "n_lines")).alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` without the lines found in ``min_docs`` documents or more, with n_lines and n_dropped."""
    return drop_lines(docs, frequent_lines(docs, min_docs))
