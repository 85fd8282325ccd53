"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are counted by encoded length (pre-aggregated before the shuffle);
the histogram has one row per distinct length, so suffix sums over it answer
totals, quantiles and truncated totals for every context limit without a look
at the documents.

Defined cases: null and empty texts have length 0; repeated rows count each;
an empty table gives an empty histogram; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe import codec, default_vocabulary
from fleetlens.llm.common import running_sums


def token_lengths(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens) by the byte-level vocabulary."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        enc = codec(path, pattern)
        for batch in batches:
            n = [len(enc.encode(t.as_py() or "")) // 4 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, dtype=np.int64))],
                                             names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length.

    n_docs, tokens: documents of this length and their tokens; docs_longer,
    tokens_longer: the suffix sums beyond it; truncated_total: tokens left if
    every document is cut to this length.
    """
    hist = (lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
            .withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    beyond = {"docs_longer": F.col("n_docs"), "tokens_longer": F.col("tokens")}
    up = {"docs_shorter": F.col("n_docs"), "tokens_shorter": F.col("tokens")}
    both = running_sums(running_sums(hist, [F.col("n_tokens").desc()], beyond), [F.col("n_tokens").asc()], up)
    return both.select(
        "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer",
        (F.col("tokens_shorter") + F.col("tokens") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("docs_shorter") + F.col("n_docs"))
         / (F.col("docs_shorter") + F.col("n_docs") + F.col("docs_longer"))).alias("share_up_to"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_total) for any context limits, from the histogram alone."""
    each = hist.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    return each.groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    each = hist.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    return each.filter("share_up_to >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
