"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every document of a source is expected ``e = target / source size`` times in
the mix.  ``floor(e)`` whole copies are certain; one more copy goes to a
Pareto order sample with inclusion probability ``p = e - floor(e)``: documents
are ranked by ``(u / (1 - u)) / (p / (1 - p))``, u a uniform number hashed from
the id, and taken in that order until the source's remaining words are
reached (the last one only if that brings the total nearer).  A null id is
replaced by the text's hash; rows equal in id, size and text are taken one by one.

Hot sources: nothing gathers a source in one task.  Each source's documents
are cut into about ``sqrt(n)`` intervals of u, the intervals are summed before
the shuffle, and only the one interval where the words run out is ranked.

Defined cases: null or blank text has size 0 and is taken 0 words; a null
source is a source of its own, after all others; an empty table gives an
empty mix; rows with one id go by size, then text hash; of rows equal in all
of these as many are taken as there is room for; further columns are ignored
by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, running_sums, word_count

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def uniform(doc_id: Column, text_hash: Column) -> Column:
    """A number in (0, 1) that depends on the id alone (the text's hash where it is null): 48 bits of an MD5."""
    key = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), text_hash))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(2 ** 48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Shares follow the weights by source order; a source is capped at ``cap``
    times its size and the excess reshared.  Sorted by cap / weight the capped
    sources are a prefix, so the final level is found with running sums.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = running_sums(src, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(cap))
              .withColumn("ratio", F.col("cap") / F.col("w")))
    ranked = materialise(ranked, "ranked")
    total = ranked.agg(F.sum("source_size").alias("_all"), F.sum("w").alias("_w"))
    level = (running_sums(ranked, [F.col("ratio"), F.col("source").asc_nulls_last()],
                          {"cap_before": F.col("cap"), "w_before": F.col("w")})
             .crossJoin(F.broadcast(total))  # one row
             .withColumn("level", (F.col("_all") - F.col("cap_before")) / (F.col("_w") - F.col("w_before")))
             # The first source in this order that is not capped; equal ratios go by what is before them.
             .agg(F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "cap_before", "level")))
                  .getField("level").alias("level")))
    return (ranked.crossJoin(F.broadcast(level))  # one row
            .withColumn("target", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")))
            .select("source", "source_size", "n_docs", "target"))


def _order(u: Column, p: Column) -> Column:
    """Pareto rank: random odds over inclusion odds (p = 0 ranks last)."""
    return F.when(p > 0, (u / (1 - u)) * ((1 - p) / p)).otherwise(F.lit(float("inf")))


def plan_mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """One row per source: target, certain copies and the last rank that is taken.

    ``sizes`` has doc_id, source, size, text_hash and should be a written table:
    it is read a few times.
    """
    goals = materialise(
        source_targets(sizes, weights, cap)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(0).cast("long"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("copies"))
                    .otherwise(0.0))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .withColumn("cells", F.ceil(F.sqrt("n_docs"))), "goals")
    g = goals.select(F.col("source").alias("_s"), "p", "rest", "cells")
    placed = (sizes.select("doc_id", "source", "size", "text_hash")
              .withColumn("u", uniform(F.col("doc_id"), F.col("text_hash")))
              .join(g, F.col("source").eqNullSafe(F.col("_s")))
              .filter("p > 0 and size > 0")
              .withColumn("cell", F.floor(F.col("u") * F.col("cells")))
              .select("doc_id", "source", "size", "text_hash", "u", "p", "rest", "cell"))
    cells = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    edge = materialise(
        cells.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .filter("before <= rest and before + words > rest")
        .select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "before"), "edge")
    inside = (placed.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
              .withColumn("rank", _order(F.col("u"), F.col("p")))
              .groupBy("source", "_c", "rank", "doc_id", "size", "text_hash", "rest", "before")
              .agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")))
    upto = (Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size", "text_hash")
            .rowsBetween(Window.unboundedPreceding, -1))
    room = (F.col("rest") - F.col("cum") - F.col("size") / 2) / F.col("size")
    last = (inside.withColumn("cum", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .withColumn("take", F.least(F.col("rows"), F.floor(room) + 1)).filter("take > 0")
            .groupBy("source").agg(F.max(F.struct("rank", F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("id"), "size",
                                                  "text_hash", "take", "rows")).alias("last"))
            .select(F.col("source").alias("_l"), "last"))
    c = edge.select(F.col("_s").alias("_e"), "_c")
    return materialise(goals.join(last, F.col("source").eqNullSafe(F.col("_l")), "left")
                       .join(c, F.col("source").eqNullSafe(F.col("_e")), "left")
                       .select("source", "source_size", "target", "copies", "p", "cells", "_c", "last"), "plan")


def take_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target, copies (whole copies in the mix) and taken (words) to rows with size and text_hash."""
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", F.col("copies").alias("_k"), "p", "cells",
                    F.col("_c"), "last")
    u = uniform(F.col("doc_id"), F.col("text_hash"))
    row = F.struct(_order(u, F.col("p")).alias("rank"), F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("id"),
                   F.col("size").alias("size"), F.col("text_hash").alias("text_hash"))
    end = F.struct(*[F.col("last")[n].alias(n) for n in ("rank", "id", "size", "text_hash")])
    cell = F.floor(u * F.col("cells"))
    at_end = (cell == F.col("_c")) & F.coalesce(row == end, F.lit(False))
    drawn = (F.col("p") > 0) & (F.col("size") > 0)
    extra = drawn & (F.col("_c").isNull() | (cell < F.col("_c")) | ((cell == F.col("_c")) & F.coalesce(row <= end, F.lit(False))))
    placed = (docs.join(p, F.col("source").eqNullSafe(F.col("_s")))
              .withColumns({"_extra": extra, "_part": drawn & at_end & (F.col("last.take") < F.col("last.rows"))}))
    if not plan.filter("last.take < last.rows").isEmpty():
        # Only some of the equal rows at a source's end are taken: they are numbered, over all tasks.
        ends = running_sums(placed.filter("_part"), [F.col("source").asc_nulls_last()], {"_n": F.lit(1)})
        first = ends.groupBy(F.col("source").alias("_f")).agg(F.min("_n").alias("_first"))
        ends = (ends.join(first, F.col("source").eqNullSafe(F.col("_f")))
                .withColumn("_extra", F.col("_n") - F.col("_first") < F.col("last.take")).drop("_f", "_first", "_n"))
        placed = placed.filter(~F.col("_part")).unionByName(ends)
    return (placed.withColumn("copies", F.when(F.col("size") > 0, F.col("_k") + F.when(F.col("_extra"), 1).otherwise(0))
                              .otherwise(0).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size"))
            .drop("_s", "_k", "p", "cells", "_c", "last", "_extra", "_part"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """Written table (doc_id, source, size, text_hash) of all documents."""
    return materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_hash()), "sizes")


def text_hash() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document repeated ``copies`` times, columns unchanged."""
    columns = docs.columns
    plan = plan_mix(document_sizes(docs))
    slim = docs.select("doc_id", "source", F.struct(*columns).alias("_row"),
                       word_count(F.col("text")).alias("size"), text_hash())
    taken = take_mix(slim, plan).filter("copies > 0")
    return (taken.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("_row.*"))
