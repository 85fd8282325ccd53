"""Connected components of a link table, as joins and aggregations.

Labels start at the smallest neighbour; each round takes the smallest label
among neighbours (pre-aggregated before its shuffle) and then jumps to the
label's own label.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label: the component's smallest node."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .filter("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                         .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        seen = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m")))
        low = materialise(labels.join(seen, F.col("node") == F.col("a"))
                          .select("node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "low")
        up = low.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = materialise(low.join(up, F.col("label") == F.col("_n"))
                          .select("node", F.least("label", "_l").alias("label"), "old"), "jump")
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
