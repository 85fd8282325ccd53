"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each whole text (shares of characters and words, repetition,
   lines) are plain columns.
2. A random forest of shallow trees is grown on a bounded sample of labelled
   rows (``SAMPLE_ROWS``, lowest by a hash of the id); every path from a root
   to a node is a rule: a conjunction of ``statistic <= x`` and ``> x``.
3. A logistic regression with lasso penalty over the rules' truth values
   keeps few of them.
4. The kept rules are compiled into one Spark column expression, so scoring
   is a projection over the statistics.

Defined cases: null texts count as empty, whose statistics are zero; labels
that are null teach nothing; several labels of one document count each;
without labels of both classes the score is the labels' share (0.5 without
labels); repeated rows are scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import operator
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAMPLE_ROWS, TREES, DEPTH, PENALTY, PREDICT_AT = 20_000, 40, 3, 0.001, 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:?'\"()-"
_SYMBOL = b"#$%&*+/<=>@\\^_`{}~[]"
_HIGH = bytes(range(128, 256))

STATISTICS = ("log_words", "word_length", "longest_word", "upper", "letters", "digits", "stops", "symbols", "bangs",
              "pipes", "high", "lines_per_word", "distinct_words", "top_word", "adjacent_repeats", "short_words",
              "symbol_ends", "line_repeats", "sentence_ends")


def statistics(data: bytes) -> tuple[float, ...]:
    """The statistics of one text's UTF-8 bytes, in the order of STATISTICS."""
    from math import log1p

    words = data.split()
    n, k = len(data), len(words)
    if not k:
        return (0.0,) * len(STATISTICS)

    def share(chars: bytes) -> float:
        return (n - len(data.translate(None, chars))) / n

    upper, lower, high = share(_UPPER), share(_LOWER), share(_HIGH)
    lengths = list(map(len, words))
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    return (
        log1p(k), sum(lengths) / k, log1p(max(lengths)), upper / (upper + lower) if upper + lower else 0.0,
        upper + lower + high, share(_DIGIT), share(_STOPS), share(_SYMBOL), data.count(b"!") / k, data.count(b"|") / k,
        high, len(lines) / k, len(count) / k, max(count.values()) / k,
        sum(map(operator.eq, words, words[1:])) / k, sum(x <= 3 for x in lengths) / k,
        sum(ends[c] for c in _SYMBOL + b"!|") / k, 1 - len(set(lines)) / len(lines), ends[ord(".")] / k)


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``."""
    kept = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = StructType(list(kept.schema.fields[:-1]))
    for name in STATISTICS:
        schema = schema.add(name, "double")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = [statistics(t or b"") for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.float64()) for c in zip(*rows))],
                                                 names=schema.names)

    return kept.mapInArrow(run, schema)


Condition = tuple[int, bool, float]  # statistic, greater (else at most), threshold


def tree_paths(root) -> list[frozenset[Condition]]:
    """The conditions on the way to every node below a tree's root."""
    out, todo = [], [(root, frozenset())]
    while todo:
        node, path = todo.pop()
        if path:
            out.append(path)
        if node.numDescendants() > 0:
            split = node.split()
            at, x = split.featureIndex(), split.threshold()
            todo += [(node.leftChild(), path | {(at, False, x)}), (node.rightChild(), path | {(at, True, x)})]
    return out


def rule_column(rule: frozenset[Condition]) -> Column:
    parts = [F.col(STATISTICS[i]) > x if greater else F.col(STATISTICS[i]) <= x for i, greater, x in sorted(rule)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


class RuleEnsemble:
    """Intercept and weighted rules; without rules a constant score."""

    def __init__(self, intercept: float, rules: list[tuple[frozenset[Condition], float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The compiled score, 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[i]} {'>' if g else '<='} {x:.4g}" for i, g, x in sorted(r))
                for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """The ensemble from (doc_id, text) and (doc_id, label) rows; label is 0, 1 or null."""
    from math import log

    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    known = labels.filter("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = (known.filter(unit < 1.2 * sample_rows / max(1, known.count()))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows))
    texts = docs.select("doc_id", "text")
    sample = with_statistics(texts.join(F.broadcast(chosen), "doc_id"),  # at most sample_rows small rows
                             [F.col("doc_id"), F.col("label")])
    # A fixed layout, so that the forest's draws do not depend on the input's.
    sample = sample.repartition(4, "doc_id").sortWithinPartitions("doc_id", "label", *STATISTICS).cache()
    found = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(found) < 2:
        share = 0.5 if not found else min(max(next(iter(found)), 0.001), 0.999)
        sample.unpersist()
        return RuleEnsemble(log(share / (1 - share)), [])
    vector = array_to_vector(F.array(*[F.col(s) for s in STATISTICS]))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=1,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(
        sample.select("label", vector.alias("x")))
    rules = sorted({p for tree in forest.trees for p in tree_paths(tree._call_java("rootNode"))}, key=sorted)
    if not rules:
        share = found.get(1.0, 0) / sum(found.values())
        sample.unpersist()
        return RuleEnsemble(log(share / (1 - share)), [])

    def truth(batches):
        import numpy as np

        for batch in batches:
            x = np.array([np.asarray(c) for c in batch.columns[1:]])
            on = np.ones((batch.num_rows, len(rules)))
            for j, rule in enumerate(rules):
                for i, greater, at in rule:
                    on[:, j] *= (x[i] > at) if greater else (x[i] <= at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(on), pa.list_(pa.float64()))],
                                             names=["label", "on"])

    held = sample.select("label", *STATISTICS).mapInArrow(truth, "label double, on array<double>").select(
        "label", array_to_vector("on").alias("x"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY,
                               maxIter=60).fit(held)
    sample.unpersist()
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9])


def score_documents(docs: DataFrame, model: RuleEnsemble, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with score and predicted for every row of ``docs``."""
    rows = with_statistics(docs, keep)
    names = rows.columns[:len(rows.columns) - len(STATISTICS)]
    return rows.select(*names, model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= PREDICT_AT).cast("int"))
