import math

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality
from fleetlens.llm.common import crc_mod


@pytest.fixture(scope="module")
def scored(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels.filter(~held).select("doc_id", F.col("quality").alias("label")))
    return model, docs, quality.score_documents(docs, model, [F.col("doc_id"), held.alias("held_out")]), labels


def test_held_out_accuracy(scored):
    _, docs, out, labels = scored
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert out.count() == docs.count() and len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_column_like_the_rules_by_hand(scored):
    model, docs, out, _ = scored
    assert 0 < len(model.rules) < 300 and model.describe()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in out.limit(200).collect():
        x = quality.statistics(text[r.doc_id].encode())
        z = model.intercept + sum(w for rule, w in model.rules
                                  if all((x[i] > at) == greater for i, greater, at in rule))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_statistics():
    x = dict(zip(quality.STATISTICS, quality.statistics(b"AB ab ab.\nc! | 12")))
    assert x["upper"] == 2 / 7 and x["adjacent_repeats"] == 0 and x["distinct_words"] == 1.0
    assert x["bangs"] == x["pipes"] == 1 / 6 and x["sentence_ends"] == 1 / 6
    assert set(quality.statistics(b" \n")) == {0.0}


@pytest.mark.parametrize("which", ["edge_docs", "empty_docs"])
def test_edge_cases(request, spark, scored, which):
    docs = request.getfixturevalue(which)
    out = quality.score_documents(docs, scored[0], [F.col("doc_id")]).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    for values, want in (([], 0.5), ([1, 1], 0.999), ([0], 0.001), ([None], 0.5)):
        labels = spark.createDataFrame([(1, v) for v in values], "doc_id long, label int")
        assert abs(1 / (1 + math.exp(-quality.fit(docs, labels).intercept)) - (want if which == "edge_docs" else 0.5)) < 1e-9
