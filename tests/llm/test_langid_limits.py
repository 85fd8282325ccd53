import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import langid
from fleetlens.llm.common import crc_mod

STRANGE = "qxzj kwvq xxkj zzqy jjqx vvkk xqzt wkjq " * 20


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()


def outcome(spark, model, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.rejected for r in langid.identify(rows, model, [F.col("doc_id")]).orderBy("doc_id").collect()]


def test_a_rare_language_rejects_too(spark, docs):
    few = docs.filter("lang = 'de'").orderBy("doc_id").limit(12)
    model = langid.fit(docs.filter("lang <> 'de'").union(few))
    assert np.isfinite(model.limit).all() and np.isfinite(model.mean).all()
    assert outcome(spark, langid.fit(few), [STRANGE]) == [True]
    held = [r.text for r in docs.filter("lang = 'de'").join(few, "doc_id", "left_anti").collect()]
    assert np.mean(outcome(spark, model, held)) <= 0.05


def test_mislabelled_rows_do_not_loosen_the_limit(spark, docs):
    clean = docs.filter(crc_mod(F.col("doc_id"), 5) != 0)
    bad = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(50)) == 0
    model = langid.fit(clean.withColumn("text", F.when(bad, F.lit("日本語のテキスト" * 4)).otherwise(F.col("text"))))
    assert (model.limit <= 3 * langid.fit(clean).limit).all()
    assert outcome(spark, model, [STRANGE[:60]]) == [True]
