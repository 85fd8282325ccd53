"""The corpus pipeline: five stages over ``documents``, each written and reread before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents; the last returns each document's tokens.
A document that the mix takes several times comes several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, langid, mixing, pii, simhash
from fleetlens.llm.common import crc_mod, materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects (no letter, or like none of the languages)."""
    model = langid.fit(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    known = langid.identify(docs, model, [F.struct(*docs.columns).alias("_row")], whole=True)
    return known.filter(~F.col("rejected")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by fingerprints at 2 or fewer differing bits."""
    return simhash.keep_one_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources meet their target weights."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of each document, with the digest of what they decode to."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Language models, fingerprint classes and tokens have no SQL form; tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
