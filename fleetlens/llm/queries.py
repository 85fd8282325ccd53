"""The queries of the training-data operators and their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import ann, bpe, collocations, langid, line_runs, minhash, mixing, ngram_lm, pii, quality, repair, simhash, token_counts
from fleetlens.llm.common import crc_mod, table


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels.filter(~held))
    return quality.score_documents(docs, model, [F.col("doc_id"), held.alias("held_out")])


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(table(spark, sf_dir, "documents"))
    taken = mixing.take_mix(sizes, mixing.plan_mix(sizes))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs, model, [F.col("doc_id"), held.alias("held_out")])


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", minhash.hex_digits(F.col("sig")).alias("fingerprint"),
                        minhash.hex_digits(F.col("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents")))


def op8_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_projected_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_report(table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_rule_ensemble, op2_backoff_lm, op3_pareto_mix, op4_simhash, op5_kneser_ney_langid, op6_minhash, op7_token_counts, op8_semi_markov_pii, op9_byte_bpe,
                                   op10_projected_kd_tree, op11_line_runs, op12_conversation_repair, op13_phrase_collocations)}

# The other operators learn, hash or tokenise in ways that SQL has no form for; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op3_pareto_mix": r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(text, '')) AS th
  FROM documents),
src AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source)),
ratios AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM src),
levels AS (
  SELECT source, ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM ratios WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, source NULLS LAST LIMIT 1) AS reached),
goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM (SELECT r.*, coalesce(least(cap, w * final.reached), cap) AS target FROM ratios r CROSS JOIN final)),
docs AS (
  SELECT s.*, source_size, target, whole, target - whole * source_size AS rest,
    CASE WHEN source_size > 0 THEN target / source_size - whole ELSE 0 END AS p,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), th)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) * ((1 - p) / p) END AS odds FROM docs),
same AS (
  SELECT source, odds, doc_id, size, th, rest, count(*) AS m, CAST(sum(size) AS BIGINT) AS words
  FROM ranked WHERE p > 0 AND size > 0 GROUP BY ALL),
extra AS (
  SELECT source, doc_id, size, th, greatest(0, least(m, floor((rest - size / 2 - coalesce(sum(words) OVER (
    PARTITION BY source ORDER BY odds, doc_id NULLS FIRST, size, th
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / size) + 1)) AS take FROM same)
SELECT d.doc_id, d.size, d.source_size, d.target,
  CAST(d.size * (d.whole + CASE WHEN e.take >= row_number() OVER (PARTITION BY d.source, d.doc_id, d.size, d.th) THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM docs d LEFT JOIN extra e ON d.source IS NOT DISTINCT FROM e.source AND d.doc_id IS NOT DISTINCT FROM e.doc_id
  AND d.size = e.size AND d.th = e.th""", "op11_line_runs": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
frequent AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN frequent f ON k.key = f.key GROUP BY r"""}
