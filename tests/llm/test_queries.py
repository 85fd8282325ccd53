"""The registered queries: names, columns, rows, and tables with every odd case."""

import pytest

from fleetlens.llm.queries import ORACLES, QUERIES
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    3: ["doc_id", "size", "source_size", "target", "taken"],
    4: ["doc_id", "fingerprint", "component_id"],
    5: ["doc_id", "held_out", "lang_pred", "score"],
    6: ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    7: ["n_tokens", "n_docs"],
    8: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    9: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    10: ["query_id", "rank", "vec_id", "score"],
    11: ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    12: ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
    13: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
}


@pytest.fixture(scope="module")
def odd(spark, edge_docs, sf_tables):
    path = sf_tables(edge_docs)
    spark.createDataFrame([(1, 1, 0.1), (5, 0, 0.2), (None, 1, None), (9, None, None), (9, 1, None)],
                          "doc_id long, quality int, score double").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(20, [1.0, 0.0], 1), (40, None, 2), (3, [0.5, 0.5], None), (None, [1.0, 1.0], 0)],
                          "vec_id long, embedding array<float>, rank int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (None, None, None, None), (2, 1, "tool", "")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, odd, name):
    n = int(name[2:].split("_")[0])
    out = QUERIES[name](spark, SF)
    assert out.columns[:len(COLUMNS[n])] == COLUMNS[n]
    rows = out.collect()
    if n not in (7, 10, 12, 13):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if n == 7:
        assert sum(r.n_docs for r in rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    strange = QUERIES[name](spark, odd).collect()
    assert n in (7, 10, 12, 13) or len(strange) == spark.read.parquet(f"{odd}/documents.parquet").count()


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF), ORACLES[name], duck(SF))
    assert ok, msg
