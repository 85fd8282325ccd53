import math

import numpy as np
import pytest

from fleetlens.llm import ann


def brute(rows, queries, k):
    """{query: [(vec_id, score)]} over all rows."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for qid, q in queries:
        s = [(-math.fsum((v * np.asarray(q, dtype=np.float64)).tolist()), int(i)) for i, v in zip(ids, x) if i != qid]
        out[qid] = [(i, -s) for s, i in sorted(s)[:k]]
    return out


def ranked(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("chunk", [256, 4096])
def test_recall(spark, monkeypatch, chunk):
    monkeypatch.setattr(ann, "CHUNK_ROWS", chunk)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ranked(ann.nearest(df, df.filter("vec_id % 20 = 0"), 20))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    score = {(q, r[0]): None for q in got for r in rows}
    assert all(len(v) == 20 and (q, i) in score for q, v in got.items() for i, _ in v)
    vec = dict(rows)
    assert all(abs(s - np.dot(vec[q], vec[i])) < 1e-6 for q, v in got.items() for i, s in v)


def test_norms_differ(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(12) * rng.uniform(0.1, 5)).astype(np.float32).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(ranked(ann.nearest(df, df.filter("vec_id < 40"), 10)), brute(rows, rows[:40], 10)) >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5, 0.0]), (101, [0.5, -0.5, 0.0]), (102, [-1.0, 0.0, 0.0])]
    bad = [(200, None), (201, [0.0, 0.0, 0.0]), (202, [nan, 1.0, 0.0]), (203, [inf, 1.0, 0.0]), (204, [None, 1.0, 0.0]),
           (205, [1.0]), (206, []), (None, [1.0, 1.0, 1.0])]
    rows = [(i, v, 7, 0.5) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = ranked(ann.nearest(df, df.filter("vec_id in (3, 50, 100, 102, 200, 201, 202, 203, 204, 205)"), 20))
    assert got == brute(good, [g for g in good if g[0] in (3, 50, 100, 102)], 20)
    few = df.filter("vec_id in (100, 101, 102)")
    assert {q: len(v) for q, v in ranked(ann.nearest(few, few, 20)).items()} == {100: 2, 101: 2, 102: 2}
    assert ann.nearest(df.limit(0), df.limit(0), 20).count() == 0
    assert ann.nearest(df, df.limit(0), 20).count() == 0


def test_equal_rows_count_each(spark):
    rows = [(1, [1.0, 0.0])] * 3 + [(2, [0.9, 0.1])] * 2 + [(2, [0.1, 0.9]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ranked(ann.nearest(df, df.filter("vec_id in (3, 4)"), 4))
    assert got == brute(rows, [(3, [1.0, 0.0]), (4, [0.0, 1.0])], 4)


def test_few_rows_are_verified(monkeypatch):
    """Clustered vectors: the stop leaves most rows out and loses few neighbours."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 64))
    x = centres[rng.integers(0, 50, 8000)] + 0.4 * rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    chunk = ann.Chunk(ann.Projection(64, 1.0), np.arange(8000), np.ones(8000), x)
    found = 0
    for i in range(0, 8000, 200):
        got = {v for _, v, _ in chunk.search(x[i:i + 1], np.array([-math.inf]), 21)[0]}
        found += len(got & set(np.argsort(-(x @ x[i]))[:21].tolist()))
    assert found / (40 * 21) >= 0.9 and chunk.verified / (40 * 8000) < 0.1


@pytest.mark.parametrize("blocks", [3, 100])
def test_queries_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", blocks)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 100)
    monkeypatch.setattr(ann, "HOME_ROWS", 150)
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ranked(ann.nearest(df, df.filter("vec_id % 20 = 0"), 5))
    assert recall(got, brute(rows, [r for r in rows if r[0] % 20 == 0], 5)) >= 0.9


def test_chi_square():
    assert abs(ann.chi_square(ann.stop_ratio()) - ann.STOP) < 1e-9
    x = np.random.default_rng(2).standard_normal((200000, ann.DIMENSIONS))
    r = (x ** 2).sum(axis=1)
    for at in (12.0, 24.0, 40.0):
        assert abs(ann.chi_square(at) - (r <= at).mean()) < 0.01
