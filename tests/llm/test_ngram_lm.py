import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge import crc
from fleetlens.llm import ngram_lm
from fleetlens.llm.common import crc_mod


def brute(rows):
    """The automaton spelled out with dictionaries, token by token."""
    docs = [(r.doc_id, crc(r.doc_id, 7) == 2, (r.text or "").encode().lower().split() + [b" "]) for r in rows]
    train = [d[2] for d in docs if not d[1]]
    c = Counter(w for t in train for w in t)
    c2 = Counter(p for t in train for p in zip([b" "] + t, t))
    c3 = Counter(p for t in train for p in zip([b" "] + t, t, t[1:]))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    uni = lambda k: (max(k - d, 0) + d * v / (v + 1)) / n
    power = lambda k: k.bit_length()
    gain = Counter()
    for (u, w), k in c2.items():
        if c[u] > 1:
            for g, x in enumerate(ngram_lm.GRID):
                p = x * (k - 1) / (c[u] - 1) + (1 - x) * uni(c[w] - 1)
                gain[power(c[u] - 1), g] += k * (math.log(p) if p else -math.inf)
    best = {b: max(range(len(ngram_lm.GRID)), key=lambda g: gain[b, g]) for b in range(ngram_lm.BINS)}
    kinds = [[k for (u, v, _), k in c3.items() if c2[u, v] >= 2 and power(c2[u, v]) == b] for b in range(ngram_lm.BINS)]
    share = []
    for k in kinds:
        once, twice = k.count(1), k.count(2)
        d3 = once / (once + 2 * twice) if once else 0.5
        share.append(min(max(1 - d3 * len(k) / sum(k), 0), 0.99) if k else 0)
    out = []
    for doc_id, held, t in docs:
        score = 0.0
        for i, (u, w) in enumerate(zip([b" "] + t, t)):
            x = ngram_lm.GRID[best[power(c[u])]] if c[u] else 0
            p = (x * c2[u, w] / c[u] if c[u] else 0) + (1 - x) * uni(c[w])
            if i and c2[pair := (([b" "] + t)[i - 1], u)] >= 2:
                x = share[power(c2[pair])]
                p = x * c3[*pair, w] / c2[pair] + (1 - x) * p
            score += math.log10(p)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        out.append((str(doc_id), held, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("which", ["edge_docs", "small_docs"])
def test_like_dictionaries(request, which, monkeypatch):
    docs = request.getfixturevalue(which)
    got = sorted((str(r[0]),) + tuple(r)[1:] for r in
                 ngram_lm.score_documents(docs, crc_mod(F.col("doc_id"), 7) == 2).collect())
    want = brute(docs.select("doc_id", "text").collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_empty_table_and_no_training(spark, empty_docs):
    assert ngram_lm.score_documents(empty_docs, F.lit(False)).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ngram_lm.score_documents(docs, F.lit(True)).collect()}
    assert got == {1: (True, 3, 0, 0, 0.0, 0.0), 2: (True, 1, 0, 0, 0.0, 0.0)}


def test_pack_keeps_arrays():
    a, b = np.array([0, 1, 2 ** 63], dtype=np.uint64), np.array([], dtype=np.int32)
    x, y = ngram_lm.unpack(ngram_lm.pack(a, b))
    assert x.tolist() == a.tolist() and y.tolist() == [] and y.dtype == b.dtype


def test_known_continuations_score_above_unknown_ones(spark):
    train = [(i, t) for i, t in enumerate(["a b c", "a b d", "a b", "c a b c", "b a", "d d d a b"] * 2)]
    docs = spark.createDataFrame(train + [(100, "a b c"), (101, "a b d"), (102, "a b zzz"), (103, "a b zzz")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.score_documents(docs, F.col("doc_id") >= 100).collect()}
    assert min(got[100], got[101]) > got[102] == got[103]


def test_long_text_is_walked_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c a b d e " * 50) for i in range(3)], "doc_id long, text string")
    whole = sorted(r.score for r in ngram_lm.score_documents(docs, F.lit(False)).collect())
    monkeypatch.setattr(ngram_lm, "STEPS", 7)
    assert np.allclose(whole, sorted(r.score for r in ngram_lm.score_documents(docs, F.lit(False)).collect()))
