import itertools

import numpy as np
import pytest
import xxhash

from fleetlens.llm import simhash
from fleetlens.llm.components import components


def brute_fp(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, edges):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(r.text) for r in rows]
    assert sorted((str(r.doc_id), f) for r, f in zip(rows, fps)) == sorted(
        (str(g.doc_id), g.fp % 2 ** 64) for g in got)
    uniq = sorted(set(fps))
    low = classes(uniq, [(a, b) for a, b in itertools.combinations(uniq, 2) if (a ^ b).bit_count() <= 2])
    first = {}
    for r, f in zip(rows, fps):
        if r.doc_id is not None:
            first[low[f]] = min(first.get(low[f], r.doc_id), r.doc_id)
    for g in got:
        assert g.component_id == first.get(low[g.fp % 2 ** 64])


def test_documents(small_docs):
    check(small_docs)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty(empty_docs):
    assert simhash.near_duplicates(empty_docs).count() == 0


@pytest.mark.parametrize("limit", [40, 2048])
def test_links_lose_nothing_when_buckets_are_split(spark, limit):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2 ** 63))
    fps = set()
    for _ in range(90):  # a dense cloud: few varying bits around one fingerprint, and strangers
        x = base
        for b in rng.choice([0, 1, 2, 30, 31, 32, 33, 62, 63], size=rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2 ** 63, 50)}
    signed = [x - 2 ** 64 if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit).collect()
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2)
            if ((a ^ b) & simhash.FULL).bit_count() <= 2}
    pairs = {(g.a, g.b) for g in got}
    assert pairs <= want and len(got) == len(pairs)
    assert classes(signed, pairs) == classes(signed, want)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
