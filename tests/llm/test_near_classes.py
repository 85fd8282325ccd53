import itertools

import pytest

from fleetlens.llm import minhash, simhash
from test_simhash import classes


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute(rows):
    """Smallest place per row of the rows connected by similarities of 0.8 or more."""
    sets = [shingles(r.text) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if alike(sets[i], sets[j])]
    return classes(range(len(rows)), links)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_one_of_each_class_is_kept(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    low = brute(rows)
    got = [r.doc_id for r in simhash.keep_one_each(docs, minhash.near_classes(docs), "class").collect()]
    assert sorted(got) == sorted(rows[i].doc_id for i in set(low.values()))


@pytest.mark.parametrize("limit", [3, 512])
def test_large_buckets_are_split_and_verified(spark, limit):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1:]) for k in range(40)]  # a dense group of near copies
    texts += [" ".join(base[:60] + [f"s{n}-{i}" for i in range(140)]) for n in range(40)]  # one common passage only
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = minhash.near_classes(docs, limit=limit).collect()
    assert len({r["class"] for r in got if r.doc_id < 40}) == 1
    assert len({r["class"] for r in got}) == 41


def test_null_ids_and_blank_texts(edge_docs):
    got = minhash.near_classes(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert len({r["class"] for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert len({r["class"] for r in got if r.doc_id in (13, 14)}) == 1
