import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import collocations


def brute(rows, top, least):
    """All candidates of (lang, text) rows, counted and scored one by one."""
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for p, f in own.items() if len(p) == 1)
        cand = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 2 * f >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, f in cand.items()):
                continue
            score, k = min((10 ** 6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, b" ".join(p), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def check(docs, top, least):
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    got = collocations.collocations(docs, top, least).collect()
    want = brute(rows, top, least)
    assert sorted(map(tuple, got)) == want
    return want


@pytest.fixture(scope="module")
def phrases(spark):
    """A small vocabulary with strong triples, several languages, one of them hot."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        lang = ["en", "en", "en", "de", None][i % 5]
        vocab = [f"w{k}" for k in range(12)]
        text = "".join(rng.choice(["New york city", "big apple pie", rng.choice(vocab), rng.choice(vocab)])
                       + rng.choice([" ", " ", "  \t", ", ", ".", "\n"]) for _ in range(60))
        rows.append((i, text, lang, 3, "p"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, a int, phrase string").cache()


@pytest.mark.parametrize("top,least", [(5, 2), (20, 10), (2000, 3)])
def test_like_brute_force(phrases, top, least):
    want = check(phrases, top, least)
    assert top < 2000 or {len(x[2].split()) for x in want} == {2, 3}


def test_several_waves(spark, monkeypatch):
    """The best pairs lie in stronger triples, so the threshold must fall before enough phrases survive."""
    rows = [(i, f"a{k} b{k} c{k}. ", "en") for k in range(30) for i in range(12)]
    rows += [(i, f"x{k} y{k % 5}. " * (k + 1), "en") for k in range(30) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    waves = []
    inner = collocations.triple_counts
    monkeypatch.setattr(collocations, "triple_counts", lambda *a: waves.append(1) or inner(*a))
    check(docs, 40, 5)
    assert len(waves) > 1


def test_documents(small_docs):
    check(small_docs, 2000, 10)


def test_edge_cases(spark, edge_docs):
    check(edge_docs, 10, 2)
    assert collocations.collocations(edge_docs.filter("text is null"), 10, 1).count() == 0


def test_empty(empty_docs):
    assert collocations.collocations(empty_docs).count() == 0


def test_scores_past_64_bits(spark):
    row = spark.createDataFrame([(10 ** 13, 2 * 10 ** 13, 3 * 10 ** 13)], "a long, l long, r long")
    got = row.select(collocations.score(row.a, row.l, row.r).alias("s")).first().s
    assert got == 10 ** 6 * 10 ** 26 // (6 * 10 ** 26)


def test_small_task_tables_change_nothing(phrases, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 64)  # nearly every slot is taken
    check(phrases, 20, 10)


def test_distinct_rows_of_large_numbers():
    rng = np.random.default_rng(1)
    parts = tuple(rng.integers(0, 3, 200) for _ in range(3))
    small, n = collocations._distinct(parts, 3)
    shifted = tuple(p + (1 << 21) for p in parts)
    large, m = collocations._distinct(shifted, (1 << 21) + 3)
    assert n.tolist() == m.tolist() and n.sum() == 200
    assert [(x + (1 << 21)).tolist() for x in small] == [x.tolist() for x in large]
