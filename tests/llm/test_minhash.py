import hashlib
import itertools

import pytest
import xxhash

from fleetlens.llm import minhash


@pytest.mark.parametrize("which", ["edge_docs", "small_docs", "empty_docs"])
def test_edited(request, which):
    docs = request.getfixturevalue(which)
    sign = lambda x: x - 2 ** 64 if x >> 63 else x
    key = lambda r: (r.doc_id is not None, r.doc_id or 0,
                     sign(xxhash.xxh64_intdigest((r.text or '').encode(), 42)))
    rows = sorted(docs.select("doc_id", "text").collect(), key=key)
    sh, want = minhash.Shingler(), []
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, u = r.text or "", nxt.text or ""
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        s, se, su = sh.signature(t), sh.signature(e), sh.signature(u)
        want.append((str(r.doc_id), len(t), hashlib.sha256(e.encode()).hexdigest(), s.tobytes(), se.tobytes(),
                     float((s == se).mean()), float((s == su).mean())))
    got = [(str(r[0]), r[1], r[2], bytes(r[3]), bytes(r[4]), r[5], r[6])
           for r in minhash.edited_fingerprints(docs).collect()]
    assert sorted(got) == sorted(want)


def test_likeness_estimates_jaccard():
    sh = minhash.Shingler()
    a = [f"w{i}" for i in range(400)]
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        b = a[:int(400 * share)] + [f"v{i}" for i in range(400 - int(400 * share))]
        x, y = " ".join(a), " ".join(b)
        ka, kb = set(sh.keys(x).tolist()), set(sh.keys(y).tolist())
        true = len(ka & kb) / len(ka | kb)
        assert abs(minhash.likeness(sh.signature(x), sh.signature(y)) - true) < 0.2


def test_near_pairs(spark, small_docs, empty_docs):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words)] * 3 + [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in (10, 50, 99)] + ["", "", None, "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(
        small_docs.selectExpr("doc_id + 1000", "text"))
    sh, first = minhash.Shingler(), {}
    for r in docs.collect():
        first.setdefault(r.text or "", r.doc_id)
        first[r.text or ""] = min(first[r.text or ""], r.doc_id)
    sets = {i: set(sh.keys(t).tolist()) for t, i in first.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = {(r.a, r.b) for r in minhash.near_pairs(docs).collect()}
    assert got == want and len(want) >= 5
    assert minhash.near_pairs(empty_docs).count() == 0
