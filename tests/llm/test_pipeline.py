import base64
import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from edge import crc
from fleetlens.llm import langid, pii
from test_mixing import brute as brute_mix
from test_simhash import brute_fp, classes


def brute(spark, docs):
    """The stages in plain Python, one document list after the other."""
    rows = docs.collect()
    model = langid.fit(docs.filter(docs.doc_id.isin([r.doc_id for r in rows if crc(r.doc_id, 5)])))
    bits, n = langid.Scorer(model).entropies([r.text or "" for r in rows])
    rejected = langid.predict(model, bits, n)[2]
    rows = [r for r, size, bad in zip(rows, n, rejected) if size and not bad]
    fps = [brute_fp(r.text) for r in rows]
    low = classes(set(fps), [(a, b) for a, b in itertools.combinations(set(fps), 2) if (a ^ b).bit_count() <= 2])
    first = {}
    for r, f in zip(rows, fps):
        first[low[f]] = min(first.get(low[f], r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in first.values()]
    weights = pii.fit(spark.createDataFrame(rows, docs.schema))
    out = []
    for r in rows:
        text, end = [], 0
        for kind, s, e in sorted(pii.all_spans(r.text, weights)[1], key=lambda x: (x[1], -x[2])):
            if e > end:
                text += [r.text[end:s], f"<{kind}>"] if s >= end else []
                end = e
        out.append(r.__class__(**{**r.asDict(), "text": "".join(text) + r.text[end:]}))
    rows = {r.doc_id: r for r in out}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc_id, size, _, _, taken in brute_mix(out):
        ids = tuple(enc.encode_ordinary(rows[doc_id].text))
        want[doc_id, ids, hashlib.sha256(rows[doc_id].text.encode()).hexdigest()] += taken // size if size else 0
    return +want


def test_like_brute_force(spark, small_docs, sf_tables):
    got = corpus_pipeline.run(spark, sf_tables(small_docs)).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in got) == brute(spark, small_docs)
    assert all(r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("which", ["edge_docs", "empty_docs"])
def test_stages_on_edge_cases(request, spark, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert name == "tokens" or out.columns == docs.columns
        out.collect()
    one = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert len(one) == len({brute_fp(r.text) for r in docs.collect()}) or which == "empty_docs" and not one
