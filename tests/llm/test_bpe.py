import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from fleetlens.llm import bpe, token_counts


@pytest.fixture(scope="module")
def own():
    return bpe.codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def test_like_the_library(own, library):
    rnd = random.Random(4)
    letters = [chr(i) for i in range(0x250)] + [" "] * 200 + list("aeiouthern'sll") * 30 + list("\x85　\x1c᠎日é🙂​")
    for _ in range(3000):
        s = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert ids(own, s) == library.encode_ordinary(s), repr(s)
    for s in ["a" * 3000, " " * 5000, "7" * 3333, "ab" * 2000, "é" * 1000, "=-" * 999, "\n" * 999, "<|endoftext|>", ""]:
        assert ids(own, s) == library.encode_ordinary(s)


def test_tables_start_anew_when_full(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", 20)
    monkeypatch.setattr(bpe, "STATES", 20)
    fresh = bpe.Codec(*bpe.default_vocabulary())
    text = "Some words, others and yet others; unbelievably long ones. " * 3
    assert ids(fresh, text) == library.encode_ordinary(text)


def test_both_machines(own, small_docs):
    words = {w for r in small_docs.select("text").limit(40).collect() for p in own.pieces(r.text) for w in [p.encode()]}
    rnd = random.Random(5)
    words |= {"".join(rnd.choices("abein rst", k=rnd.randint(1, 12))).encode() for _ in range(2000)}
    for w in words:
        if w not in own.ranks:
            assert own.fst.encode(w) == own.fst.encode_by_sets(w), w


def test_streaming_decode_keeps_split_characters(own):
    text = "日本語🙂é" * 50
    parts = list(own.decode_stream(ids(own, text), chunk=1))
    assert "".join(t for _, t in parts) == text and b"".join(d for d, _ in parts) == text.encode()
    assert "".join(t for _, t in own.decode_stream([own.ranks[b"\xe6"]])) == "�"


@pytest.mark.parametrize("which", ["edge_docs", "small_docs", "empty_docs"])
def test_round_trip(request, library, which):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.select("doc_id", "text").collect():
        t = library.encode_ordinary(r.text or "")
        want.append((str(r.doc_id), len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [(str(r[0]),) + tuple(r)[1:] for r in bpe.round_trip(docs).collect()]
    assert sorted(got) == sorted(want)
    back = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted(
        (str(r.doc_id), r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("which", ["edge_docs", "empty_docs"])
def test_length_histogram(request, library, which):
    docs = request.getfixturevalue(which)
    n = [len(library.encode_ordinary(r.text or "")) for r in docs.select("text").collect()]
    hist = token_counts.length_histogram(token_counts.token_lengths(docs)).cache()
    rows = hist.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(set(n))
    for r in rows:
        x = r.n_tokens
        assert r.n_docs == n.count(x) and r.tokens == x * n.count(x)
        assert r.docs_longer == sum(v > x for v in n) and r.tokens_longer == sum(v for v in n if v > x)
        assert r.truncated_total == sum(min(v, x) for v in n)
        assert abs(r.share_up_to - sum(v <= x for v in n) / len(n)) < 1e-12
    for r in token_counts.at_limits(hist, [1, 7, 512]).collect():
        assert (r.docs_over, r.truncated_total) == (sum(v > r.limit for v in n), sum(min(v, r.limit) for v in n))
    for r in token_counts.quantiles(hist, [0.25, 0.5, 1.0]).collect():
        assert r.n_tokens == min(v for v in n if sum(x <= v for x in n) >= r.share * len(n) - 1e-9)
