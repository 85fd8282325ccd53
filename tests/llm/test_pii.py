import hashlib
import itertools
import math
import random
import re
import tracemalloc

import pytest

from fleetlens.llm import pii


def brute(text):
    """The patterns as given, with the library's own search."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19),
                                     ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if low <= len(d) <= high and (kind == "phone" or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_like_the_patterns(small_docs):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abz.@-+() 0123456789%_\n", k=rnd.randint(0, 80))) for _ in range(20000)]
    texts += ["a@b.c@d.e", "x@y", "a..b@c.d.e.", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (212) 555-0123 x"]
    texts += [r.text for r in small_docs.select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == brute(t), repr(t)


def test_long_runs_are_linear():
    for t in ["a" * 200000, "1" * 200000, "@" * 100000, "1." * 100000, "+1" + " " * 200000, "a@" * 50000]:
        pii.base_spans(t)


@pytest.fixture(scope="module")
def weights():
    return pii.train(pii.examples([pii._SEED_TEXT] * pii.SEED_COPIES))


def test_dynamic_programme_finds_the_best_segmentation():
    rnd = random.Random(6)
    text = "12 3456 (78) 90-11 x@y.zz"
    lattice = pii.Lattice(text, 0, len(text))
    for _ in range(10):
        w = {(k, f): rnd.uniform(-2, 2) for k in pii.KINDS for fs in lattice.segments.values() for f in fs + [""]}
        value = {(i, j, k): pii.weigh(w, k, f) for (i, j), f in lattice.segments.items() for k in pii.KINDS}
        n = len(lattice.atoms)

        def best(i):
            if i == n:
                return 0.0
            return max([best(i + 1)] + [value[i, j, k] + best(j) for j in range(i + 1, n + 1) for k in pii.KINDS])

        first = {a: i for i, (a, _) in enumerate(lattice.atoms)}
        last = {b: i + 1 for i, (_, b) in enumerate(lattice.atoms)}
        got = sum(value[first[a], last[b], k] for k, a, b in lattice.best(w))
        assert math.isclose(got, best(0))


def test_added_spans(weights):
    for text, want in [("please call (212) 555-0199 now", "phone"), ("card 4111.1111.1111.1111 was used", "card"),
                       ("mail joe (at) corp (dot) example ok", "email")]:
        base, every = pii.all_spans(text, weights)
        assert not base and [k for k, _, _ in every] == [want], text
    for text in ["on 2024-01-15 we sold 1 234 567 units", "serial 1234567890123456 is it", "in 1990-2020 and 300.1.2.3"]:
        assert not pii.all_spans(text, weights)[1], text


def test_short_and_long_notations(weights):
    for text, want in [("the host 10[.]0[.]0[.]1 fell", ("ip", 9, 23)),
                       ("card 4. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1. 1 was used", ("card", 5, 51)),
                       ("card 5 - 5 - 0 - 0 - 0 - 0 - 5 - 5 - 5 - 5 - 5 - 5 - 5 - 5 - 5 - 9 was", ("card", 5, 66))]:
        base, every = pii.all_spans(text, weights)
        assert every == [want] and want not in base, (text, every)
    for text in ["we saw 1 2 3 4 5 of them", "scores 3-1-0-2 at last", "chapter 1.2.3.4.5.6 says so"]:
        base, every = pii.all_spans(text, weights)
        assert every == base, (text, every)


def test_window_like_the_whole_lattice():
    """The streamed programme against a table over all atoms, in a region of many."""
    rnd = random.Random(3)
    text = " ".join(str(rnd.randint(0, 10 ** rnd.randint(1, 6))) for _ in range(150))
    lattice = pii.Lattice(text, 0, len(text))
    n = len(lattice.atoms)
    for _ in range(5):
        w = {(k, f): rnd.uniform(-2, 1) for k in pii.KINDS for fs in lattice.segments.values() for f in fs + [""]}
        best = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = max([best[i + 1]] + [pii.weigh(w, k, lattice.segments[i, j]) + best[j]
                                           for j in range(i + 1, n + 1) if (i, j) in lattice.segments for k in pii.KINDS])
        first = {a: i for i, (a, _) in enumerate(lattice.atoms)}
        last = {b: i + 1 for i, (_, b) in enumerate(lattice.atoms)}
        spans = lattice.best(w)
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))
        assert math.isclose(sum(pii.weigh(w, k, lattice.segments[first[a], last[b]]) for k, a, b in spans), best[0])


def test_long_regions_take_bounded_memory(weights):
    rnd = random.Random(4)
    text = " ".join(str(rnd.randint(0, 999)) for _ in range(100_000)) + " (212) 555-0199"
    tracemalloc.start()
    pii.segment(text, 0, 60_000, weights)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_pieces_cover_regions_and_cut_no_label():
    text = " ".join(["4111 1111 1111 1111"] * 100)
    gold = pii.base_spans(text) + [("card", i, i + 19) for i in range(0, len(text), 20)]
    cut = list(pii.pieces(text, 0, len(text), gold))
    assert len(cut) > 1 and cut[0][0] == 0 and cut[-1][1] == len(text)
    assert all(any(a <= s and e <= b for a, b in cut) for _, s, e in gold if e - s == 19)


@pytest.mark.parametrize("which", ["edge_docs", "small_docs", "empty_docs"])
def test_find(request, weights, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        base = brute(r.text or "")
        want.append((str(r.doc_id), *[sum(x[0] == k for x in base) for k in pii.KINDS],
                     hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    got = pii.find(docs, weights).collect()
    assert sorted((str(g[0]),) + tuple(g)[1:6] for g in got) == sorted(want)
    text = {str(r.doc_id): r.text or "" for r in rows}
    for g in got:
        spans = [s.split(":") for s in g.spans.split(",") if s]
        base = {(k, s, e) for k, s, e in brute(text[str(g.doc_id)])} if list(text).count(str(g.doc_id)) == 1 else set()
        mine = {(k, int(s), int(e)) for k, s, e in spans}
        assert which == "edge_docs" or base <= mine
        for (_, a, b), (_, c, d) in itertools.product(mine - base, base):
            assert which == "edge_docs" or b <= c or d <= a


def test_fit_and_redact(small_docs, edge_docs, empty_docs):
    w = pii.fit(small_docs)
    assert pii.fit(empty_docs)
    for docs in (small_docs, edge_docs, empty_docs):
        out = pii.redact(docs, w)
        assert out.schema.names == docs.schema.names and out.count() == docs.count()
        for r in out.collect():
            assert r.text is None or not pii.base_spans(r.text)
            assert r.text is None or r.n_chars == len(r.text)
