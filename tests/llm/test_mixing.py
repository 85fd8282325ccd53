import hashlib
import re

from fleetlens.llm import mixing


def brute(rows):
    """Targets by repeated resharing and the Pareto order by plain sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, size) if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        own = [(r.doc_id, n, hashlib.md5((r.text or "").encode()).hexdigest()) for r, n in zip(rows, size) if r.source == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        rest, cum = target[s] - whole * total[s], 0
        groups = []
        for d, n, text in own:
            u = (int(hashlib.md5(f"mix:{text if d is None else d}".encode()).hexdigest()[:12], 16) + .5) / 2 ** 48
            groups.append((u, d is not None, d or 0, n, text, d))
        for _, _, _, n, _, d in sorted(groups, key=lambda g: g[:5]):
            extra = bool(n) and whole < 3 and rest > 0 and cum + n / 2 <= rest
            cum += n
            out.append((d, n, total[s], target[s], (whole + extra) * n))
    return out


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = mixing.document_sizes(docs)
    got = mixing.take_mix(sizes, mixing.plan_mix(sizes)).collect()
    key = lambda r: (str(r[0]), r[1], r[4], r[2])
    a = sorted([(g.doc_id, g["size"], g.source_size, g.target, g.taken) for g in got], key=key)
    b = sorted(brute(rows), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[4] == y[4] and abs(x[3] - y[3]) < 1e-6 * max(1, y[3])


def test_documents(small_docs):
    check(small_docs)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty(empty_docs):
    sizes = mixing.document_sizes(empty_docs)
    assert mixing.take_mix(sizes, mixing.plan_mix(sizes)).count() == 0
    assert mixing.mix_documents(empty_docs).count() == 0


def test_mix_repeats_whole_documents(small_docs):
    sizes = mixing.document_sizes(small_docs)
    want = {r.doc_id: r.copies for r in mixing.take_mix(sizes, mixing.plan_mix(sizes)).collect()}
    mix = mixing.mix_documents(small_docs)
    assert mix.columns == small_docs.columns
    got = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert max(want.values()) <= 3


def test_ties_fill_the_target(spark):
    """Rows without an id, with one id, or equal in everything are taken one by one, not all or none."""
    rows = [(None, f"{'w ' * (1 + i % 12)}", "a") for i in range(300)] + [(7, "x y z", "b")] * 200 + [(None, "same text", "c")] * 150
    rows += [(i, "some words of a large source " * 4, "d") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(docs)
    sizes = mixing.document_sizes(docs)
    taken = mixing.take_mix(sizes, mixing.plan_mix(sizes))
    for r in taken.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
