import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import line_runs

BLANKS = b" \t\n\x0b\x0c\r"


def key(line):
    return line.encode().strip(BLANKS).lower()


def brute(rows, min_docs):
    """(doc_id, lines, dropped, kept text) per (doc_id, text) row."""
    found = Counter(k for _, text in rows for k in {key(x) for x in (text or "").split("\n")} if k)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if found[key(x)] < min_docs]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def check(docs, min_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_runs.dedup_lines(docs, min_docs)
    extra = ("n_lines", "n_dropped")
    assert [c for c in got.columns if c not in extra] == [c for c in docs.columns if c not in extra]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(rows, min_docs)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_documents(small_docs, min_docs):
    check(small_docs, min_docs)


def test_edge_cases(spark, edge_docs):
    check(edge_docs, 2)
    line = "A Shared line.\t"
    rows = [(i, f"\n{line}\r\n own {i}\n\x0b\n{line.lower()}\nÄ{'x' * (i % 3)}\n") for i in range(12)]
    rows += [(3, None), (None, ""), (4, line), (5, f"{line}\n" * 3000 + "end")]
    check(spark.createDataFrame([(*r, 7, "h") for r in rows], "doc_id long, text string, n_lines int, h string"), 10)


def test_empty(empty_docs):
    assert line_runs.dedup_lines(empty_docs, 2).count() == 0


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "k string").select(F.unhex(F.md5(F.col("k").cast("binary"))).alias("h"))


def test_runs_are_compacted_and_resumed(spark):
    runs = line_runs.LineRuns(spark, settled=3, fan=2)
    want = Counter()
    for b in range(5):
        names = ["hot"] * 4 + [f"k{i % 7}" for i in range(b, 9)]
        want.update(names)
        runs.add(keys(spark, names), f"b{b}")
        runs.add(keys(spark, names), f"b{b}")  # a replay
    assert sorted(r[0] for r in runs.runs) == [0, 2]  # five batches, two runs
    # The first run settles the hot key: later batches leave it out.
    assert runs.counts().filter(F.col("n") >= 3).count() == sum(n >= 3 for n in want.values())
    unsettled = {bytes(r.h): r.n for r in runs.counts().collect()}
    assert unsettled[hashlib.md5(b"hot").digest()] == 4
    again = line_runs.LineRuns(spark, settled=3, fan=2, folder=runs.folder)
    assert again.batches == [f"b{b}" for b in range(5)] and again.version == runs.version
    assert {bytes(r.h): r.n for r in again.counts().collect()} == unsettled
    assert {bytes(r.h) for r in again.unseen(keys(spark, ["k1", "new"])).collect()} == {hashlib.md5(b"new").digest()}
    runs.close()
    again.close()


def test_runs_are_not_shuffled_by_the_anti_join(spark):
    runs = line_runs.LineRuns(spark, settled=1, fan=9)
    runs.add(keys(spark, map(str, range(100))), "a")
    plan = runs.unseen(keys(spark, ["1", "x"]).repartition(runs.buckets, "h"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    runs.close()
