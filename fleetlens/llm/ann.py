"""Approximate nearest neighbours: stable projections, a kd-tree, a chi-square stop.

Nearness is the largest inner product.  With one more coordinate,
``sqrt(M^2 - |x|^2)`` (M: the largest norm), and queries scaled to norm M, it
is the smallest Euclidean distance d.  ``DIMENSIONS`` Gaussian (2-stable)
projections map d to a projected distance r with ``r^2 / d^2`` chi-square
distributed.  Rows are visited by rising projected distance, one leaf of the
tree after the other, and their exact products taken; a query stops when the
chi-square distribution at ``r^2 / d_k^2`` reaches ``STOP`` (d_k: distance of
the k-th best so far): a neighbour as near as that would lie beyond r with
probability below ``1 - STOP``.

The kd-tree's upper part deals rows to cells and is fitted on a bounded sample
(``SAMPLE_ROWS`` rows); every row is indexed.  Cells over ``CHUNK_ROWS`` rows
are cut into chunks by id hash, each with its own lower tree, so no task holds
more.  Queries are sent to the rows: first to the nearest cells that hold
``HOME_ROWS`` rows, and then, with the distance found there, to the cells that
the test does not exclude.  A chunk's queries stream past its tree; only beyond
``BLOCK_QUERIES`` of them are its rows read by a further task.

Of equal vectors only the ``k + 1`` smallest ids can be in an answer, so only
these are indexed, with the number of their equal rows; equal queries are
searched once.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the table's most
frequent one; rows of the same id count each, an id is never its own
neighbour; fewer candidates than k give fewer rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise

DIMENSIONS, STOP, SEED = 24, 0.92, 10
SAMPLE_ROWS, CHUNK_ROWS, LEAF_ROWS, HOME_ROWS, BLOCK_QUERIES = 20_000, 8192, 256, 16_384, 16_384


def chi_square(x: np.ndarray | float) -> np.ndarray | float:
    """Distribution function with DIMENSIONS (even) degrees of freedom."""
    h = np.minimum(x, 1e4) / 2
    term = total = np.exp(-h)
    for j in range(1, DIMENSIONS // 2):
        term = term * h / j
        total = total + term
    return 1 - total


def stop_ratio() -> float:
    """The ratio r^2 / d^2 at which the test holds."""
    low, high = 0.0, 50.0 * DIMENSIONS
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < STOP else (low, mid)
    return high


class Projection:
    """Maps rows and queries to the projected space."""

    def __init__(self, dim: int, norm: float):
        self.norm = norm
        self.matrix = np.random.default_rng(SEED).standard_normal((dim + 1, DIMENSIONS))

    def rows(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.norm ** 2 - np.einsum("ij,ij->i", x, x), 0))
        return x @ self.matrix[:-1] + last[:, None] * self.matrix[-1]

    def scaled(self, q: np.ndarray) -> np.ndarray:
        return q * (self.norm / np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self.scaled(q) @ self.matrix[:-1]


def kd_order(p: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Places of the rows of each leaf: halves by the widest coordinate's median."""
    out, todo = [], [np.arange(len(p))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        axis = np.ptp(p[at], axis=0).argmax()
        half = len(at) // 2
        order = np.argpartition(p[at, axis], half)
        todo += [at[order[half:]], at[order[:half]]]
    return out


class Splits:
    """The upper kd-tree: medians of a sample, cells numbered from 0."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.at, self.depth = {}, {}, 0
        level = {1: np.arange(len(sample))}
        while len(level) * 2 <= cells:
            nxt = {}
            for node, rows in level.items():
                p = sample[rows]
                axis = int(np.ptp(p, axis=0).argmax()) if len(rows) else 0
                at = float(np.median(p[:, axis])) if len(rows) else 0.0
                self.axis[node], self.at[node] = axis, at
                right = p[:, axis] > at if len(rows) else np.zeros(0, dtype=bool)
                nxt[2 * node], nxt[2 * node + 1] = rows[~right], rows[right]
            level, self.depth = nxt, self.depth + 1

    def cell(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), dtype=np.int64)
        for _ in range(self.depth):
            axis = np.array([self.axis[n] for n in node], dtype=np.int64)
            at = np.array([self.at[n] for n in node])
            node = 2 * node + (p[np.arange(len(p)), axis] > at)
        return node - (1 << self.depth)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of one point to boxes."""
    gap = np.maximum(low - q, 0) + np.maximum(q - high, 0)
    return np.einsum("ij,ij->i", gap, gap)


class Chunk:
    """Up to ``CHUNK_ROWS`` rows with their lower kd-tree."""

    def __init__(self, projection: Projection, ids: np.ndarray, copies: np.ndarray, x: np.ndarray):
        p = projection.rows(x)
        leaves = kd_order(p, LEAF_ROWS)
        order = np.concatenate(leaves)
        self.projection, self.ids, self.copies, self.x, self.p = projection, ids[order], copies[order], x[order], p[order]
        self.ends = np.cumsum([len(a) for a in leaves])
        self.starts = self.ends - [len(a) for a in leaves]
        self.low = np.array([self.p[a:b].min(axis=0) for a, b in zip(self.starts, self.ends)])
        self.high = np.array([self.p[a:b].max(axis=0) for a, b in zip(self.starts, self.ends)])
        self.leaf = np.repeat(np.arange(len(leaves)), [len(a) for a in leaves])
        self.squares = np.einsum("ij,ij->i", self.p, self.p)
        self.ratio = stop_ratio()
        self.verified = 0

    def search(self, queries: np.ndarray, worst: np.ndarray, k: int) -> list[list[tuple[float, int, int]]]:
        """(product, id, copies) of the ``k`` best rows found per query; ``worst``: products that k rows elsewhere reach."""
        out = []
        for start in range(0, len(queries), 64):
            q = queries[start:start + 64]
            pq = self.projection.queries(q)
            # Squared projected distances of a few queries to all rows of the chunk.
            d = self.squares - 2 * pq @ self.p.T + np.einsum("ij,ij->i", pq, pq)[:, None]
            out += [self._one(x, px, dx, w, k) for x, px, dx, w in zip(q, pq, d, worst[start:start + 64])]
        return out

    def _one(self, q: np.ndarray, pq: np.ndarray, d: np.ndarray, kth: float, k: int) -> list[tuple[float, int, int]]:
        scale, size = self.projection.norm / math.sqrt(float(q @ q)), 2 * self.projection.norm ** 2

        def reach() -> float:
            """Squared projected distance at which the test stops the search."""
            return self.ratio * max(size - 2 * scale * kth, 1e-12) if kth > -math.inf else math.inf

        near = _box_distance(pq, self.low, self.high)
        seen, score = [], np.zeros(0)
        if kth == -math.inf and len(d) > k:
            # The nearest leaf gives a first distance; its rows come up again in order.
            leaf = int(near.argmin())
            first = self.x[self.starts[leaf]:self.ends[leaf]] @ q
            if len(first) >= k:
                kth = float(np.partition(first, len(first) - k)[len(first) - k])
        limit = reach()
        open_ = (near <= limit)[self.leaf] & (d <= limit)      # leaves whose box is beyond the stop are not entered
        order = np.flatnonzero(open_)
        order = order[np.argsort(d[order], kind="stable")]
        at, step = 0, 128
        while at < len(order) and d[order[at]] <= limit:
            rows = order[at:at + step]
            rows = rows[d[rows] <= limit]
            seen.append(rows)
            score = np.concatenate([score, self.x[rows] @ q])
            if len(score) >= k:
                kth = max(kth, float(np.partition(score, len(score) - k)[len(score) - k]))
                limit = reach()
            at, step = at + step, min(2 * step, 2048)
        if not seen:
            return []
        found = np.concatenate(seen)
        self.verified += len(found)
        if len(found) > k:  # exact sums decide among those within rounding of the k-th
            edge = np.partition(score, len(found) - k)[len(found) - k]
            found = found[score >= edge - 1e-9 * (1 + abs(edge))]
        exact = sorted((-math.fsum((self.x[j] * q).tolist()), int(self.ids[j]), int(self.copies[j])) for j in found)
        return [(-v, i, n) for v, i, n in exact[:k]]


def _search(projection: Projection, k: int):
    """Rows, then queries, of one (cell, chunk, block) after the other -> (qid, vec_id, score, copies).

    The last column is a row's copies or the product that a query has reached.
    """
    def run(batches):
        key, held, chunk = None, [], None
        for batch in batches:
            kinds = batch.column(3).to_numpy(zero_copy_only=False)
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            cut = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]], len(keys)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, chunk = keys[a], [], None
                own, x, last = (batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a)),
                                batch.column(6).slice(a, b - a).to_numpy(zero_copy_only=False))
                if not kinds[a]:
                    held.append((own, last, x))
                    continue
                if chunk is None and held:
                    chunk = Chunk(projection, *map(np.concatenate, zip(*held)))
                    held = []
                if chunk is None:
                    continue
                out = [(int(qid), i, v, n) for qid, found in zip(own, chunk.search(x, last, k)) for v, i, n in found]
                if out:
                    qid, vec_id, score, copies = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qid, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64()),
                         pa.array(copies, pa.int64())], names=["qid", "vec_id", "score", "copies"])

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    ok = ("vec_id is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) "
          "and abs(v) < double('Infinity')) and exists(embedding, v -> v <> 0)")
    own = vectors.select("vec_id", "embedding").filter(ok)
    sizes = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return own.filter(F.size("embedding") == (sizes.dim if sizes else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among all rows but its own id.

    ``queries`` (vec_id, embedding) are rows like those of ``vectors``.
    """
    spark, wanted = vectors.sparkSession, k + 1
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = (valid_vectors(vectors).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))
             .withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= wanted).drop("_n"))
    index = materialise(index, "vectors")
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    about = index.agg(F.count("*").alias("n"), F.max(F.sqrt(norm2)).alias("norm"),
                      F.max(F.size("embedding")).alias("dim")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not about.n:
        return spark.createDataFrame([], schema)
    projection = Projection(about.dim, about.norm * (1 + 1e-12))
    unit = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array([r.embedding for r in index.filter(unit < SAMPLE_ROWS / about.n).select("embedding")
                       .limit(SAMPLE_ROWS + SAMPLE_ROWS // 2).collect()], dtype=np.float64)
    cells = min(SAMPLE_ROWS // 16, max(1, about.n // CHUNK_ROWS))
    splits = Splits(projection.rows(sample) if len(sample) else np.zeros((0, DIMENSIONS)), cells if len(sample) else 1)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                p = projection.rows(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(splits.cell(p).astype(np.int32)), pa.array(list(p))],
                    names=["vec_id", "embedding", "copies", "cell", "p"])

    element = index.schema["embedding"].dataType.simpleString()
    placed = materialise(index.select("vec_id", "embedding", "copies").mapInArrow(
        place, f"vec_id long, embedding {element}, copies long, cell int, p array<double>"), "cells")
    boxes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("p")[i]) for i in range(DIMENSIONS)]).alias("low"),
        F.array(*[F.max(F.col("p")[i]) for i in range(DIMENSIONS)]).alias("high")).orderBy("cell").collect()  # per cell
    names, held = np.array([b.cell for b in boxes], dtype=np.int32), np.array([b.n for b in boxes])
    low, high = np.array([b.low for b in boxes]), np.array([b.high for b in boxes])
    chunks = {int(b.cell): -(-b.n // CHUNK_ROWS) for b in boxes}
    chunk_map = F.create_map(*[F.lit(x) for c in chunks.items() for x in c])
    rows = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunk_map[F.col("cell")]).cast("int"))

    asked = materialise(valid_vectors(queries).filter(F.size("embedding") == about.dim).distinct(), "queries")
    once = asked.groupBy("embedding").agg(F.min("vec_id").alias("qid"))
    ratio, result = stop_ratio(), "qid long, vec_id long, score double, copies long"

    def visits(first: bool):
        """Cells that a query still has to see: the nearest ones, or those that the test does not exclude."""
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column(1))
                pq, scale = projection.queries(q), projection.norm / np.sqrt(np.einsum("ij,ij->i", q, q))
                worst = np.array(batch.column(2).to_pylist(), dtype=np.float64)
                who, cell = [], []
                for i in range(len(q)):
                    near = _box_distance(pq[i], low, high)
                    order = np.argsort(near, kind="stable")
                    home = 1 + int(np.searchsorted(np.cumsum(held[order]), HOME_ROWS))
                    if first:
                        need = order[:home]
                    else:
                        d = max(2 * projection.norm ** 2 - 2 * scale[i] * worst[i], 1e-12)
                        need = order[home:]
                        need = need[near[need] <= ratio * d]
                    who += [i] * len(need)
                    cell += names[need].tolist()
                part = batch.take(pa.array(who, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())],
                                                 names=["qid", "embedding", "worst", "cell"])
        return run

    def found(asked_now: DataFrame, first: bool) -> DataFrame:
        pairs = materialise(asked_now.mapInArrow(visits(first), f"qid long, embedding {element}, worst double, cell int"),
                            "visits")
        many = {r.cell: -(-r["count"] // BLOCK_QUERIES) for r in pairs.groupBy("cell").count().collect()}  # per cell
        if not many:
            return spark.createDataFrame([], result)
        blocks = F.coalesce(F.create_map(*[F.lit(x) for c in many.items() for x in c])[F.col("cell")], F.lit(0)).cast("int")
        block = F.pmod(F.xxhash64("qid"), blocks).cast("int")
        last = (chunk_map[F.col("cell")] - 1).cast("int")
        asks = pairs.select("cell", F.explode(F.sequence(F.lit(0), last)).alias("chunk"), block.alias("block"),
                            F.lit(1).alias("kind"), F.col("qid").alias("id"), "embedding", "worst")
        own = rows.filter(blocks > 0).select("cell", "chunk", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                                             F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding",
                                             F.col("copies").cast("double").alias("worst"))
        key = ["cell", "chunk", "block"]
        return (own.unionByName(asks).repartition(*key).sortWithinPartitions(*key, "kind")
                .mapInArrow(_search(projection, wanted), result))

    start = once.select("qid", "embedding", F.lit(float("-inf")).alias("worst"))
    home = materialise(found(start, True), "home")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    worst = (home.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == wanted)
             .select(F.col("qid").alias("_q"), F.col("score").alias("worst")))
    again = once.join(worst, once.qid == worst._q, "left").select(
        "qid", "embedding", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
    both = home.union(found(again, False)).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= wanted)
    members = asked.join(once, "embedding").select(F.col("vec_id").alias("query_id"), "qid").distinct()
    # Equal rows count each; more than k of them cannot be in an answer.
    ranked = members.join(both, "qid").filter("vec_id <> query_id").select(
        "query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("_t"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
