"""Language-model scoring with a weighted backoff automaton over word trigrams.

Model.  States are the empty context (root), every training word (the end
symbol stands for a document's start) and every pair of words that occurs at
least ``MIN_PAIR`` times in training.  A state has an arc for each word that
followed it and a failure arc to the state of its last word, or to the root;
the root has an arc for each word and one for unknown words.  With
``P(w) = max(c(w) - d, 0) / N`` plus an equal share of what the discount d
leaves for each of V + 1 types, an arc weighs log10 of

    P(w|v)  = k(v) c(v,w) / c(v) + (1 - k(v)) P(w)
    P(w|uv) = k(uv) c(u,v,w) / c(u,v) + (1 - k(uv)) P(w|v)

and a failure arc log10 (1 - k).  k depends on the power of two of its
context's count: for words it maximises the leave-one-out likelihood of all
training tokens (a grid of values), for pairs it is what absolute discounting
leaves, with a discount of the power's own (from its triples seen once and
twice).  An arc leads to the longest suffix that is a state.  One walk from
left to right carries the state, takes the next word's arc or failure arcs
until one is found, and adds up the weights.

Scale.  Neither the counts nor the automaton are ever in one place.  Texts are
coded into blocks of bounded size, a written table.  Each block asks for the
counts of its distinct words and pairs, then, knowing those, of its triples
that begin with a state; the requests are dealt by hash range (as compressed
sorted hashes with the block's own counts, so they are pre-aggregated and no
frequent word makes a hot range), added up, and answered block by block.  A
block with its answers holds the part of the automaton that its documents can
reach.

Words, pairs and triples are known by 64-bit hashes; for a vocabulary of ten million
the chance of any collision is under 1 in 300,000.

Defined cases: null, empty and blank texts are the end symbol alone; a null id
counts as the empty text when folds are dealt; without training tokens each
word has probability 1; repeated rows count and are scored each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise

#: Bytes of text after which a block ends, and of text per hash range of the counts.
BLOCK_BYTES, RANGE_BYTES, LEAST_RANGES = 5 << 20, 8 << 20, 64
#: Occurrences that make a pair of words a state; tokens of a document that are walked at a time.
MIN_PAIR, STEPS = 2, 1 << 16
#: Greatest share of a pair's estimate.
MOST = 0.99
#: Shares of a word's estimate that are tried, by the power of two of its count.
GRID = np.array([0, 1e-4, 1e-3, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])
BINS = 48
#: Kind of the rows that carry likelihoods; 0 is a block, 1 to 3 are words, pairs and triples.
GAINS = -1
_ANSWERS = "block string, kind int, part int, data binary, sums array<double>"
END = b" "  # no word holds a space


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        parts += [struct.pack("<8sQ", a.dtype.str.encode(), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, size = struct.unpack_from("<8sQ", raw, at)
        dtype, at = np.dtype(kind.rstrip(b"\0").decode()), at + 16
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


def gaps(sorted_hashes: np.ndarray) -> np.ndarray:
    return np.diff(sorted_hashes, prepend=np.uint64(0))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass
class Block:
    """Coded documents: words by their place among the block's sorted word hashes."""

    ids: np.ndarray
    no_id: np.ndarray
    held: np.ndarray
    length: np.ndarray  # tokens per document, end included
    words: np.ndarray  # sorted hashes
    stream: np.ndarray  # all tokens

    @classmethod
    def read(cls, data: bytes) -> Block:
        a = unpack(data)
        return cls(a[0], a[1].astype(bool), a[2].astype(bool), a[3], np.cumsum(a[4], dtype=np.uint64), a[5])

    def write(self) -> bytes:
        return pack(self.ids, self.no_id.astype(np.uint8), self.held.astype(np.uint8), self.length, gaps(self.words),
                    self.stream)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context of each token, the distinct bigrams' sorted hashes, the place of each token's bigram)."""
        from xxhash import xxh64_intdigest

        end = np.searchsorted(self.words, np.uint64(xxh64_intdigest(END)))
        before = np.concatenate([[end], self.stream[:-1]]).astype(self.stream.dtype)
        keys, place = np.unique(pair_hash(self.words[before], self.words[self.stream]), return_inverse=True)
        return before, keys, place

    def triples(self, keys: np.ndarray, place: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens whose two predecessors are a state, their distinct triples' sorted hashes, the place of each
        such token's triple, the pair that each distinct triple begins with)."""
        before = np.concatenate([place[:1], place[:-1]])
        state = pairs[before] >= MIN_PAIR
        state[np.cumsum(self.length) - self.length] = False  # a document's first word has one predecessor
        at = np.flatnonzero(state)
        triples, first, of = np.unique(pair_hash(keys[before[at]], self.words[self.stream[at]]), return_index=True,
                                       return_inverse=True)
        return at, triples, of, before[at[first]]

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.length)


def code_blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Written table (block, docs): all texts of ``docs`` (doc_id, text), coded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        task, seq = TaskContext.get().partitionId(), 0
        known, rows, streams, size = {END: 0}, [], [], 0

        def finish():
            h = np.array([xxh64_intdigest(w) for w in known], dtype=np.uint64)
            words, place = np.unique(h, return_inverse=True)
            ids, no_id, held = zip(*rows)
            block = Block(np.array(ids, dtype=np.int64), np.array(no_id), np.array(held),
                          np.array([len(s) for s in streams], dtype=np.int32), words,
                          place.astype(np.int32)[np.concatenate(streams)])
            return pa.RecordBatch.from_arrays([pa.array([f"{task}-{seq}"]), pa.array([block.write()], pa.binary())],
                                              names=["block", "docs"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for doc_id, text, held in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    words = (text or b"").lower().split()
                    words.append(END)
                    streams.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int32))
                    rows.append((doc_id or 0, doc_id is None, held))
                    size += len(text or b"") + 64
                    if size >= BLOCK_BYTES:
                        yield finish()
                        known, rows, streams, size, seq = {END: 0}, [], [], 0, seq + 1
        if rows:
            yield finish()

    flat = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), held_out.alias("held"))
    return materialise(flat.mapInArrow(run, "block string, docs binary"), "blocks")


def _dealt(name: str, kind: int, ranges: int, hashes: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Request rows (block, kind, part, data) of a block for sorted hashes, by hash range."""
    part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    cut = np.searchsorted(part, np.arange(ranges + 1))
    return [(name, kind, i, pack(gaps(hashes[a:b]), *(c[a:b] for c in columns)))
            for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


def _requests(ranges: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one block at a time
                yield ask(batch.column(0)[row].as_py(), Block.read(batch.column(1)[row].as_py()))

    def ask(name: str, block: Block) -> pa.RecordBatch:
        train = block.training()
        own = np.bincount(block.stream[train], minlength=len(block.words)).astype(np.uint32)
        _, keys, place = block.pairs()
        pairs = np.bincount(place[train], minlength=len(keys)).astype(np.uint32)
        cols = list(zip(*_dealt(name, 1, ranges, block.words, own), *_dealt(name, 2, ranges, keys, pairs)))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
             pa.array(cols[3], pa.binary())], names=["block", "kind", "part", "data"])

    return run


def _sums(total: np.ndarray) -> list[float]:
    return [float(total.sum()), float((total > 0).sum()), float((total == 1).sum()), float((total == 2).sum())]


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of one hash range over all blocks, for each block in its order; and the range's sums (no block).

    Words and pairs: tokens, types, types seen once and twice.  Triples: these
    by the power of two of their context's count.  ``GAINS``: added up.
    """
    kind, part = int(asked["kind"].iloc[0]), int(asked["part"].iloc[0])
    got = [unpack(d) for d in asked["data"]]
    if kind == GAINS:
        return pd.DataFrame({"block": [None], "kind": kind, "part": part, "data": [None],
                             "sums": [np.sum([g for g, in got], axis=0).tolist()]})
    hashes = [np.cumsum(g[0], dtype=np.uint64) for g in got]
    keys, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([g[1] for g in got]), minlength=len(keys)).astype(np.uint64)
    replies = [pack(total[p]) for p in np.split(place, np.cumsum([len(h) for h in hashes])[:-1])]
    if kind == 3:
        power = np.concatenate([g[2] for g in got])[first]
        sums = [x for b in range(BINS) for x in _sums(total[power == b])]
    else:
        sums = _sums(total)
    return pd.DataFrame({"block": [*asked["block"], None], "kind": kind, "part": part, "data": [*replies, None],
                         "sums": [None] * len(replies) + [sums]})


@dataclass
class Model:
    """What is global: token count, vocabulary, discount, and the failure weight by context count."""

    tokens: int
    types: int
    discount: float
    keep: np.ndarray | None = None  # share of a word's estimate, by power of two
    keep2: np.ndarray | None = None  # share of a pair's estimate

    def root(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(c))
        floor = self.discount * self.types / (self.types + 1)
        return (np.maximum(c - self.discount, 0) + floor) / self.tokens


def _power(n: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2 n)."""
    return np.frexp(n.astype(np.float64))[1]


def _joined(blocks: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Applies ``fn(name, block, word, pair, triple counts)`` to each block with its answers."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block.read(rows.loc[rows["kind"] == 0, "data"].iloc[0])
        c = [np.concatenate([np.empty(0, np.uint64)] + [unpack(d)[0] for d in rows[rows["kind"] == k].sort_values(
            "part")["data"]]).astype(np.int64) for k in (1, 2, 3)]
        return fn(rows["block"].iloc[0], block, *c)

    coded = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("docs").alias("data"))
    return coded.union(answers.filter("block is not null").select("block", "kind", "part", "data")).groupBy(
        "block").applyInPandas(run, schema)


def _gains(block: Block, model: Model, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Leave-one-out log likelihood of the block's training tokens, by power of the context's count and grid value."""
    before, keys, place = block.pairs()
    train = block.training()
    at = np.full(len(keys), -1)
    at[place] = np.arange(len(place))  # one token of each bigram
    m = np.bincount(place[train], minlength=len(keys))
    n, c = words[before[at]] - 1, words[block.stream[at]] - 1
    use = (m > 0) & (n > 0)
    power, m = _power(n[use]), m[use]
    r, p = (pairs[use] - 1) / n[use], model.root(c[use])
    return np.array([np.bincount(power, weights=m * np.log(g * r + (1 - g) * p), minlength=BINS) for g in GRID]).T


def _second_requests(model: Model, ranges: int) -> Callable:
    """Requests for triples, and the likelihoods of the words' shares."""
    def fn(name: str, block: Block, words: np.ndarray, pairs: np.ndarray, _) -> pd.DataFrame:
        _, keys, place = block.pairs()
        at, triples, of, context = block.triples(keys, place, pairs)
        own = np.bincount(of[block.training()[at]], minlength=len(triples)).astype(np.uint32)
        rows = _dealt(name, 3, ranges, triples, own, _power(pairs[context]).astype(np.uint8))
        rows.append((name, GAINS, zlib.crc32(name.encode()) % LEAST_RANGES,
                     pack(_gains(block, model, words, pairs).ravel())))
        return pd.DataFrame(rows, columns=["block", "kind", "part", "data"])

    return fn


def _walk(model: Model) -> Callable:
    """Builds the automaton that a block's documents can reach and walks it.

    States: 0 is the root, 1 + w a word, 1 + W + p a pair.  A token that its
    state has no arc for has weight 1 there (true weights are at most 0).
    """
    def fn(_, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> pd.DataFrame:
        before, keys, place = block.pairs()
        stream, n_words = block.stream, len(words)
        keep = model.keep[_power(words)]  # by word; a word unseen in training is no state
        p1 = model.root(words)[stream]
        p2 = keep[before] * pairs[place] / np.maximum(words[before], 1) + (1 - keep[before]) * p1
        arc1, arc2 = np.log10(p1), np.where(pairs[place] > 0, np.log10(p2), 1.0)
        at, _, of, _ = block.triples(keys, place, pairs)
        context, c3 = pairs[place[at - 1]], triples[of]
        keep2 = model.keep2[_power(context)]
        arc3 = np.ones(len(stream))
        arc3[at] = np.where(c3 > 0, np.log10(keep2 * c3 / context + (1 - keep2) * p2[at]), 1.0)
        fail = array("d", np.log10(1 - np.concatenate([[0.0], keep, model.keep2[_power(pairs)]])).tobytes())
        back = np.zeros(1 + n_words + len(keys), dtype=np.int32)
        back[1 + n_words + place] = 1 + stream
        back = array("i", back.tobytes())
        after = np.where(pairs[place] >= MIN_PAIR, 1 + n_words + place, np.where(words[stream] > 0, 1 + stream, 0))
        start = np.cumsum(block.length) - block.length
        origin = 1 + int(before[0]) if words[before[0]] else 0  # the first token's predecessor is the end symbol

        def walk(first: int, end: int) -> float:
            state, total = origin, 0.0
            for a in range(first, end, STEPS):
                b = min(a + STEPS, end)
                for x3, x2, x1, then in zip(arc3[a:b].tolist(), arc2[a:b].tolist(), arc1[a:b].tolist(), after[a:b].tolist()):
                    if state > n_words:
                        if x3 <= 0:
                            total += x3
                            state = then
                            continue
                        total += fail[state]
                        state = back[state]
                    if state:
                        if x2 <= 0:
                            total += x2
                            state = then
                            continue
                        total += fail[state]
                    total += x1
                    state = then
            return total

        base = np.log10((words + 1) / (model.tokens + model.types + 1))[stream]
        return pd.DataFrame({
            "doc_id": pd.array(np.ma.filled(np.where(block.no_id, 0, block.ids)), dtype="Int64").copy(),
            "held_out": block.held, "n_tokens": block.length.astype(np.int64),
            "n_known": np.add.reduceat((words > 0)[stream].astype(np.int64), start),
            "train_tokens": model.tokens, "base_score": np.add.reduceat(base, start),
            "score": [walk(int(a), int(a + n)) for a, n in zip(start, block.length)]}).assign(
                doc_id=lambda d: d["doc_id"].mask(block.no_id))

    return fn


def _pair_shares(sums: np.ndarray) -> np.ndarray:
    """Share of a pair's estimate by the power of its count, from (tokens, types, seen once, seen twice) of its triples."""
    tokens, types, once, twice = sums.T
    discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
    return np.where(tokens > 0, np.clip(1 - discount * types / np.maximum(tokens, 1), 0, MOST), 0.0)


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    The model is learned from the rows where ``held_out`` is false.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, size // RANGE_BYTES)
    blocks = code_blocks(docs, held_out)
    request = "block string, kind int, part int, data binary"
    asked = blocks.mapInArrow(_requests(ranges), request)
    answers = materialise(asked.groupBy("kind", "part").applyInPandas(_answer, _ANSWERS), "answers")
    n, v, n1, n2 = _added(answers.filter("kind = 1"), 4)
    model = Model(int(n), int(v), n1 / (n1 + 2 * n2) if n1 else 0.5)
    asked = _joined(blocks, answers, _second_requests(model, ranges), request)
    second = materialise(asked.groupBy("kind", "part").applyInPandas(_answer, _ANSWERS), "answers")
    gains = _added(second.filter(F.col("kind") == GAINS), BINS * len(GRID)).reshape(BINS, len(GRID))
    model.keep = GRID[np.argmax(gains, axis=1)]
    model.keep2 = _pair_shares(_added(second.filter("kind = 3"), BINS * 4).reshape(BINS, 4))
    return _joined(blocks, answers.union(second), _walk(model), "doc_id long, held_out boolean, n_tokens long, "
                   "n_known long, train_tokens long, base_score double, score double")


def _added(answers: DataFrame, size: int) -> np.ndarray:
    """The ranges' sums, added up position by position (``size`` rows)."""
    rows = (answers.filter("block is null").select(F.posexplode("sums").alias("i", "x")).groupBy("i")
            .agg(F.sum("x").alias("x")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r.i] = r.x
    return out
