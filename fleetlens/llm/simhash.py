"""SimHash near-duplicates: fingerprints, deletion-variant index, verified links, classes.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42)
of a text's 3-word shingles.  Fingerprints at 2 or fewer differing bits link.

Index: cut the 64 bits into two halves; of two fingerprints that differ in at
most two bits, one half differs in at most one.  Each half is indexed once per
bit with that bit left out, so such a pair meets in an equal bucket and is
verified there.  Equal fingerprints are one entry, so copies never multiply.
A large bucket yields a spanning forest of its links, which connects the same.
A bucket of more than ``limit`` different fingerprints is not paired; its
members are indexed again over the bits that the bucket leaves open, in the
same way (halves, one bit left out), until buckets are small.  64 fixed bits
less 6 leave at most 64 members, so this ends and no link is lost.

Defined cases: null, empty and blank texts have fingerprint zero, linked like
any other; texts under three words are one shingle; repeated rows share their
class; a null id never names a class unless all ids of the class are null;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import map_rows, materialise
from fleetlens.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 2
#: Buckets up to this size yield all their links, larger ones a forest of them.
SMALL = 16
FULL = (1 << 64) - 1


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one text's UTF-8 bytes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): fp holds the unsigned bits in a long."""
    def run(rows):
        for doc_id, text_hash, text in rows:
            fp = fingerprint(text or b"")
            yield doc_id, text_hash, fp - (1 << 64) if fp >> 63 else fp

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary")), run,
                    "doc_id long, text_hash long, fp long")


def variant_masks(fixed: int) -> list[int]:
    """Next masks for a bucket that fixes the bits ``fixed``: halves of the open bits, one bit left out each."""
    bits = [i for i in range(64) if not fixed >> i & 1]
    halves = bits[:len(bits) // 2], bits[len(bits) // 2:]
    return [fixed | sum(1 << b for b in half if b != out) for half in halves for out in half]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask, fp = (np.asarray(c).astype(np.int64) for c in batch.columns)
        for m in np.unique(mask):
            own = fp[mask == m]
            for v in variant_masks(int(m) & FULL):
                v = v - (1 << 64) if v >> 63 else v
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), v)), pa.array(own)], names=["mask", "fp"])


def _first_meeting(mask: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """False where another of the 64 first variants also finds the pair and comes first (later levels: True)."""
    first = np.bitwise_count(mask.view(np.uint64)) == 31
    lower = (mask & 0xFFFFFFFF) != 0  # the variant fixes bits of the lower half
    ones = np.bitwise_count((diff & 0xFFFFFFFF).view(np.uint64))
    lowest = np.where(lower, (mask & 1) == 0, (mask >> 32 & 1) == 0)
    once = np.where(lower, (ones == 1) | ((ones == 0) & lowest), (ones == 2) & lowest)
    return ~first | once


def _forest(mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links within one bucket connect: fewer than it has members."""
    rest, tree = np.arange(len(fp)), []
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            diff = fp[rest] ^ fp[x]
            near = (np.bitwise_count(diff.view(np.uint64)) <= DISTANCE) & _first_meeting(mask[rest], diff)
            tree += [(x, y) for y in rest[near]]
            reached += rest[near].tolist()
            rest = rest[~near]
    at = np.array(tree, dtype=np.int64).reshape(-1, 2)
    return fp[at[:, 0]], fp[at[:, 1]]


def _verify(limit: int):
    def pairs(mask, key, fp):
        """Links of whole buckets: at most ``limit`` members, or at most 6 open bits and so 64 members."""
        cut = np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1
        edges = np.concatenate([[0], cut, [len(fp)]])
        size = np.diff(edges)
        for start, stop in zip(edges[:-1][size > SMALL], edges[1:][size > SMALL]):
            yield _forest(mask[start:stop], fp[start:stop])
        after = np.repeat(edges[1:], size) - np.arange(len(fp))  # members from here to the bucket's end
        at = np.flatnonzero(np.repeat(size <= SMALL, size))
        for d in range(1, int(after[at].max(initial=0))):
            at = at[after[at] > d]
            a, b, m = fp[at], fp[at + d], mask[at]
            diff = a ^ b
            near = (np.bitwise_count(diff.view(np.uint64)) <= DISTANCE) & _first_meeting(m, diff)
            if near.any():
                yield a[near], b[near]

    def out(a=None, b=None, mask=None, fp=None):
        n = len(a) if a is not None else len(fp)
        none = pa.nulls(n, pa.int64())
        cols = [none if x is None else pa.array(x) for x in (a, b, mask, fp)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "mask", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last, perhaps unfinished bucket; the key of a bucket found too large.
        kept, hot = np.zeros((2, 0), dtype=np.int64), None
        for batch in batches:
            rows = np.hstack([kept, np.array([np.asarray(c) for c in batch.columns], dtype=np.int64)])
            mask, fp = rows
            key = fp & mask
            if not len(fp):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(fp)]])
            size = np.diff(edges)
            large = (size > limit) & (np.bitwise_count(mask[edges[:-1]].view(np.uint64)) < 58)
            if hot == (mask[0], key[0]):
                large[0] = True
            hot = (mask[-1], key[-1]) if large[-1] else None
            each = np.repeat(large, size)
            if each.any():
                yield out(mask=mask[each], fp=fp[each])
            keep = len(fp) if large[-1] else edges[-2]
            small = ~each[:keep]
            for a, b in pairs(mask[:keep][small], key[:keep][small], fp[:keep][small]):
                yield out(a, b)
            kept = rows[:, keep:]
        mask, fp = kept
        for a, b in pairs(mask, fp & mask, fp):
            yield out(a, b)

    return run


def links(fps: DataFrame, limit: int = 2048) -> DataFrame:
    """(a, b): pairs of different fingerprints (column fp, distinct) within the distance.

    Buckets of many members give a spanning forest of their links instead of
    each link, so the rows grow with the entries and the classes are the same.
    """
    found, level = [], fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        bucket = F.col("fp").bitwiseAND(F.col("mask"))
        entries = level.mapInArrow(_expand, "mask long, fp long").repartition("mask", bucket)
        done = materialise(entries.sortWithinPartitions("mask", bucket)
                           .mapInArrow(_verify(limit), "a long, b long, mask long, fp long"), "buckets")
        found.append(done.filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        level = done.filter("fp is not null").select("mask", "fp")
        if level.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, class_fp, component_id) per row of ``docs``.

    class_fp: smallest fingerprint of the class; component_id: smallest id
    reachable over links.
    """
    own = materialise(fingerprints(docs), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    classes = components(links(fps))
    named = fps.join(classes, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("class_fp"))
    ids = named.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    names = materialise(named.select("fp", "class_fp").join(ids, "class_fp"), "classes")
    return own.join(names, "fp").select("doc_id", "text_hash", "fp", "class_fp", "component_id")


def keep_one_each(docs: DataFrame, classed: DataFrame | None = None, name: str = "class_fp") -> DataFrame:
    """``docs`` without near duplicates: of each class the row of the smallest id (null ids last) stays.

    ``classed`` (doc_id, text_hash, and the class in column ``name``): by default those of ``near_duplicates``.
    """
    columns = docs.columns
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    stay = (near_duplicates(docs) if classed is None else classed).groupBy(name).agg(F.min(key).alias("k")).select("k.*")
    rows = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").isNull().alias("none"),
                       F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"))
    names = ["none", "id", "text_hash"]
    one = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("_row")))
    return rows.join(stay, names, "left_semi").withColumn("_n", one).filter("_n = 1").select("_row.*")
