"""MinHash fingerprints of texts, their edits and neighbours, and verified near pairs.

Signature: ``PERMUTATIONS`` multiply-add hashes (strongly universal on 32-bit
keys) of a text's word shingles, minimum each, in vectorised numpy; 16 bits of
each minimum make up the fingerprint.  The share of equal positions estimates
the Jaccard similarity of the shingle sets.

Near pairs: signatures are cut into bands, equal bands joined in Spark, and
the Jaccard similarity of each candidate pair verified on its shingle sets.
Equal texts are one entry there.

Near classes (the pipeline's stage): the same bands; buckets of any size are
split until small, a bucket yields a spanning forest of its verified links.

Edits: documents are dealt by id range and sorted, so each task streams over
neighbours; a task's last document meets the first of the next task in a
second, small step.

Defined cases: null texts count as empty; a text without words has one empty
shingle, one with fewer than five words is a single shingle; documents of
equal id follow each other by the hash of their text; null ids come first; a
single document is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import map_rows, materialise
from fleetlens.llm.components import components

SHINGLE, PERMUTATIONS, BANDS = 5, 64, 16
#: Bands that split a large bucket of ``near_classes``.
DEPTH = 4
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 2 ** 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2 ** 64, PERMUTATIONS, dtype=np.uint64)
_P = _RNG.integers(0, 2 ** 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
#: Entries of a worker's table of word hashes.
TABLE_SIZE = 300_000


class Shingler:
    """Shingle keys (32 bits) of texts; remembers word hashes."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest, self.known = xxh64_intdigest, {}

    def keys(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        get, known = self.known.get, self.known
        h = [get(w) for w in words]
        if None in h:
            if len(known) > TABLE_SIZE:
                known.clear()
            h = [known.get(w) or known.setdefault(w, self.digest(w)) for w in words]
        w = np.array(h, dtype=np.uint64)
        n = max(1, len(w) - SHINGLE + 1)
        out = np.full(n, len(w) if len(w) < SHINGLE else 0, dtype=np.uint64)
        for j in range(min(SHINGLE, len(w))):
            out += w[j:j + n] * _P[j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out >> np.uint64(32)

    def signature(self, text: str) -> np.ndarray:
        x = self.keys(text)
        low = np.full(PERMUTATIONS, 2 ** 64 - 1, dtype=np.uint64)
        for i in range(0, len(x), 1024):
            low = np.minimum(low, (x[i:i + 1024, None] * _A + _B).min(axis=0))
        return (low >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal positions of two signatures."""
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _digest(sh: Shingler, text: str, sig: np.ndarray, head: str, next_sig: np.ndarray) -> tuple:
    edited = edit(text, head)
    own = sh.signature(edited)
    return (len(text), hashlib.sha256(edited.encode()).hexdigest(), sig.tobytes(), own.tobytes(),
            likeness(sig, own), likeness(sig, next_sig))


_OUT = "n_chars long, edited_sha256 string, sig binary, edited_sig binary, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sig, edited_sig, near_edited, near_next) per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = (docs.select("doc_id", text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
             .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def run(rows):
        """Finished rows, the first text of the task (kind 0) and its last one (kind 1), which still waits."""
        sh, last, sig, part = Shingler(), None, None, None
        for doc_id, text, part in rows:
            own = sh.signature(text)
            if last is None:
                yield (part, 0, None, text) + (None,) * 6
            else:
                yield (part, 2, last[0], None) + _digest(sh, last[1], sig, text, own)
            last, sig = (doc_id, text), own
        if last is not None:
            yield (part, 1, *last) + (None,) * 6

    done = materialise(map_rows(dealt, run, "part int, kind int, doc_id long, text string, " + _OUT), "edited")
    heads = done.filter("kind = 0").select("part", F.col("text").alias("head"))
    # One row per task: its successor, and the first task after the last one.
    parts = done.filter("kind = 0").select("part")
    ring = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                           F.min("part").over(Window.partitionBy())).alias("after"))
    waiting = (done.filter("kind = 1").select("part", "doc_id", "text").join(ring, "part")
               .join(heads.select(F.col("part").alias("after"), "head"), "after").select("doc_id", "text", "head"))

    def finish(rows):
        sh = Shingler()
        for doc_id, text, head in rows:
            yield (doc_id,) + _digest(sh, text, sh.signature(text), head, sh.signature(head))

    columns = ["doc_id"] + [c.split()[0] for c in _OUT.split(", ")]
    return done.filter("kind = 2").select(columns).union(map_rows(waiting, finish, "doc_id long, " + _OUT))


def hex_digits(sig: Column) -> Column:
    return F.lower(F.hex(sig))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): pairs of different texts, named by their smallest doc_id, at or above the threshold.

    Sixteen bands of four positions: a pair at 0.8 shares a band with
    probability 0.9998.  A band value with many different texts is joined by
    Spark's (skew-splitting) sort-merge join; rows without an id are left out.
    """
    own = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(
        F.min("doc_id").alias("doc_id")).filter("doc_id is not null").select("doc_id", "text")

    def run(rows):
        sh, width = Shingler(), PERMUTATIONS // BANDS
        for doc_id, text in rows:
            sig = sh.signature(text)
            bands = [sig[i:i + width].tobytes().hex() for i in range(0, PERMUTATIONS, width)]
            yield doc_id, bands, np.unique(sh.keys(text)).astype(np.int64).tolist()

    sets = materialise(map_rows(own, run, "doc_id long, bands array<string>, keys array<long>", 200), "sets")
    band = sets.select("doc_id", F.posexplode("bands").alias("band", "value"))
    a, b = band.select(F.col("doc_id").alias("a"), "band", "value"), band.select(F.col("doc_id").alias("b"), "band", "value")
    pairs = a.join(b, ["band", "value"]).filter("a < b").select("a", "b").distinct()
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("_x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("_y")), "b"))
    common = F.size(F.array_intersect("_x", "_y"))
    return both.select("a", "b", (common / (F.size("_x") + F.size("_y") - common)).alias("similarity")).filter(
        F.col("similarity") >= threshold)


def _band_entries(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash, bands, shingles) per row; key: digest of the words, shingles: their sorted 32-bit keys."""
    def run(rows):
        from xxhash import xxh3_128_digest, xxh64_intdigest

        sh, width = Shingler(), PERMUTATIONS // BANDS
        for doc_id, text_hash, text in rows:
            text = text or ""
            sig = sh.signature(text)
            bands = [xxh64_intdigest(sig[i:i + width].tobytes(), i) - (1 << 63) for i in range(0, PERMUTATIONS, width)]
            yield (xxh3_128_digest(b" ".join(text.encode().lower().split())), doc_id, text_hash, bands,
                   np.unique(sh.keys(text)).astype("<u4").tobytes())

    return map_rows(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run,
                    "key binary, doc_id long, text_hash long, bands array<long>, shingles binary", 200)


def _buckets(own: DataFrame, limit: int) -> DataFrame:
    """(mask, value, key): entries that agree in the bands of ``mask``, at most ``limit`` + 1 a bucket, at least two.

    A larger bucket is split by each further band, so a pair in it still meets
    where it shares one.  What is larger after ``DEPTH`` bands (16 equal
    positions) is dealt by hash, its smallest key in every part as a hub.
    """
    bits = F.lit(1).cast("long")
    bands = own.groupBy("key").agg(F.first("bands").alias("bands"))
    level = own.select("key", F.posexplode("bands").alias("band", "value")).select(
        F.expr("shiftleft(1L, band)").alias("mask"), "value", "key").distinct()
    found, at = [], ["mask", "value"]
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy(*at).agg(F.count(bits).alias("n"), F.min("key").alias("hub")).filter("n > 1")
        level = materialise(level.join(sizes, at), "bands")
        found.append(level.filter(F.col("n") <= limit).select(*at, "key"))
        hot = level.filter(F.col("n") > limit)
        if hot.isEmpty():
            break
        if depth < DEPTH:
            level = (hot.join(bands, "key").select(*at, "key", F.posexplode("bands").alias("band", "more"))
                     .filter("mask & shiftleft(1L, band) = 0")
                     .select(F.expr("mask | shiftleft(1L, band)").alias("mask"), F.expr("value ^ more").alias("value"),
                             "key").distinct())
        else:
            parts = F.ceil(F.col("n") / limit)
            dealt = hot.filter("key <> hub").select(*at, "key", F.pmod(F.xxhash64("key"), parts).alias("part"))
            hubs = hot.filter("key = hub").select(*at, "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
                                                  .alias("part"))
            found.append(dealt.union(hubs).select("mask", F.xxhash64("value", "part").alias("value"), "key"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def verified_links(own: DataFrame, threshold: float, limit: int) -> DataFrame:
    """(a, b): links at or above the threshold; a spanning forest of those within each bucket."""
    members = _buckets(own, limit)
    sets = (own.join(members.select("key").distinct(), "key", "left_semi")
            .groupBy("key").agg(F.first("shingles").alias("shingles")))
    dealt = (members.join(sets, "key").select("mask", "value", "key", "shingles")
             .repartition("mask", "value").sortWithinPartitions("mask", "value"))

    def run(rows):
        for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
            rest = [(key, np.frombuffer(s, dtype="<u4")) for _, _, key, s in group]
            while len(rest) > 1:
                reached = [rest.pop()]
                while reached and rest:
                    (key, x), far = reached.pop(), []
                    for other in rest:
                        if jaccard(x, other[1], threshold) >= threshold:
                            reached.append(other)
                            yield min(key, other[0]), max(key, other[0])
                        else:
                            far.append(other)
                    rest = far

    return map_rows(dealt, run, "a binary, b binary").distinct()


def jaccard(x: np.ndarray, y: np.ndarray, threshold: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 if their sizes alone put it below the threshold."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def near_classes(docs: DataFrame, threshold: float = 0.8, limit: int = 512) -> DataFrame:
    """(doc_id, text_hash, class) per row: classes of texts connected by links at or above the threshold.

    Texts of the same words (white space and ASCII case apart) are one entry;
    null, empty and blank texts are one class.  Null ids take part.
    """
    own = materialise(_band_entries(docs), "entries")
    classes = components(materialise(verified_links(own, threshold, limit), "near"))
    return own.join(classes, F.col("key") == F.col("node"), "left").select(
        "doc_id", "text_hash", F.coalesce("label", "key").alias("class"))
