"""Phrase collocations by best-first branch and bound over phrase growth.

Phrases grow by one word at a time, and only from parts that occur at least
``MIN`` times.  A pair is scored when it is counted.  A triple that begins with
the pair (u, v) occurs at most f(u v) times and its rest at least as often as
itself, so its score is at most f(u v) / f(u): a bound known before any triple
is counted.  A wave expands, per language, all pairs whose bound reaches the
wave's threshold, and counts all triples that contain a pair which scores that
much, as those decide whether the pair survives.  Every surviving phrase at or
above the threshold is then known.  If they are as many as asked for, the
language is settled (ties are all in); otherwise the threshold falls to the
pair twice as far down, at last to zero, where everything is expanded.

Counting: tasks number the words of a run of documents, count phrases as sorted
arrays of numbers, and Spark adds the counts up; the sets that a wave looks for go to the tasks as hash bitmaps of fixed size, which
may let more pass but never less.

Defined cases: null and empty texts have no words; a null language is ``und``;
words are as long as they are; repeated rows count each; a language without
candidates gives no rows; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise

MIN, TOP, DOMINANT = 10, 2000, 50
#: Size of a hash bitmap in bits; tokens and different words that a task gathers before it counts them.
BITS, TOKENS, WORDS = 1 << 24, 1_500_000, 1 << 18
SHAPE = "lang string, phrase string, f long"
#: Ends of pieces become a byte that UTF-8 never has; A-Z become a-z.
_END = 0xFF
_TABLE = bytes(_END if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Multipliers of the word hashes of a pair; sums stay below 2^62.
_FIRST, _SECOND = 1_000_003, 179_426_549


def tokens(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, with the end byte where a piece ends: no phrase reaches over it."""
    return text.translate(_TABLE).replace(b"\xff", b" \xff ").split()


def slot(lang: Column, *words: Column) -> Column:
    """Place of a word or pair in a bitmap of ``BITS``, computed alike in Spark and in ``_slots``."""
    h = [F.crc32(F.concat_ws(" ", lang, w).cast("binary")) for w in words]
    return F.pmod(h[0] if len(h) == 1 else F.shiftright(h[0] * _FIRST + h[1] * _SECOND, 12), F.lit(BITS))


def _slots(hashes: np.ndarray, *at: np.ndarray, bits: int) -> np.ndarray:
    h = [hashes[i] for i in at]
    return (h[0] if len(h) == 1 else (h[0] * _FIRST + h[1] * _SECOND) >> 12) % bits


def _bit(bitmap_: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap_[slots >> 3] >> (slots & 7) & 1).astype(bool)


def bitmap(phrases: DataFrame, words: int) -> bytes:
    """The slots of (lang, phrase) rows of one or two ``words`` as bits: a fixed size, whatever the rows."""
    part = F.split("phrase", " ")
    slots = slot(F.col("lang"), *[part[i] for i in range(words)])
    found = (phrases.select(slots.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("b")))
    out = np.zeros(BITS // 64, dtype=np.int64)
    for word in found.toLocalIterator():  # at most BITS / 64 rows
        out[word.w] = word.b
    return out.tobytes()


class _Words(dict):
    """Numbers words as they come; 0 is the end byte."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    start = zlib.crc32(lang + b" ")
    return np.fromiter((zlib.crc32(w, start) for w in words), dtype=np.int64, count=len(words))


def _distinct(parts: tuple[np.ndarray, ...], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of ``parts`` (numbers below ``base``) and how often each occurs."""
    if base ** len(parts) >= 1 << 62:       # one text of very many different words
        rows, counts = np.unique(np.stack(parts, axis=1), axis=0, return_counts=True)
        return list(rows.T), counts
    code = parts[0]
    for more in parts[1:]:
        code = code * base + more
    code, counts = np.unique(code, return_counts=True)
    out = []
    for _ in parts:
        out.append(code % base)
        code = code // base
    return out[::-1], counts


def _counted(docs: DataFrame, codes_of: Callable) -> DataFrame:
    """(lang, phrase, f) summed over the documents.

    ``codes_of(lang, words, ids)`` gives the phrases in a run of word numbers:
    one array of numbers per word of a phrase.
    A task gathers ``TOKENS`` tokens or ``WORDS`` words and counts them with sorted arrays.
    """
    def flat(lang: str, words: _Words, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names, base = list(words), len(words)
        parts, counts = _distinct(codes_of(lang.encode(), names, np.concatenate(ids)), base)
        if codes_of is _single:
            names[0] = b""      # the empty phrase: all words
            parts, counts = [np.append(parts[0], 0)], np.append(counts, counts.sum())
        table = pa.array(names, type=pa.binary())
        for start in range(0, len(counts), 1 << 16):
            n = counts[start:start + (1 << 16)]
            own = [table.take(pa.array(p[start:start + (1 << 16)])) for p in parts]
            phrase = own[0] if len(own) == 1 else pc.binary_join_element_wise(*own, b" ")
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrase.cast(pa.string()), pa.array(n)],
                                             names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}       # lang -> words, arrays of their numbers
        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    words, ids = held.setdefault(lang, (_Words(), []))
                    found = tokens(text or b"")
                    ids.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
                    ids.append(np.zeros(1, dtype=np.int64))
                    size += len(found) + 1
                    if size > TOKENS or len(words) > WORDS:
                        for name, (w, i) in held.items():
                            yield from flat(name, w, i)
                        held, size = {}, 0
        for name, (w, i) in held.items():
            yield from flat(name, w, i)

    slim = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, SHAPE).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _single(lang: bytes, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    return (ids[ids > 0],)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words; the empty phrase counts all word occurrences of a language."""
    return _counted(docs, _single)


def pair_counts(docs: DataFrame, frequent: bytes) -> DataFrame:
    """(lang, phrase, f) of the pairs of adjacent words that are both in the bitmap ``frequent``."""
    def pairs(lang, words, ids):
        bits = np.frombuffer(frequent, dtype=np.uint8)
        good = _bit(bits, _slots(_hashes(lang, words), np.arange(len(words)), bits=8 * len(bits)))
        good[0] = False
        ok = good[ids]
        both = ok[:-1] & ok[1:]
        return ids[:-1][both], ids[1:][both]

    return _counted(docs, pairs)


def triple_counts(docs: DataFrame, frequent: bytes, begin: bytes, end: bytes) -> DataFrame:
    """(lang, phrase, f) of triples of two ``frequent`` pairs of which the first is in ``begin`` or the second in ``end``."""
    def triples(lang, words, ids):
        any_, first, last = (np.frombuffer(m, dtype=np.uint8) for m in (frequent, begin, end))
        at = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)) if len(ids) > 2 else np.zeros(0, dtype=np.int64)
        hashes = _hashes(lang, words)
        s = _slots(hashes, ids[at], ids[at + 1], bits=8 * len(any_))
        fits = _bit(any_, s)
        at, s = at[fits], s[fits]
        t = _slots(hashes, ids[at + 1], ids[at + 2], bits=8 * len(any_))
        at = at[_bit(any_, t) & (_bit(first, s) | _bit(last, t))]
        return ids[at], ids[at + 1], ids[at + 2]

    return _counted(docs, triples)


def score(a: Column, part: Column, rest: Column) -> Column:
    """floor(1000000 a a / (part rest)), exact: counts to 10^15 fit in 38 digits."""
    a, part, rest = (x.cast("decimal(15,0)") for x in (a, part, rest))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), part * rest)


def _lookup(phrases: DataFrame, key: Column, counts: DataFrame, name: str) -> DataFrame:
    """Adds the count of a part: the part's rows are unique, and parts that occur less than their phrase do not exist."""
    c = counts.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.col("f").alias(name))
    return phrases.join(c, (F.col("lang") == F.col("_l")) & (key == F.col("_p"))).drop("_l", "_p")


def scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound); bound: no triple that begins with the pair scores more."""
    part = F.split("phrase", " ")
    out = _lookup(_lookup(pairs.withColumnRenamed("f", "a"), part[0], words, "l"), part[1], words, "r")
    bound = F.expr("(CAST(a AS DECIMAL(20,0)) * 1000000) div l")
    return out.select("lang", "phrase", "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"),
                      bound.alias("bound"))


def scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the cut that scores least, the earlier one on ties."""
    part = F.split("phrase", " ")
    out = triples.withColumnRenamed("f", "a")
    named = pairs.withColumnRenamed("a", "f")
    for key, counts, name in ((part[0], words, "l1"), (F.concat_ws(" ", part[1], part[2]), named, "r1"),
                              (F.concat_ws(" ", part[0], part[1]), named, "l2"), (part[2], words, "r2")):
        out = _lookup(out, key, counts, name)
    cuts = [F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    return out.select("lang", "phrase", "a", F.least(*cuts).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def _thresholds(scored: DataFrame, rank: int) -> DataFrame:
    """(lang, t): score of the ``rank``-th phrase of each language, 0 where there are fewer.

    Works on the number of phrases a score: at most 1,000,001 rows a language.
    """
    per = scored.groupBy("lang", "score").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    reached = per.withColumn("upto", F.sum("c").over(upto)).filter(F.col("upto") >= rank)
    best = reached.groupBy("lang").agg(F.max("score").alias("t"))
    return scored.select("lang").distinct().join(best, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).alias("t"))


def _first(phrases: DataFrame, top: int, salts: int = 32) -> DataFrame:
    """The first ``top`` of each language with their rank; a large language is cut in ``salts`` parts first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = (phrases.withColumn("_s", salt)
            .withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).drop("_s", "_r")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN, dominant: int = DOMINANT) -> DataFrame:
    """The ``top`` best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    Dropped: pairs that lie in a triple with at least ``dominant`` per cent of their occurrences.
    """
    all_words = materialise(word_counts(docs).filter((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    words = all_words.filter("phrase <> ''")
    pairs = materialise(pair_counts(docs, bitmap(words, 1)).filter(F.col("f") >= least), "pairs")
    pairs = materialise(scored_pairs(pairs, words), "scored")
    frequent = bitmap(pairs, 2)
    names, rank = ["lang", "phrase", "a", "l", "r", "score"], top
    results = pairs.select(names).filter("false")
    done = results.select("lang")
    while True:
        open_pairs = pairs.join(done, "lang", "left_anti")
        # One row a language; whole numbers of candidates and thresholds.
        limits = materialise(_thresholds(open_pairs, rank), "limits")
        if limits.isEmpty():
            break
        due = open_pairs.join(limits, "lang")
        wanted = due.filter("score >= t")
        begin = bitmap(due.filter("score >= t OR bound >= t"), 2)
        some = docs.join(limits.select(F.col("lang").alias("_l")), F.coalesce("lang", F.lit("und")) == F.col("_l"), "left_semi")
        triples = materialise(triple_counts(some, frequent, begin, bitmap(wanted, 2)).filter(F.col("f") >= least), "triples")
        # A triple that holds a pair's words counts against it, at its beginning or its end.
        word = F.split("phrase", " ")
        holds = triples.select("lang", "f", F.explode(F.array(F.concat_ws(" ", word[0], word[1]),
                                                              F.concat_ws(" ", word[1], word[2]))).alias("phrase"))
        strongest = holds.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
        alive = (wanted.join(strongest, ["lang", "phrase"], "left")
                 .filter(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * dominant)))
        best = scored_triples(triples, pairs, words).join(limits, "lang").filter("score >= t")
        found = materialise(alive.select(names).unionByName(best.select(names)), "found")
        settled = materialise(limits.join(found.groupBy("lang").agg(F.count("*").alias("c")), "lang", "left")
                              .filter((F.col("t") == 0) | (F.coalesce("c", F.lit(0)) >= top)).select("lang"), "settled")
        results = results.unionByName(found.join(settled, "lang", "left_semi"))
        done = done.unionByName(settled)
        rank *= 2
    n = all_words.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return (_first(results, top).join(n, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))
