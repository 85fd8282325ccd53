"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of lower-case words, with marks for a
word's start and end; contexts stop at the word's start.  N-grams up to
``ORDER`` characters lie in sorted hash arrays, with one column per language
for the discounted share and for the weight passed to the shorter context.
The language of lowest cross-entropy per character wins.

A document is rejected if that cross-entropy is higher than the language's
own documents explain: a quarter of the sample is kept from the counts, and
gives each language's median and a limit for the deviation, scaled by length:
``WIDTHS`` times the deviation that a tenth exceeds, so a few mixed or
mislabelled documents do not move it.  Languages with few such rows lean on
the deviations of all languages.
``score`` is the winner's share in a softmax of the negative cross-entropies,
whose temperature is fitted on the same quarter.

Fitting uses a bounded sample: at most ``DOCS_PER_LANGUAGE`` documents of each
language, the lowest by a hash of the id, whole texts.  Scoring runs over all
documents; a worker keeps the scores of up to ``TABLE_SIZE`` tokens.

Defined cases: a null text or one without a letter is ``und`` with score 0; so
is every text if nothing was learned; rows with a null lang or without letters
teach nothing; repeated rows are predicted each; an empty table gives an empty
result; columns other than those asked for are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import map_rows

ORDER, DOCS_PER_LANGUAGE, TABLE_SIZE = 5, 800, 300_000
#: Quantile of the deviations, its multiple that is the limit, and the rows that the pooled quantile counts as.
SPREAD, WIDTHS, FEW = 0.9, 12.0, 20
START, STOP = "\x02", "\x03"
_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.random.default_rng(5).integers(0, 2 ** 63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(token: str) -> list[str]:
    """The letter runs of a token, lower case; digits, numerals and signs such as superscripts are no letters."""
    found = _LETTERS.findall(token.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(own) for word in found for letters, own in groupby(word, str.isalpha) if letters]


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")


@dataclass
class Model:
    langs: list[str]
    keys: list[np.ndarray]  # by order: sorted n-gram hashes
    share: list[np.ndarray]  # by order: discounted share of the n-gram after its context, per language
    pass_on: list[np.ndarray]  # by order: weight that the n-gram as a context passes to the shorter one
    floor: float  # probability of any symbol before the first order
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None
    sharpness: float = 20.0

    @classmethod
    def build(cls, counts: pd.DataFrame) -> Model:
        """From (lang, gram, n): counts of all n-grams up to ORDER, with marks."""
        langs = sorted(counts["lang"].unique())
        size = counts["gram"].str.len()
        table = {(lang, k): dict(zip(c["gram"], c["n"])) for (lang, k), c in counts.groupby(["lang", size])}
        letters = {g for (_, k), c in table.items() if k == 1 for g in c if g != START}
        model = cls(langs, [], [], [], 1.0 / (len(letters) + 1))
        shares, passes = [{} for _ in range(ORDER + 1)], [{} for _ in range(ORDER + 1)]
        for col, lang in enumerate(langs):
            own = {k: table.get((lang, k), {}) for k in range(1, ORDER + 1)}
            for k in range(1, ORDER + 1):
                # Below the top order an n-gram counts the different symbols before it, unless it begins a word.
                c = {g: n for g, n in own[k].items() if g != START}
                if k < ORDER:
                    before = Counter(g[1:] for g in own[k + 1])
                    c = {g: n if g[0] == START else before[g] for g, n in c.items()}
                seen = Counter(c.values())
                d = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] else 0.5
                total, kinds = Counter(), Counter()
                for g, n in c.items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                for g, n in c.items():
                    shares[k].setdefault(g, np.zeros(len(langs)))[col] = max(n - d, 0) / total[g[:-1]]
                for h, n in total.items():
                    passes[k - 1].setdefault(h, np.ones(len(langs)))[col] = d * kinds[h] / n
        model.first = passes[0].get("", np.ones(len(langs)))
        for k in range(1, ORDER + 1):
            grams = sorted(shares[k].keys() | passes[k].keys())
            codes = _codes(grams).reshape(-1, k)
            h = np.zeros(len(grams), dtype=np.uint64)
            for j in range(k):
                h += _mixed(codes[:, k - 1 - j]) * _MULTIPLIERS[j]
            order = np.argsort(h)
            model.keys.append(h[order])
            model.share.append(np.array([shares[k].get(g, np.zeros(len(langs))) for g in grams])
                               .reshape(-1, len(langs))[order])
            model.pass_on.append(np.array([passes[k].get(g, np.ones(len(langs))) for g in grams])
                                 .reshape(-1, len(langs))[order])
        return model

    first: np.ndarray | None = None

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log2 probability per language, symbols) of each word; words are non-empty."""
        marked = [START + w + STOP for w in words]
        length = np.array([len(w) for w in marked])
        start = np.cumsum(length) - length
        inside = np.arange(length.sum()) - np.repeat(start, length)  # place within the word
        mixed = _mixed(_codes(marked))
        p = np.full((len(mixed), len(self.langs)), self.floor) * self.first
        h, found = np.zeros(len(mixed), dtype=np.uint64), None
        for k in range(1, ORDER + 1):
            h = h.copy()
            h[k - 1:] += mixed[:len(mixed) - k + 1] * _MULTIPLIERS[k - 1]
            at = np.flatnonzero(inside >= k - 1)
            keys = self.keys[k - 1]
            if not len(at) or not len(keys):
                break
            place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            hit = keys[place] == h[at]
            now = np.full(len(mixed), -1)
            now[at[hit]] = place[hit]
            if k > 1:  # the context is the shorter n-gram that ends one symbol earlier
                context = found[at - 1]
                known = context >= 0
                p[at[known]] *= self.pass_on[k - 2][context[known]]
            p[at[hit]] += self.share[k - 1][place[hit]]
            found = now
        logs = np.log2(p)
        logs[inside == 0] = 0  # the start mark is given
        return np.add.reduceat(logs, start, axis=0), length - 1


class Scorer:
    """Cross-entropies of documents; keeps token scores."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        # Rows of the known tokens; both arrays grow by doubling.
        self.logs, self.symbols = np.zeros((1 << 14, len(self.model.langs))), np.zeros(1 << 14, dtype=np.int64)

    def _learn(self, tokens: list[str]) -> None:
        parts = [runs(t) for t in tokens]
        flat = [w for p in parts for w in p]
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        logs, symbols = np.zeros((len(tokens), len(self.model.langs))), np.zeros(len(tokens), dtype=np.int64)
        if flat:
            own_logs, own_symbols = self.model.words(flat)
            np.add.at(logs, owner, own_logs)
            np.add.at(symbols, owner, own_symbols)
        have = len(self.known)
        while have + len(tokens) > len(self.symbols):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.symbols = np.concatenate([self.symbols, np.zeros_like(self.symbols)])
        self.logs[have:have + len(tokens)], self.symbols[have:have + len(tokens)] = logs, symbols
        for t in tokens:
            self.known[t] = len(self.known)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol and language, symbols) of each text."""
        split = [t.split() for t in texts]
        if len(self.known) > TABLE_SIZE:
            self.clear()
        new = list(dict.fromkeys(t for s in split for t in s if t not in self.known))
        for i in range(0, len(new), 20_000):
            self._learn(new[i:i + 20_000])
        get = self.known.__getitem__
        bits, n = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), dtype=np.int64)
        for i, s in enumerate(split):
            at = np.fromiter(map(get, s), dtype=np.int64, count=len(s))
            bits[i], n[i] = -self.logs[at].sum(axis=0), self.symbols[at].sum()
        return bits / np.maximum(n, 1)[:, None], n


def _scale(n: np.ndarray) -> np.ndarray:
    """Deviations shrink with the length, up to 400 symbols."""
    return np.sqrt(np.minimum(np.maximum(n, 1), 400))


def _weighted_median(x: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(x)
    total = np.cumsum(weight[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def calibrate(model: Model, texts: list[str], langs: list[str]) -> None:
    """Mean (a weighted median), limit of the scaled deviation, and softmax sharpness from documents that were not counted."""
    bits, n = Scorer(model).entropies(texts)
    true = np.array([model.langs.index(x) for x in langs], dtype=np.int64)
    use = n > 0
    bits, n, true = bits[use], n[use], true[use]
    model.mean, model.limit = np.full(len(model.langs), np.inf), np.full(len(model.langs), np.inf)
    if len(true):
        rows = np.bincount(true, minlength=len(model.langs))
        for k in np.flatnonzero(rows):
            model.mean[k] = _weighted_median(bits[true == k, k], n[true == k])
        # Without a row of its own a language is taken to be as hard as the hardest of the others.
        model.mean[rows == 0] = model.mean[rows > 0].max()
        above = (bits[np.arange(len(true)), true] - model.mean[true]) * _scale(n)
        pooled = np.quantile(above, SPREAD)
        for k, m in enumerate(rows):
            own = np.quantile(above[true == k], SPREAD) if m else 0.0
            width = max(0.0, (m * own + FEW * pooled) / (m + FEW))
            # The fewer rows, the less sure the mean.
            model.limit[k] = WIDTHS * width * (1 + 1 / np.sqrt(max(m, 1))) + 1e-6
    if len(true):
        def gain(s):
            z = -s * bits
            z -= z.max(axis=1, keepdims=True)
            return (z[np.arange(len(true)), true] - np.log(np.exp(z).sum(axis=1))).sum()
        model.sharpness = max((0.5, 1, 2, 3, 5, 8, 12, 20, 30, 50), key=gain)


def predict(model: Model, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(winner, score, rejected) per row."""
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(bits)), best]
    z = np.exp(-model.sharpness * (bits - low[:, None]))
    above = np.where(np.isfinite(model.mean[best]), (low - model.mean[best]) * _scale(n), 0.0)
    return best, 1 / z.sum(axis=1), above > model.limit[best]


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model | None:
    """The model of (doc_id, text, lang) rows; None if there is nothing to learn."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))
    taught = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    total = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}  # one row per language
    if not total:
        return None
    # Twice the wanted share by hash first, so that no language passes through one task.
    share = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, min(1.0, (2 * docs_per_language + 100) / n))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = (taught.filter(unit <= share[F.col("lang")])
              .withColumn("rank", rank).filter(F.col("rank") <= docs_per_language)).cache()
    counted = sample.filter("rank % 4 <> 0")

    def grams(rows):
        count: Counter = Counter()
        for lang, text in rows:
            for token, n in Counter(text.split()).items():
                for w in runs(token):
                    w = START + w + STOP
                    for i in range(len(w)):
                        for j in range(i + 1, min(i + ORDER, len(w)) + 1):
                            count[lang, w[i:j]] += n
        for (lang, gram), n in count.items():
            yield lang, gram, n

    counts = (map_rows(counted.select("lang", "text"), grams, "lang string, gram string, n long", 20_000)
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())  # bounded by the sample
    if counts.empty:
        sample.unpersist()
        return None
    model = Model.build(counts)
    rest = [(r.text, r.lang) for r in sample.filter("rank % 4 = 0").select("text", "lang").collect()
            if r.lang in model.langs]
    sample.unpersist()
    calibrate(model, [t for t, _ in rest], [x for _, x in rest])
    return model


def identify(docs: DataFrame, model: Model | None, keep: list[Column], whole: bool = False) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, cross_entropy and rejected for every row of ``docs``.

    ``whole``: the first of ``keep`` is a struct that holds the text, which then
    goes to the tasks once.
    """
    kept = docs.select(*keep) if whole else docs.select(*keep, F.col("text").alias("_text"))
    fields = kept.schema.fields[:len(keep)]
    from pyspark.sql.types import StructType

    schema = StructType(list(fields)).add("lang_pred", "string").add("score", "double").add(
        "cross_entropy", "double").add("rejected", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        own = shared.value
        scorer = Scorer(own) if own else None
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                column = part.column(0).field("text") if whole else part.column(part.num_columns - 1)
                texts = [t or "" for t in column.to_pylist()]
                lang, score, low, bad = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
                if scorer:
                    bits, n = scorer.entropies(texts)
                    best, share, out = predict(own, bits, n)
                    for r in np.flatnonzero(n > 0):
                        lang[r], score[r], low[r], bad[r] = own.langs[best[r]], float(share[r]), float(
                            bits[r, best[r]]), bool(out[r])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(fields)], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(low, pa.float64()), pa.array(bad, pa.bool_())], names=schema.names)

    return kept.mapInArrow(run, schema)
