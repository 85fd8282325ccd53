"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns (below).  The field adds spans that the
patterns miss, such as phone numbers without a plus or spelled-out addresses.
It looks at regions: stretches of digit groups (seven digits, or four groups),
and words around an at sign.  A region's atoms are its runs of letters and
digits; a segment is up to ``MAX_ATOMS`` atoms with a kind (a card written digit
by digit has 19) and, without letters, up to ``MAX_DIGITS`` digits.  It is scored
by features of the whole span (digits, group lengths, marks, check digit,
neighbours); dynamic programming from left to right chooses boundaries and
kinds together.  It keeps the scores of the next ``MAX_ATOMS`` atoms and two
bytes an atom to trace back, so a region may be as long as a text.  An added
span never overlaps a base span and base spans stay.

Training: gradient ascent on the field's log likelihood over a bounded sample
of regions: ``SAMPLE_DOCS`` documents, lowest by a hash of the id, with
``SAMPLE_REGIONS`` regions each, drawn from the whole text, in pieces of at most
``PIECE_ATOMS`` atoms (cut where no label is cut) and ``PIECE_CHARS`` characters.
Labels are the base spans, and rewritten copies of them (another notation, same
label), against the digits and words that the patterns leave alone.  Fixed seeds
make reruns equal.

Defined cases: null texts count as empty; a null id is kept; texts of one very
long run are one atom; repeated rows are searched each; offsets are code
points; an empty table gives an empty result; other columns are not read.
Counts per kind are those of the base spans; ``spans`` holds all.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_rows

# The kinds in their order and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_ATOMS, MAX_DIGITS, MAX_CHARS = 19, 19, 120
SAMPLE_DOCS, SAMPLE_REGIONS, PIECE_ATOMS, PIECE_CHARS, EPOCHS, SEED_COPIES = 1500, 40, 60, 4096, 6, 60
_REGION = re.compile(r"[+(]?[0-9](?:[ ().+\[\]-]{0,3}[0-9])+")
_AT = re.compile(r"@|\(at\)|\[at\]| at ", re.I)
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\s?$")
_AFTER_AT = re.compile(r"\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[\w-]{1,63}){1,5}", re.I)
_ATOM = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out, end, before, at = [], 0, 0, text.find("@")
    while at >= 0:
        first = max(end, before)
        start = first + len(text[first:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        before, at = at + 1, text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold personal data; sorted, not overlapping."""
    found = [m.span() for m in _REGION.finditer(text)
             if len(_digits(m.group())) >= 7 or len(re.findall(r"[0-9]+", m.group())) >= 4]
    for m in _AT.finditer(text):
        left = _BEFORE_AT.search(text[max(0, m.start() - 66):m.start()])
        right = _AFTER_AT.match(text, m.end())
        if left and right:
            found.append((m.start() - len(left.group()), right.end()))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def features(text: str, s: int, e: int) -> list[str]:
    """Features of the whole span text[s:e]."""
    span = text[s:e]
    groups = re.findall(r"[0-9]+", span)
    n = sum(map(len, groups))
    marks = "".join(sorted(set(re.sub(r"[^\W_]+", "", span))))[:8]
    out = [f"digits={min(n, 20)}", f"groups={min(len(groups), 6)}", f"marks={marks}",
           f"shape={'-'.join(str(min(len(g), 9)) for g in groups[:7])}"]
    before, after = text[s - 1:s], text[e:e + 1]
    out.append(f"edge={_class(before)}{_class(after)}")
    if 13 <= n <= 19:
        out.append(f"check={luhn(''.join(groups))}")
    if len(groups) == 4:
        out.append(f"octets={_octets(groups)}")
    if span[:1] in "+(":
        out.append(f"opens={span[0]}")
    letters = sum(c.isalpha() for c in span)
    out.append(f"letters={letters > 0}")
    if letters:
        low = span.lower()
        at = "@" in low or "(at)" in low or "[at]" in low
        dot = "." in low or "(dot)" in low or "[dot]" in low
        out += [f"at={at}", f"dot={dot}", f"at+dot={at and dot}", f"spaces={min(span.count(' '), 4)}"]
    return out


def _class(c: str) -> str:
    return "." if not c or c.isspace() else "a" if c.isalpha() else "0" if c.isdigit() else "p"


def _atoms(text: str, s: int, e: int) -> Iterator[tuple[int, int]]:
    """Letter and digit runs; an opening plus or bracket belongs to the next run."""
    for m in _ATOM.finditer(text, s, e):
        a = m.start()
        if a > s and text[a - 1] in "+(":
            a -= 1
            if a > s and text[a - 1] == "+":
                a -= 1
        yield a, m.end()


def _ends(text: str, ahead: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(atoms, end) of the candidate segments that begin with the first of the atoms ``ahead``."""
    start, digits, letters = ahead[0][0], 0, False
    for n, (a, b) in enumerate(ahead[:MAX_ATOMS], 1):
        atom = text[a:b]
        digits += len(_digits(atom))
        letters = letters or any(c.isalpha() for c in atom)
        if n > 1 and (b - start > MAX_CHARS or digits > MAX_DIGITS and not letters):
            return
        yield n, b


def segment(text: str, s: int, e: int, weights: dict) -> list[tuple[str, int, int]]:
    """The highest-scoring segmentation of text[s:e]: spans with a kind.

    ``score`` holds the best sums up to the current atom and the ones that its
    segments can reach; of equal sums the one that marks less, then the longer
    last span, stays.
    """
    source, ahead = _atoms(text, s, e), deque()
    starts, ends, length, kinds = array("q"), array("q"), array("b", [0]), array("b", [0])
    score = deque([0.0])
    while True:
        while len(ahead) < MAX_ATOMS and (atom := next(source, None)):
            ahead.append(atom)
            starts.append(atom[0])
            ends.append(atom[1])
            score.append(-math.inf)
            length.append(0)
            kinds.append(0)
        if not ahead:
            break
        at = len(starts) - len(ahead)  # atoms before the current one
        if score[0] >= score[1]:
            score[1], length[at + 1] = score[0], 0
        for n, end in _ends(text, list(ahead)):
            feats = features(text, ahead[0][0], end)
            for k, kind in enumerate(KINDS):
                x = score[0] + weigh(weights, kind, feats)
                if x > score[n]:
                    score[n], length[at + n], kinds[at + n] = x, n, k
        ahead.popleft()
        score.popleft()
    out, j = [], len(starts)
    while j > 0:
        if length[j]:
            out.append((KINDS[kinds[j]], starts[j - length[j]], ends[j - 1]))
        j -= length[j] or 1
    return out[::-1]


class Lattice:
    """Atoms of a short region and the features of its candidate segments (for training)."""

    def __init__(self, text: str, s: int, e: int):
        self.region = text, s, e
        self.atoms = list(_atoms(text, s, e))
        self.segments = {(i, i + n): features(text, self.atoms[i][0], end) for i in range(len(self.atoms))
                         for n, end in _ends(text, self.atoms[i:i + MAX_ATOMS])}

    def best(self, weights: dict[str, float]) -> list[tuple[str, int, int]]:
        return segment(*self.region, weights)


def pieces(text: str, s: int, e: int, gold: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """A region in pieces of at most ``PIECE_ATOMS`` atoms that cut no gold span; too long ones are left out."""
    atoms, i = list(_atoms(text, s, e)), 0
    marks = sorted((a, b) for _, a, b in gold)
    while i < len(atoms):
        cut = min(i + PIECE_ATOMS, len(atoms))
        while cut < len(atoms) and cut > i + 1 and (k := bisect_left(marks, (atoms[cut][0],))) and max(
                b for _, b in marks[max(0, k - len(KINDS)):k]) > atoms[cut][0]:
            cut -= 1
        a, b = s if i == 0 else atoms[i][0], e if cut == len(atoms) else atoms[cut - 1][1]
        if b - a <= PIECE_CHARS:
            yield a, b
        i = cut


def weigh(weights: dict[str, float], kind: str, feats: list[str]) -> float:
    get = weights.get
    return get((kind, ""), 0.0) + sum(get((kind, f), 0.0) for f in feats)


def _sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def train(examples: list[tuple[str, int, int, list[tuple[str, int, int]]]], epochs: int = EPOCHS,
          rate: float = 0.3, decay: float = 1e-4) -> dict:
    """Weights by stochastic ascent (AdaGrad) on the log likelihood of (text, start, end, gold spans)."""
    weights, seen = defaultdict(float), defaultdict(lambda: 1e-6)
    cases = []
    for text, s, e, gold in examples:
        lattice = Lattice(text, s, e)
        first, last = {a: i for i, (a, _) in enumerate(lattice.atoms)}, {b: i for i, (_, b) in enumerate(lattice.atoms)}
        marks = [(first[a], last[b] + 1, kind) for kind, a, b in gold if a in first and b in last]
        if lattice.atoms and all((i, j) in lattice.segments for i, j, _ in marks):
            cases.append((lattice, set(marks)))
    rnd = random.Random(8)
    for _ in range(epochs):
        rnd.shuffle(cases)
        for lattice, gold in cases:
            n = len(lattice.atoms)
            score = {(i, j, k): weigh(weights, k, f) for (i, j), f in lattice.segments.items() for k in KINDS}
            ahead, after = [0.0] * (n + 1), [0.0] * (n + 1)
            into, out_of = defaultdict(list), defaultdict(list)
            for (i, j, k), x in score.items():
                into[j].append((i, x))
                out_of[i].append((j, x))
            for j in range(1, n + 1):
                ahead[j] = _sum([ahead[j - 1]] + [ahead[i] + x for i, x in into[j]])
            for i in range(n - 1, -1, -1):
                after[i] = _sum([after[i + 1]] + [after[j] + x for j, x in out_of[i]])
            for (i, j, k), x in score.items():
                slope = ((i, j, k) in gold) - math.exp(ahead[i] + x + after[j] - ahead[n])
                if abs(slope) < 1e-4:
                    continue
                for f in [""] + lattice.segments[i, j]:
                    key = (k, f)
                    g = slope - decay * weights[key]
                    seen[key] += g * g
                    weights[key] += rate * g / math.sqrt(seen[key])
    return dict(weights)


def _rewritten(kind: str, span: str, rnd: random.Random) -> str:
    """The same datum in a notation that the patterns do not know."""
    d = _digits(span)
    if kind == "email":
        at, dot = rnd.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]")])
        local, _, host = span.partition("@")
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return "[.]".join(span.split("."))
    if kind == "card":
        size, mark = rnd.choice([(1, ". "), (1, " - "), (4, "."), (4, " - ")])
        return mark.join(d[i:i + size] for i in range(0, len(d), size))
    d = d[-10:]
    return rnd.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"])


def _other(rnd: random.Random) -> str:
    """Digits that are nobody's: dates, versions, sums, serial numbers, sizes."""
    r = rnd.randint
    return rnd.choice([
        f"{r(1900, 2099)}-{r(1, 12):02d}-{r(1, 28):02d}", f"{r(1, 28):02d}.{r(1, 12):02d}.{r(1900, 2099)}",
        f"{r(1, 999)} {r(100, 999)} {r(100, 999)}", f"{r(10 ** 6, 10 ** 12)}", f"{r(10 ** 15, 10 ** 16 - 1)}",
        f"{r(1, 9)}.{r(0, 20)}.{r(0, 9)}.{r(0, 9)}.{r(0, 9)}", f"{r(300, 999)}.{r(1, 999)}.{r(300, 999)}.{r(1, 99)}",
        f"{r(1900, 2099)}-{r(1900, 2099)}", f"{r(1000, 9999)} {r(1000, 9999)}",
        " ".join(str(r(0, 99)) for _ in range(r(4, 9))), "-".join(str(r(0, 9)) for _ in range(r(4, 24))),
        ".".join(str(r(0, 9)) for _ in range(r(5, 24))), f"ISBN {r(100, 999)}-{r(1, 9)}-{r(10000, 99999)}"])


def examples(texts: list[str]) -> list[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """Training regions of texts: as they stand, rewritten, and with other numbers in their place."""
    rnd, out = random.Random(9), []

    def add(text, gold):
        for region in regions(text):
            for s, e in pieces(text, *region, gold):
                out.append((text, s, e, [g for g in gold if s <= g[1] and g[2] <= e]))

    def around(text, s, e):
        """Words beside text[s:e], up to the next digit or at sign."""
        return re.split("[0-9@]", text[max(0, s - 20):s])[-1], re.split("[0-9@]", text[e:e + 20])[0]

    for text in texts:
        for s, e in regions(text):
            left, right = around(text, s, e)
            own = left + text[s:e] + right
            add(own, base_spans(own))
        spans = base_spans(text)
        for kind, s, e in rnd.sample(spans, min(8, len(spans))):
            left, right = around(text, s, e)
            new = _rewritten(kind, text[s:e], rnd)
            add(left + new + right, [(kind, len(left), len(left) + len(new))])
            own = left + _other(rnd) + right
            add(own, base_spans(own))
    return out


#: Stand-ins for the sample where a corpus holds no or few personal data: the notation is what is learned.
_SEED_TEXT = ("write to ann.lee@mail.example.org or call +1 (212) 555-0123 today; card 4111 1111 1111 1111 on host "
              "10.20.30.40 was used, also 5500005555555559, +44 20 7946 0958 and bob@example.com at 192.168.1.77 then")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict:
    """The field's weights from a bounded sample of documents that hold a digit or an at sign."""
    # Dealt by hash first, so that only about four times the sample is ever ranked.
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = (docs.filter(unit < 4 * sample_docs / max(1, docs.count())).filter(F.col("text").rlike("[0-9@]"))
              .select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample_docs)
              .select("text"))

    def near(rows):  # only the neighbourhoods of regions travel
        for (text,) in rows:
            found, gold = regions(text), base_spans(text)
            for region in random.Random(zlib.crc32(text.encode())).sample(found, min(SAMPLE_REGIONS, len(found))):
                own = [g for g in gold if region[0] <= g[1] and g[2] <= region[1]]
                for s, e in itertools.islice(pieces(text, *region, own), SAMPLE_REGIONS):
                    yield (text[max(0, s - 40):e + 40],)

    windows = sorted(r.text for r in map_rows(sample, near, "text string").collect())
    return train(examples(windows + [_SEED_TEXT] * SEED_COPIES))


def all_spans(text: str, weights: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []  # the base spans' union
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))
    starts, added = [s for s, _ in taken], []
    for s, e in regions(text):
        at = bisect_right(starts, s)
        if at and e <= taken[at - 1][1]:
            continue
        for kind, a, b in segment(text, s, e, weights):
            at = bisect_left(starts, b)
            if not at or taken[at - 1][1] <= a:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, weights: dict) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``."""
    def run(rows):
        for doc_id, text in rows:
            base, every = all_spans(text or "", weights)
            n = [sum(x[0] == k for x in base) for k in KINDS]
            yield (doc_id, *n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every))

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, "
                    "n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, weights: dict) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets and n_chars counted anew."""
    columns = docs.columns

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for kind, s, e in sorted(all_spans(text, weights)[1], key=lambda x: (x[1], -x[2])):
            if e <= end:
                continue
            if s >= end:
                out += [text[end:s], f"<{kind}>"]
            end = e
        return "".join(out) + text[end:]

    at = columns.index("text")

    def run(rows):
        for row in rows:
            yield (*row[:at], clean(row[at]), *row[at + 1:])

    new = map_rows(docs, run, docs.schema, 500)
    if "n_chars" in columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(columns)
