"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

A sequence of tokens is what BPE makes of its bytes exactly if every two
neighbours are: ``merge(a + b) == [a, b]``.  So each prefix of a piece has one
encoding, and it ends in the one token that fits the encoding of what lies
before it; and any chain of fitting neighbours is the encoding.

The transducer comes in two forms, whose deterministic states and moves are
made when first needed and kept in tables.  For short pieces the state is the
last token, the input the longest match in the vocabulary's trie (a lookahead
bounded by the longest token), and the output the longest token there that may
follow; a token after which nothing fits is taken back.  Longer pieces are
read byte by byte and nothing is taken back: a nondeterministic state is a
pair (tokens not yet emitted, place in the trie), the set of these pairs is
one deterministic state, and tokens that all pairs agree on are emitted.  At
the piece's end the pair at the trie's root holds the rest.

A text is cut into pieces by the tokenizer's pattern.  Words come again and
again, so the tokens of a stretch between two single spaces are kept in a
table of bounded size (it starts anew when full; results do not depend on it).

Decoding joins the tokens' bytes in a stream and feeds them to an incremental
UTF-8 decoder, a state machine that keeps an unfinished character between two
chunks.

Defined cases: a null text counts as empty and has no tokens; repeated rows
are encoded each; further columns are ignored; texts are never cut off.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from base64 import b64decode
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from fleetlens.llm.common import map_rows

#: Entries of a worker's tables of stretches and of transducer states.
TABLE_SIZE, STATES = 600_000, 400_000
#: Bytes of the longest piece that the first form encodes.
SHORT = 64

#: Places where no piece of the pattern can cross: a single space between two other characters.
_BREAK = re.compile(r"(?<=\S) (?=\S)")

#: ASCII characters that are neither letters, digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


NEVER = 1 << 60


def merge(data: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """Plain BPE of a few bytes by ranks under ``below``: join the pair of lowest rank, leftmost first."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank = [ranks.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
        if (low := min(rank)) >= below:
            break
        best = rank.index(low)
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """Deterministic states over bytes, made as they are reached."""

    ROOT = 0

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.spines = ranks, ({}, {})
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.parent: list[int] = [0]
        self.follows: dict[tuple[int, int], int] = {}
        self.word = {i: t for t, i in ranks.items()}
        for t, i in ranks.items():
            node = 0
            for byte in t:
                nxt = self.child[node].get(byte)
                if nxt is None:
                    nxt = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.parent.append(node)
                node = nxt
            self.token[node] = i
        self.clear()

    def clear(self) -> None:
        start = (None, (((), 0),))
        self.states: list[tuple] = [start]
        self.index: dict[tuple, int] = {start: self.ROOT}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _spine(self, t: int, side: int) -> list[tuple[bytes, int]]:
        """The parts of token t that touch its right (side 1) or left (side 0) end, smallest first, each
        with the rank at which it is joined away."""
        known = self.spines[side].get(t)
        if known is None:
            data = self.word[t]
            parts = merge(data, self.ranks, t)
            if merge(data, self.ranks) != [data]:
                known = []  # BPE never makes this token
            elif len(parts) < 2:
                known = [(data, NEVER)]
            else:
                inner = self._spine(self.ranks[parts[-side]], side)
                known = inner[:-1] + [(parts[-side], t), (data, NEVER)]
            self.spines[side][t] = known
        return known

    def fits(self, a: int | None, b: int) -> bool:
        """Whether token b may follow token a (None: at the start) within a piece.

        Both are joined up from bytes by rising rank.  They stay apart if no
        pair of parts that meet at their border has a lower rank than the
        joins that take these parts away (equal ranks: the left one goes first).
        """
        right = self._spine(b, 0)
        if a is None or not right:
            return bool(right)
        left = self._spine(a, 1)
        i, j, get = 0, 0, self.ranks.get
        while left:
            (x, x_at), (y, y_at) = left[i], right[j]
            cross = get(x + y, NEVER)
            if cross < x_at and cross <= y_at and cross < NEVER:
                return False
            if x_at == y_at == NEVER:
                return True
            if x_at <= y_at:
                i += 1
            else:
                j += 1
        return False

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are certain by then.

        A state is the last token emitted (None: none yet) and its pairs.
        """
        last, before = self.states[state]
        pairs, whole, child, token = [], None, self.child, self.token
        for tokens, node in before:
            node = child[node].get(byte)
            if node is None:
                continue
            if child[node]:
                pairs.append((tokens, node))
            t = token[node]
            if t >= 0 and whole is None and self.fits(tokens[-1] if tokens else last, t):
                whole = (tokens + (t,), 0)
        if whole:
            pairs.append(whole)  # pairs stay in the order of their open token's start
        first, same = pairs[0][0], 0
        if len(pairs) == 1:
            same = len(first)
        elif first:
            shortest = min(len(tokens) for tokens, _ in pairs)
            while same < shortest and all(tokens[same] == first[same] for tokens, _ in pairs):
                same += 1
        emitted = first[:same]
        if same:
            new = emitted[-1], tuple((tokens[same:], node) for tokens, node in pairs)
        else:
            new = last, tuple(pairs)
        at = self.index.get(new)
        if at is None:
            at = self.index[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = at, emitted
        return at, emitted

    def _next(self, last: int, node: int) -> tuple[int, ...]:
        """The tokens on the way to ``node`` that may follow ``last`` (-1: at the start), longest first."""
        at, found = node, []
        while at:
            t = self.token[at]
            if t >= 0 and self.fits(None if last < 0 else last, t):
                found.append(t)
            at = self.parent[at]
        if len(self.follows) >= STATES:
            self.follows.clear()
        out = self.follows[last, node] = tuple(found)
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece.

        A prefix has one encoding, so a place from which no token may follow
        is closed for good, and the last token is taken back.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n > SHORT:
            return self.encode_by_sets(piece)
        child, follows, word = self.child, self.follows, self.word
        out, last, at, closed = [], -1, 0, ()
        while at < n:
            node, i = 0, at
            while i < n:
                step = child[node].get(piece[i])
                if step is None:
                    break
                node, i = step, i + 1
            options = follows.get((last, node))
            if options is None:
                options = self._next(last, node)
            for t in options:
                end = at + len(word[t])
                if end not in closed:
                    out.append(t)
                    last, at = t, end
                    break
            else:
                closed = {*closed, at}
                at -= len(word[out.pop()])
                last = out[-1] if out else -1
        return out

    def encode_by_sets(self, piece: bytes) -> list[int]:
        """Tokens of one piece by the machine over sets of pairs."""
        if len(self.states) > STATES:
            self.clear()
        state, out, moves = self.ROOT, [], self.moves
        for byte in piece:
            step = moves[state].get(byte)
            state, emitted = step if step is not None else self._move(state, byte)
            out += emitted
        tokens, node = self.states[state][1][-1]  # the pair at the root, if any, is the last
        return out + list(tokens)


class Codec:
    """Encoder and decoder of one vocabulary file (ranks) and its pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.bytes_of[i] = t
        self.fst = Transducer(self.ranks)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> bytes:
        return np.array([i for p in pieces for i in self.fst.encode(p.encode())], dtype="<u4").tobytes()

    def _keep(self, s: str, ids: bytes) -> bytes:
        if len(s) <= 64:
            if len(self.known) >= TABLE_SIZE:
                self.known.clear()
            self.known[s] = ids
        return ids

    def _stretch(self, s: str) -> bytes:
        """Ids of a stretch of pieces, as little-endian 32-bit integers.

        Letters with marks after them are two pieces, which are looked up on their own.
        """
        word = s.rstrip(_MARKS)
        if not word[1:].isalpha() or word[0] != " " and not word[0].isalpha():
            return self._keep(s, self._ids(self.pieces(s)))
        ids = self.known.get(word)
        if ids is None:
            ids = self._keep(word, self._ids([word]))
        if len(word) == len(s):
            return ids
        marks = s[len(word):]
        more = self.known.get(marks)
        return ids + (self._keep(marks, self._ids([marks])) if more is None else more)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, *rest = _BREAK.split(text)
        get, make, out = self.known.get, self._stretch, [self._stretch(head) if head else b""]
        for s in rest:
            s = " " + s
            ids = get(s)
            out.append(make(s) if ids is None else ids)
        return b"".join(out)

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
        """(bytes, characters completed by them) for each chunk of ids; invalid UTF-8 becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids, table = list(ids), self.bytes_of
        for i in range(0, len(ids), chunk):
            data = b"".join([table[x] for x in ids[i:i + chunk]])
            yield data, machine.decode(data)
        if tail := machine.decode(b"", True):
            yield b"", tail

    def decoded_digest(self, ids: list[int]) -> str:
        """SHA-256 of the bytes that the ids decode to."""
        out = hashlib.sha256()
        for data, _ in self.decode_stream(ids):
            out.update(data)
        return out.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """(file, pattern) of the public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the tokens of every text, and the digest of what they decode to."""
    path, pattern = vocabulary or default_vocabulary()

    def run(rows):
        enc = codec(path, pattern)
        for doc_id, text in rows:
            ids = np.frombuffer(enc.encode(text or ""), dtype="<u4").astype(np.int32).tolist()
            yield doc_id, len(ids), ids, enc.decoded_digest(ids)

    return map_rows(docs.select("doc_id", "text"), run,
                    "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", 200)


def decode_documents(tokens: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path, pattern = vocabulary or default_vocabulary()

    def run(rows):
        enc = codec(path, pattern)
        for doc_id, ids in rows:
            yield doc_id, "".join(t for _, t in enc.decode_stream(ids or []))

    return map_rows(tokens.select("doc_id", "ids"), run, "doc_id long, text string", 200)


def round_trip(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode, with digests only."""
    path, pattern = vocabulary or default_vocabulary()

    def run(rows):
        enc = codec(path, pattern)
        for doc_id, text in rows:
            ids = enc.encode(text or "")
            decoded = enc.decoded_digest(np.frombuffer(ids, dtype="<u4").tolist())
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded

    return map_rows(docs.select("doc_id", "text"), run,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
