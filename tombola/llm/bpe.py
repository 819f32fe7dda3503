"""Byte-level BPE by dynamic programming over prefixes.

In a BPE with ranked merges the encoding of a byte string's prefix ends in one
definite token, and dropping that token leaves the encoding of a shorter prefix.
So it is enough to store for each prefix its last token. It is found among the
tokens that end there: the one that is compatible with the last token of the
prefix before it, that is, between which BPE would leave a border.

Appending bytes only adds entries; after an edit, entries before it stand, and
those after it are recomputed until they have come back into step.

Nulls: a null text is empty; an empty text has no tokens. Texts are encoded
whole, however long, each match of the pattern by itself, without special tokens;
a match's table of prefixes takes four bytes a byte. There are no ties: a prefix
has one last token. Repeated rows are encoded alike, and ids don't matter. Columns
that documents have besides may have any name; the one the result goes into is
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode has it (and not as Python's `re` has it).
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"
#: Words with the space before them, or runs of white space. No match of the
#: pattern goes over such a border.
CHUNK = re.compile(f" ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+")
#: Encoded chunks kept by a Python worker, and the longest chunk kept.
KEPT, KEPT_LENGTH = 500_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS_KEPT = 500_000


class Vocabulary:
    """Ranks, and the facts about tokens that compatibility rests on."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.length = {i: len(b) for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for raw, token in ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._reachable: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[bytes, float]]] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(b): int(i) for b, i in map(bytes.split, f)})

    def merged(self, raw: bytes, until: int = 1) -> list[bytes]:
        """Merges adjacent parts, the lowest rank and the leftmost first, until
        that many parts are left or none can be merged."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > until:
            joins = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not joins:
                break
            _, i = min(joins)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._parts:
            raw = self.bytes_of[token]
            two = self.merged(raw, 2) if len(raw) > 1 else []
            self._parts[token] = (self.rank[two[0]], self.rank[two[1]]) if len(two) == 2 else None
        return self._parts[token]

    def reachable(self, token: int) -> bool:
        """Whether BPE makes this token from its own bytes."""
        if token not in self._reachable:
            raw = self.bytes_of[token]
            self._reachable[token] = self.merged(raw) == [raw]
        return self._reachable[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that stand at the token's right (1) or left (0) border
        while it is made, each with the rank of the merge that ends it."""
        if (token, side) not in self._spines:
            out, ends, at = [], float("inf"), token
            while True:
                out.append((self.bytes_of[at], ends))
                parts = self.parts(at)
                if parts is None:
                    break
                ends, at = at, parts[side]
            self._spines[token, side] = out
        return self._spines[token, side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the border between a and b lasts: no part at a's right border
        and part at b's left border, present together, form a token whose turn
        comes before either is merged away. In a tie the leftmost merge comes
        first, which is the one inside a, or else the one over the border."""
        for left, left_ends in self.spine(a, 1):
            for right, right_ends in self.spine(b, 0):
                rank = self.rank.get(left + right)
                if rank is not None and rank < left_ends and rank <= right_ends:
                    return False
        return True

    def follows(self, a: int, b: int) -> bool:
        """Whether b can be the next token after a, or the first (a = -1)."""
        good = self.reachable(b) and (a < 0 or self.compatible(a, b))
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[a << 32 | b] = good
        return good


class Prefixes:
    """One piece of text: last[i] is the last token of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """Exact: no stored entry depends on what follows it."""
        self.raw += raw
        self._fill(len(self.raw))

    def _fill(self, until: int) -> None:
        """The automaton names the tokens that end at each place, the longest
        first; the place's entry is the one that can follow the entry before it."""
        last, v = self.last, self.vocabulary
        known, done = v.pairs.get, len(last) - 1
        behind = max(0, done + 1 - v.longest)
        for at, token in v.automaton.iter(self.raw[behind:until].decode("latin-1")):
            end = behind + at + 1
            if end == done + 1:
                before = last[end - v.length[token]]
                good = known(before << 32 | token)
                if v.follows(before, token) if good is None else good:
                    last.append(token)
                    done = end
        if done != until:
            raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, end: int, raw: bytes) -> int:
        """Puts raw in place of bytes start to end; returns how many entries
        were recomputed. An entry depends on the last `longest` bytes and on the
        entries there, so once that many in a row come out as before, the rest
        stands."""
        old, shift = self.last, len(raw) - (end - start)
        self.raw = self.raw[:start] + raw + self.raw[end:]
        self.last = old[: start + 1]
        same = 0
        for at in range(start + 1, len(self.raw) + 1):
            self._fill(at)
            same = same + 1 if at - shift > end and old[at - shift] == self.last[at] else 0
            if same >= self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                return at - start
        return len(self.raw) - start

    def tokens(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes_of[self.last[at]])
        return out[::-1]


class Tokenizer:
    """Encodes whole texts; remembers the chunks it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self._kept: dict[str, bytes] = {}

    def chunk(self, chunk: str) -> bytes:
        """A chunk's ids as little-endian unsigned 32-bit integers."""
        ids = self._kept.get(chunk)
        if ids is None:
            word = chunk.removeprefix(" ")
            pieces = [chunk] if word.isascii() and word.isalpha() else self.pattern.findall(chunk)
            ids = self.piece(chunk) if len(pieces) == 1 else b"".join(map(self.piece, pieces))
            self._keep(chunk, ids)
        return ids

    def piece(self, piece: str) -> bytes:
        """The same for a match of the pattern."""
        ids = self._kept.get(piece)
        if ids is None:
            ids = array("I", Prefixes(self.vocabulary, piece.encode("utf-8", "surrogatepass")).tokens()).tobytes()
            self._keep(piece, ids)
        return ids

    def _keep(self, text: str, ids: bytes) -> None:
        if len(text) <= KEPT_LENGTH:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[text] = ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunk, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I")))


@cache
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One a worker process; the file is a public one that every machine has."""
    return Tokenizer(Vocabulary.from_file(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", into: str = "tokens") -> DataFrame:
    """Adds the ids as binary: little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(path, pattern)
        for batch in texts:
            yield pd.Series([own.encode(t or "") for t in batch], dtype=object)

    return docs.withColumn(into, ids(F.col(text)))


def decode(encoded: DataFrame, path: str, pattern: str, *, tokens: str = "tokens", into: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""

    @F.pandas_udf("binary")
    def raw(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer(path, pattern)
        for batch in ids:
            yield pd.Series([own.decode(i or b"") for i in batch], dtype=object)

    return encoded.withColumn(into, raw(F.col(tokens)))


def _digested(own: Tokenizer, text: str | None) -> tuple[int, bytes, str, str]:
    ids = own.encode(text or "")
    return len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def encoded_with_digests(docs: DataFrame, path: str, pattern: str, *, text: str = "text", tokens: bool = True) -> DataFrame:
    """Adds a struct `digest` of n_tokens, the ids (with tokens=True) and the
    SHA-256 of the ids and of what they decode to, in one pass over the texts."""
    names = ["n_tokens", "tokens", "ids_sha256", "decoded_sha256"]
    kinds = dict(zip(names, ("long", "binary", "string", "string"), strict=True))
    wanted = [n for n in names if tokens or n != "tokens"]

    @F.pandas_udf(", ".join(f"{n} {kinds[n]}" for n in wanted))
    def digest(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, pattern)
        for batch in texts:
            yield pd.DataFrame([_digested(own, t) for t in batch], columns=names)[wanted]

    return docs.withColumn("digest", digest(F.col(text)))


def op10(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    out = encoded_with_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokens=False)
    return out.select("doc_id", "digest.*")
