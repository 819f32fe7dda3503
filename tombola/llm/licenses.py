"""License scan: short notices, found with a bounded number of edits.

A notice of n characters may differ by EDITS of them. Cut into one piece more
than that, at least one piece stands in the text unchanged, so exact seeds (all
pieces of all notices in one automaton) find every candidate; the regex
library's bounded-error matching then looks at the text around each seed,
verifies the edits and gives the span.

Texts are compared as words: letters A-Z in lower case, words are runs of ASCII
letters and digits and of anything beyond ASCII, joined by single spaces.

Nulls: a null text is empty and has no words, labels or places. Repeated rows
are scanned alike, and ids don't matter. Texts are scanned whole, however long: a
window around a seed is bounded, so time is linear. Of overlapping matches of one
notice the one with the fewest edits stays, in a tie the earliest. Columns that
documents have besides may have any name; the one the result goes into is
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for every so many characters of a notice.
EDITS_PER = 10
#: Characters in a run that a window has to share with a notice often enough.
GRAM = 3
#: Verified windows that a Python worker remembers.
WINDOWS_KEPT = 50_000

#: Exact phrases (words, label).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices (words, label).
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution", "cc"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved-notice"),
)

# Bytes to words: capitals to small letters, ASCII that is no letter or digit to
# a space.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> tuple[str, int]:
    """The text's words, joined by spaces, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


@dataclass(frozen=True)
class Found:
    """A notice in a text: character span in its joined words, edits, and 1 less
    the edits' share of the notice."""

    label: str
    start: int
    end: int
    edits: int
    score: float


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, edits_per: int = EDITS_PER):
        self.notices = [(n, label, len(n) // edits_per) for n, label in notices]
        self.patterns = [regex.compile(rf"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (notice, _, k) in enumerate(self.notices):
            for piece in range(k + 1):
                start, end = len(notice) * piece // (k + 1), len(notice) * (piece + 1) // (k + 1)
                seeds.setdefault(notice[start:end], []).append((at, start))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()
        self.windows: dict[tuple[int, str], list[tuple[int, int, int]]] = {}

    def scan(self, joined: str) -> list[Found]:
        """Matches of each notice that don't overlap, those with the fewest edits
        first (then the earliest)."""
        starts: dict[int, set[int]] = {}
        for last, (length, uses) in self.automaton.iter(joined):
            for notice, offset in uses:
                starts.setdefault(notice, set()).add(last + 1 - length - offset)
        out = []
        for notice, places in starts.items():
            text, label, k = self.notices[notice]
            found: set[tuple[int, int, int]] = set()
            first = last = None
            for place in [*sorted(places), None]:
                # Seeds that put the notice at about one place share a window, which
                # is never longer than the notice and four times its edits.
                if first is not None and (place is None or place - first > 2 * k):
                    begin = max(0, first - k)
                    for start, end, edits in self._verified(notice, joined[begin : max(begin, last + len(text) + k)]):
                        found.add((edits, begin + start, begin + end))
                    first = None
                if first is None:
                    first = place
                last = place
            taken: list[tuple[int, int]] = []  # in order, not overlapping
            for edits, start, end in sorted(found):
                at = bisect.bisect(taken, (start, end))
                if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append(Found(label, start, end, edits, 1 - edits / len(text)))
        return sorted(out, key=lambda f: (f.start, f.label, f.end))

    def _verified(self, notice: int, window: str) -> list[tuple[int, int, int]]:
        """The notice's matches in a window; windows repeat, so they are kept."""
        known = self.windows.get((notice, window))
        if known is None:
            text, _, k = self.notices[notice]
            there = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
            # An edit spoils GRAM runs of characters at most.
            met = sum(text[i : i + GRAM] in there for i in range(len(text) - GRAM + 1))
            known = []
            if met >= len(text) - GRAM + 1 - GRAM * k:
                known = [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[notice].finditer(window)]
            if len(self.windows) >= WINDOWS_KEPT:
                self.windows.clear()
            self.windows[notice, window] = known
        return known


def places(joined: str, phrase: str) -> list[int]:
    """The numbers of the words at which the phrase's words stand in a row."""
    if phrase not in joined:
        return []
    padded, wanted, out, at, word, seen = f" {joined} ", f" {phrase} ", [], 0, -1, 0
    while (at := padded.find(wanted, at)) >= 0:
        word += padded.count(" ", seen, at + 1)
        seen = at + 1
        out.append(word)
        at += 1
    return out


@cache
def _scanner(notices: tuple[tuple[str, str], ...], edits_per: int) -> Scanner:
    return Scanner(notices, edits_per)


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, edits: int, score: double>>"


def scan(docs: DataFrame, *, text: str = "text", into: str = "scan", phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, edits_per: int = EDITS_PER) -> DataFrame:
    """`docs` with a struct of figures, labels and the spans of the notices
    (characters of the joined words); a column of that name is replaced."""

    @F.pandas_udf(SCAN)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _scanner(notices, edits_per)
        for batch in texts:
            rows = []
            for t in batch:
                joined, n = words_of(t)
                by = {label: at for phrase, label in phrases if (at := places(joined, phrase))}
                found = own.scan(joined)
                starts = [w for at in by.values() for w in at]
                score = max([1.0 if by else 0.0, *(f.score for f in found)])
                spans = [{"label": f.label, "start": f.start, "end": f.end, "edits": f.edits, "score": f.score} for f in found]
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(by)), ",".join(sorted({*by, *(f.label for f in found)})), score, spans))
            frame = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(into, of(F.col(text)))


def op4(docs: DataFrame) -> DataFrame:
    fields = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scan(docs.select("doc_id", "text")).select("doc_id", *[f"scan.{f}" for f in fields], F.to_json("scan.spans").alias("spans"))
