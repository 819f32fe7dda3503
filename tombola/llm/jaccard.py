"""Similarity of word shingles: exact checks, and the links an index has missed.

Documents link when the Jaccard similarity of their sets of shingles is at least
SIMILAR (a fraction of whole numbers). `checked` counts it for given pairs.
`missing` finds every linked pair that given classes don't connect yet:

Prefixes. In any order of all shingles, two sets that similar share one of their
first n - ceil(SIMILAR n) + 1 shingles. The order puts frequent ones last, so that
few sets share a prefix shingle. It is counted over all documents: every batch
of rows names the shingles that several of its texts have. What is not known to
be frequent decides how much is compared, never what links.

Lists. Of shingles that stand in the prefixes of the very same sets one is
enough, so near copies meet a few times and not once a shingle.

Filters. Sets of one shingle are compared by size and by a bitmap of the parity
of their hashes. Bitmaps differ in no more bits than sets in elements, so what
they rule out does not link. A shingle of over PART sets is dealt in pairs of
blocks; sets that are connected already are not compared with each other.

Checks. The pairs left are counted shingle by shingle, in three rounds, each of
which spares what is connected by then: in each block of every set the nearest by
bitmap, then the nearest of each other class, then all that have not been tried. So
a large class of near copies needs few of its pairs.

Shingles and whole texts are known by 64-bit hashes. Nulls: a null text, an
empty one and white space are copies of each other, without shingles, and link
with nothing else. A text of fewer words is one shingle. Repeated texts are one
set. A very long text's shingles (8 bytes each) are held by one task. An empty
table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, shuffle_partitions, together
from .components import components

SHINGLE = 5
#: At least so much of a union is shared: 4 of 5.
SIMILAR = (4, 5)
SEED = 42
#: A shingle is named as frequent by a batch in which so many texts have it; so
#: many of the most frequent ones are handed out. (16 bytes each.)
NAMED, FREQUENT = 3, 100_000
#: The most sets of one shingle in a block.
PART = 512
#: Keys by which a task knows copies again.
KEYS_KEPT = 1_000_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """Words are runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Of all shingles in order, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    parts = [words[k : k + n] for k in range(min(shingle, len(words)))]
    return np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*parts, strict=False))), np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    return np.unique(shingle_hashes(words_of(text), shingle))


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first."""
    n, (over, under) = len(hashes), SIMILAR
    if not n:
        return hashes
    at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
    seen = np.where(frequent[at] == hashes, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return hashes[np.argsort(seen, kind="stable")[: n - -(-over * n // under) + 1]]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of hashes by their last bits; the larger a set, the more bits."""
    width = 1 << min(16, max(6, (4 * max(1, len(hashes)) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def named(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that NAMED or more of a batch's sets have, and how many."""
    hashes, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    often = counts >= NAMED
    return hashes[often], counts[often]


def close(sizes: np.ndarray, maps: list[bytes], roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i, j of sets with two roots that sizes and bitmaps let be similar,
    and how far apart their bitmaps are, as a share of what may be. Sets come in
    order of size."""
    over, under = SIMILAR
    values, counts = np.unique(roots, return_counts=True)
    minor = roots != values[counts.argmax()]  # of a pair with two roots one is
    widths = np.array([len(m) for m in maps])
    kinds = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths)}
    bits = {w: np.frombuffer(b"".join(maps[k] for k in at), np.uint64).reshape(len(at), -1) for w, at in kinds.items()}
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for w, at in kinds.items():
        sides = [(at, bits[w])]
        if 2 * w in kinds:  # the wider bitmap, its halves laid over each other
            wide = bits[2 * w]
            sides.append((kinds[2 * w], wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]))
        ranges = [(np.arange(len(others)), np.flatnonzero(minor[others])) for others, _ in sides]
        for k, i in enumerate(at):
            for side, (others, other_bits) in enumerate(sides):
                first = 0 if side else k + 1
                last = int(np.searchsorted(sizes[others], sizes[i] * under // over, "right"))
                there = ranges[side][0][first:last]
                if not minor[i]:
                    there = ranges[side][1]
                    there = there[(there >= first) & (there < last)]
                there = there[roots[others[there]] != roots[i]]
                if not len(there):
                    continue
                apart = np.bitwise_count(bits[w][k] ^ other_bits[there]).sum(axis=1, dtype=np.int64)
                # |A - B| + |B - A| is at most this share of |A| + |B|.
                far = (under + over) * apart / ((under - over) * (sizes[i] + sizes[others[there]]))
                good = far <= 1
                out.append((np.full(int(good.sum()), i), others[there[good]], far[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(i: np.ndarray, j: np.ndarray, far: np.ndarray, roots: np.ndarray, each_root: bool) -> np.ndarray:
    """Of pairs those that are some set's nearest, or, with each_root, its nearest
    of some other root."""
    ends, others = np.r_[i, j], np.r_[j, i]
    order = np.lexsort((np.r_[far, far], roots[others], ends)) if each_root else np.lexsort((np.r_[far, far], ends))
    ends, others = ends[order], roots[others[order]]
    first = np.r_[True, (ends[1:] != ends[:-1]) | (each_root & (others[1:] != others[:-1]))]
    return np.unique(order[first] % len(i))


def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit("")))


def frequent(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles that batches have named, in order, with
    counts: FREQUENT at most reach the driver."""
    by = marked.where("named is not null").select(F.explode(F.arrays_zip("named", "times")).alias("of"))
    counts = by.groupBy(F.col("of.named").alias("h")).agg(F.sum("of.times").alias("count"))
    rows = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["count"].to_numpy(np.int64)[order]


def _pairs(found: set) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


#: What a round tries in a block: of each set the nearest, of each set the nearest
#: of each other root, and all that are left.
ROUNDS = ("nearest", "each root", "all")


def _candidates(placed: DataFrame, turn: str) -> DataFrame:
    """a, b: pairs of keys in a block that may be similar and have two roots."""

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len({r[3] for r in rows}) < 2:
            return
        rows = sorted(rows)
        sizes, keys, roots = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        i, j, far = close(sizes, [r[2] for r in rows], roots)
        if len(i) and turn != "all":
            picked = nearest(i, j, far, roots, turn == "each root")
            i, j = i[picked], j[picked]
        yield from zip(np.minimum(keys[i], keys[j]).tolist(), np.maximum(keys[i], keys[j]).tolist(), strict=True)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, found = None, set()
        for batch in batches:
            for *block, size, key, bits, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    found.update(pairs(held))
                    held, at = [], block
                held.append((size, key, bits, root))
            if len(found) > 1 << 15:
                yield _pairs(found)
                found = set()
        found.update(pairs(held))
        yield _pairs(found)

    placed = together(placed, ["list", "x", "y"])
    return placed.select("list", "x", "y", "size", "key", "bits", "root").mapInArrow(within, "a long, b long").distinct()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """list, sets, key: the sets (in order of h, then key) that a shingle h
    shares, if there are two or more. A list's number is a hash of its keys, so
    shingles of the same sets have the same list."""

    def shared(h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[first, len(h)])
        many = sizes > 1
        mixed = key.view(np.uint64).copy()
        number = np.zeros(len(first), np.uint64)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(32)
            number = number * np.uint64(0x165667B19E3779F9) + np.add.reduceat(mixed, first)
        alike = np.stack([number, key[first].view(np.uint64), sizes.astype(np.uint64)])
        _, once = np.unique(alike, axis=1, return_index=True)
        keep = np.zeros(len(first), bool)
        keep[once] = many[once]
        rows = np.repeat(keep, sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(number, sizes)[rows].view(np.int64)), pa.array(np.repeat(sizes, sizes)[rows]), pa.array(key[rows])], ["list", "sets", "key"])

    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        h, key = (np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True))
        once = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])][: len(h)]
        h, key = h[once], key[once]
        end = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last may go on
        if end:
            yield shared(h[:end], key[:end])
        rest = [h[end:], key[end:]]
    if len(rest[0]):
        yield shared(*rest)


def checked(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of `pairs` (a, b, written already) that are similar. texts: key and text."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles(t, shingle).tobytes() for t in batch], dtype=object)

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        over, under = SIMILAR
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                out.append(both > 0 and under * both >= over * (len(a) + len(b) - both))
            yield pd.Series(out, dtype=bool)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    known = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sets = cut(known.select("key", of("text").alias("hashes")))
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("left")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("right")), "b")
    return cut(both.where(similar("left", "right")).select("a", "b"))


def missing(marked: DataFrame, texts: DataFrame, known: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """a, b: pairs that connect what `known` (a, b) does and, besides, all sets
    that are similar. marked: key, size, bits, named and times, a row a text or
    more."""
    spark = marked.sparkSession
    order = spark.sparkContext.broadcast(frequent(marked))

    @F.pandas_udf("array<long>")
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        met: set[int] = set()
        for texts, keys in batches:
            out = []
            for t, key in zip(texts, keys, strict=True):
                if key in met:  # copies in a task count once
                    out.append(None)
                    continue
                if len(met) < KEYS_KEPT:
                    met.add(key)
                out.append(prefix(shingles(t, shingle), *order.value).view(np.int64))
            yield pd.Series(out, dtype=object)

    firsts = texts.select(F.explode(first("text", "key")).alias("h"), "key")
    firsts = together(firsts, ["h"], ["key"])
    shared = cut(firsts.mapInArrow(_lists, "list long, sets long, key long").distinct())
    sets = marked.join(shared.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    sets = cut(sets)
    blocks = F.ceil(F.col("sets") / PART).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = shared.select("list", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("list", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    tried, roots = None, cut(components(known))
    for turn in ROUNDS:
        # Classes stand for the links that make them.
        known = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        rooted = cut(dealt.join(roots, F.col("key") == F.col("node"), "left").select("list", "key", "x", "y", F.coalesce("root", "key").alias("root")))
        open_blocks = rooted.groupBy("list", "x", "y").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("list", "x", "y")
        placed = rooted.join(open_blocks, ["list", "x", "y"], "left_semi").join(sets, "key")
        pairs = cut(_candidates(placed, turn))
        if pairs.isEmpty():  # and so would be all later rounds
            break
        if tried is not None:
            pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"))
        found = checked(pairs, texts, shingle)
        # All of these are written; as many partitions as for any other step do.
        tried = pairs if tried is None else tried.unionByName(pairs).coalesce(shuffle_partitions(spark))
        if not found.isEmpty():
            known = known.unionByName(found).coalesce(shuffle_partitions(spark))
            roots = cut(components(known))
    return known
