"""Near-duplicates by SimHash and a Gray-order hierarchical index.

A document's fingerprint has the bits that more than half of its shingles'
hashes have. Fingerprints link when at most RADIUS bits differ; linked documents
form classes.

The index. Its upper nodes hold what fingerprints agree on under a mask. The
topmost masks are blocks of bits: two fingerprints within RADIUS of each other
agree on one of RADIUS + 1 blocks, so comparing inside the nodes of all blocks
loses no link. A node of more than NODE_ROWS distinct fingerprints is split by
blocks of the bits it leaves open, as often as it takes; as distinct
fingerprints are at most two to the power of the open bits, that ends, and no
task ever holds a larger node. Inside a node the fingerprints are sorted by Gray
rank, so that neighbours share bits; runs of FAN get a node with the bits they
all share, and runs of those another. Pairs of nodes are compared from the top,
adding up the differing bits that each level fixes anew; a pair of whole groups
is dropped as soon as the sum exceeds RADIUS.

Exact copies are one fingerprint, however many, so a group of copies of any size
is one entry of the index.

Nulls: a null text has no shingles and so fingerprint zero, as has an empty one;
zero links like any other. Rows with a null id are grouped but never name
a class, unless nothing else does. Repeated rows share a fingerprint; a class goes
by its least id, so there are no ties. A very long text is hashed whole, its
shingles' hashes (8 bytes each) held by one task. Columns that documents have
besides may have any name. An empty table gives an empty result.

`one_of_each` takes classes of similar texts instead: see similar_links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, together
from .components import components, least_of
from .jaccard import SHINGLE, bitmap, checked, key_of, missing, named, shingle_hashes, words_of

RADIUS = 3
#: The largest node that is compared as a whole.
NODE_ROWS = 2048
FAN = 8

def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes, as a signed long."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # so that a very long text needs little memory
        part = hashes[at : at + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int) -> int:
    """Of a whole text."""
    return folded(shingle_hashes(words_of(text), shingle))


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return of(text)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [[int(b) for b in part] for part in np.array_split(np.array(bits, dtype=int), n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def gray_rank(fp: Column) -> Column:
    """The place of fp among all Gray codes, ordered as a signed long."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def top_nodes(distinct: DataFrame, radius: int = RADIUS, rows: int = NODE_ROWS) -> DataFrame:
    """path, shared, fp: each fingerprint in the nodes that hold it, all of at
    most `rows` fingerprints. `path` numbers a mask, `shared` is what is under it."""
    n = radius + 1
    masks = [[_mask(b) for b in _blocks(list(range(63, -1, -1)), n)]]  # of each path: its children's masks
    open_bits = [[b for b in range(63, -1, -1)]]
    at = distinct.select(F.lit(0).alias("path"), F.col("fp"))
    done, base = None, 0
    while True:
        children = F.array(*[F.array(*[F.lit(_signed(m)) for m in ms]) for ms in masks])
        turn = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("turn")
        at = at.select("path", "fp", turn).select((F.col("path") * n + F.col("turn")).alias("path"), F.col("fp").bitwiseAND(F.element_at(F.element_at(children, F.col("path") + 1), F.col("turn") + 1)).alias("shared"), "fp")
        inner, held = [], []
        for bits in open_bits:
            for block in _blocks(bits, n):
                left = [b for b in bits if b not in block]
                inner.append(left)
                held.append(_mask([b for b in range(64) if b not in left]))
        if 2 ** max(map(len, inner)) <= rows:
            large = None
        else:
            large = cut(at.groupBy("path", "shared").count().where(F.col("count") > rows).select("path", "shared"))
            if large.isEmpty():
                large = None
        fits = at if large is None else at.join(large, ["path", "shared"], "left_anti")
        fits = fits.select((F.col("path") + base).alias("path"), "shared", "fp")
        done = fits if done is None else done.unionByName(fits)
        if large is None:
            return done
        at = cut(at.join(large, ["path", "shared"], "left_semi").select("path", "fp"))
        base += len(inner)
        open_bits = inner
        masks = [[_mask(b) | h for b in _blocks(bits, n)] for bits, h in zip(inner, held, strict=True)]


def _runs(bucket: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parents of runs of FAN entries of one bucket: first child, bucket, and
    the AND and OR of what is below."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    place = np.arange(len(bucket)) - np.repeat(first, np.diff(np.r_[first, len(bucket)]))
    start = np.flatnonzero(place % FAN == 0)
    return start, bucket[start], np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)


def close_pairs(bucket: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one bucket whose fingerprints differ in at most
    `radius` bits, in pieces. Entries stand by bucket, then by Gray rank."""
    if not len(fp):
        return
    levels = [(np.arange(len(fp)), bucket, fp, fp)]
    for _ in range(2):
        levels.append(_runs(*levels[-1][1:]))
    starts = [lv[0] for lv in levels]
    ends = [np.r_[s[1:], len(below[1])] for s, below in zip(starts[1:], levels, strict=False)]

    def pruned(level: int, i: np.ndarray, j: np.ndarray, seen: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, ...]:
        _, _, low, high = levels[level]
        fixed = ~(low[i] ^ high[i]) & ~(low[j] ^ high[j])
        spent = spent + np.bitwise_count((low[i] ^ low[j]) & fixed & ~seen)
        keep = spent <= radius
        return i[keep], j[keep], (fixed | seen)[keep], spent[keep]

    def descend(level: int, i: np.ndarray, j: np.ndarray, seen: np.ndarray, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            if len(i):
                yield i, j
            return
        for at in range(0, len(i), 1 << 14):
            part = slice(at, at + (1 << 14))
            grid_a, grid_b = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
            a = starts[level][i[part], None] + grid_a
            b = starts[level][j[part], None] + grid_b
            good = (a < ends[level - 1][i[part], None]) & (b < ends[level - 1][j[part], None]) & ((a < b) if level == 1 else (a <= b))
            more = np.broadcast_to(seen[part, None], a.shape)[good], np.broadcast_to(spent[part, None], a.shape)[good]
            yield from descend(level - 1, *pruned(level - 1, a[good], b[good], *more))

    top, n = levels[2][1], len(levels[2][1])
    for step in range(n):
        i = np.flatnonzero(top[: n - step] == top[step:])
        if not len(i):
            break
        none = np.zeros(len(i), np.uint64)
        yield from descend(2, *pruned(2, i, i + step, none, np.zeros(len(i), np.int64)))


def links(distinct: DataFrame, radius: int = RADIUS, rows: int = NODE_ROWS) -> DataFrame:
    """a, b: pairs of fingerprints that connect all that link: in each node,
    every fingerprint with the first of those it is connected with there."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, due = 0, 1 << 15

        def linked(path: np.ndarray, shared: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (shared[1:] != shared[:-1])])
            root = least_of(len(fp), close_pairs(bucket, fp.view(np.uint64), radius))
            far = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[root[far]]), pa.array(fp[far])], ["a", "b"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= due:
                path, shared, fp = (np.concatenate(c) for c in zip(*held, strict=True))
                # The last node may go on in the next batch.
                end = int(np.flatnonzero((path != path[-1]) | (shared != shared[-1]))[-1:].sum()) + 1
                if path[end - 1] == path[-1] and shared[end - 1] == shared[-1]:
                    end = 0
                if end:
                    yield linked(path[:end], shared[:end], fp[:end])
                held, size = [[path[end:], shared[end:], fp[end:]]], len(path) - end
        if size:
            yield linked(*(np.concatenate(c) for c in zip(*held, strict=True)))

    nodes = top_nodes(distinct, radius, rows).withColumn("gray", gray_rank(F.col("fp")))
    return together(nodes, ["path", "shared"], ["gray"]).select("path", "shared", "fp").mapInArrow(within, "a long, b long")


def classes(marked: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fp, class_fp, component_id: for each fingerprint of `marked` (id, fp) the
    least fingerprint linked with it and the least id of its class."""
    distinct = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(links(distinct.select("fp"), radius))
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("class_fp"))
    of = cut(of)
    # Written first: joined as it comes from its aggregation, a large class could
    # not be split.
    heads = cut(of.groupBy(F.col("class_fp").alias("head")).agg(F.min("least_id").alias("component_id")))
    return of.join(heads, F.col("class_fp") == F.col("head")).select("fp", "class_fp", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row a document: id, fp (signed long), component_id."""
    marked = cut(docs.select(F.col(id_col), fingerprints(F.col(text), shingle).alias("fp")))
    of = cut(classes(marked, id_col, radius)).select(F.col("fp").alias("of_fp"), "component_id")
    return marked.join(of, F.col("fp") == F.col("of_fp")).select(id_col, "fp", "component_id")


def marks(text: Column, shingle: int) -> Column:
    """A struct of a text's fingerprint, the size and the bitmap of its set of
    shingles, and, in a batch's first row, the shingles that the batch names."""

    @F.pandas_udf("fp long, size long, bits binary, named array<long>, times array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps, sets, texts = [], [], set()
            unlike = []  # one set of each text
            for t in batch:
                hashes = shingle_hashes(words_of(t), shingle)
                fps.append(folded(hashes))
                sets.append(np.unique(hashes))
                if t not in texts:
                    texts.add(t)
                    unlike.append(sets[-1])
            out = pd.DataFrame({"fp": pd.array(fps, dtype="int64"), "size": pd.array([len(s) for s in sets], dtype="int64"), "bits": [bitmap(s) for s in sets]})
            for name, values in zip(("named", "times"), named(unlike), strict=True):
                out[name] = pd.Series([values.view(np.int64), *[None] * (len(batch) - 1)][: len(batch)], dtype=object)
            yield out

    return of(text)


def similar_links(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Each row's id and key (a hash of its text), and a, b: pairs of keys that
    connect all texts whose sets of shingles are similar (see jaccard.py).

    The Gray-order index links fingerprints first, and every link it gives is
    counted shingle by shingle. Fingerprints within `radius` are far closer than
    sets of a similarity of 0.8 need be, so what the index can't see is
    completed by an exact search for similar sets that aren't connected."""
    texts = docs.select(key_of(F.col(text)).alias("key"), F.col(text).alias("text"))
    marked = cut(docs.select(F.col(id_col).alias("id"), key_of(F.col(text)).alias("key"), marks(F.col(text), shingle).alias("of")).select("id", "key", "of.*"))
    filled = marked.where("size > 0")
    least = cut(filled.groupBy("fp").agg(F.min("key").alias("least")))
    star = links(least.select("fp"), radius)
    ends = [least.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in "ab"]
    far = star.toDF("from_fp", "to_fp").join(ends[0], F.col("from_fp") == F.col("fp_a")).join(ends[1], F.col("to_fp") == F.col("fp_b")).select("a", "b")
    same = filled.join(least.withColumnRenamed("fp", "of_fp"), F.col("fp") == F.col("of_fp")).where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    near = checked(cut(far.unionByName(same)), texts, shingle)
    return marked.select("id", "key"), missing(marked, texts, near, shingle)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """`docs` with one document of each class of similar texts: that of the least
    id, or of the least key where no id is known. Of rows that repeat both id and
    text one stays; all texts without a word are copies of each other."""
    marked, found = similar_links(docs, id_col=id_col, text=text, shingle=shingle, radius=radius)
    roots = cut(components(found))
    heads = marked.groupBy("key").agg(F.min("id").alias("id")).join(roots, F.col("key") == F.col("node"), "left")
    heads = cut(heads.select("key", "id", F.coalesce("root", "key").alias("class")))
    stay = cut(heads.groupBy("class").agg(F.min_by(F.struct("id", "key"), F.struct(F.col("id").isNull(), "id", "key")).alias("stay")).select("stay.*"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), key_of(F.col(text)).alias("_key"))
    rows = rows.join(stay, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left_semi")
    # Where no row repeats, there is nothing to drop and the sort is spared.
    if marked.groupBy("id").count().where((F.col("count") > 1) | F.col("id").isNull()).isEmpty():
        return rows.select("row.*")
    return rows.dropDuplicates(["_id", "_key"]).select("row.*")


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
