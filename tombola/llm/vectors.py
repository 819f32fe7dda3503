"""Approximate nearest neighbours: inverted lists of product-quantised residuals.

Coarse centroids part the vectors into lists. They are pairs of centroids of the
two halves of a vector (an inverted multi-index): with the fourth root of the
number of vectors for each half there are as many lists as its square root, at
any size, while both halves fit on a bounded sample. A vector's residual (what is
left after its list's centroid) is quantised in PARTS parts of 256 codes. A query
probes the lists whose centroids are nearest; a table of its distances to all
codes of each part ranks a list's vectors by sums of table entries, and the best
of each list are reranked by exact distance to the original vectors.

What that finds is as near as the fit's sample promises only for queries that are
like the sample, so an exact check follows. The k-th found bounds the distances
that matter. By the triangle inequality a list is no nearer than its centroid less
its radius, and a coded vector no nearer than its code less the code's error. Rows
that may be as near as the bound, in whatever list, are compared by exact
distance, so no true neighbour is missed on any data. The better the index, the
fewer those are; of queries that lie alone they may be nearly all.

The centroids are fitted on a sample of at most TRAIN rows; every row is
indexed. How many lists to probe and how many of a list to rerank are measured
on the sample against brute force, for the recall RECALL, in the same way at every
size. How few that are depends on the data: of clustered vectors a few lists
do, of vectors that fill a sphere evenly about half are needed, as neighbours
are hardly nearer there than others. recall=1.0 probes and reranks everything;
check=False leaves the check out.

A list, and the queries that probe it, are dealt out in pieces of CHUNK vectors
and BLOCK queries, so a list of any size (one very common vector, say) is no
single task's work; each piece keeps its k best, which loses nothing.

Nulls: vectors that are null, zero, of another length than most, or that hold
nulls or non-finite numbers take no part, nor do rows without an id. Rows that
repeat an id count once, with the nearer vector; as a query such an id asks with
the vector whose bytes are least. Ties go to the smaller id. With no more rows
than k there are as many neighbours as other rows. Only id and vector are read,
so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions, small

TRAIN = 20_000
PARTS = 16
RECALL = 0.93
CHUNK, BLOCK = 4096, 512
#: Numbers held at once while queries rank lists or vectors.
HELD = 1 << 22
#: What rounding may add to a bound, as a share of the lengths it is made of.
SLACK = 1e-6
#: Up to so many lists their pieces are broadcast, beyond they are joined.
BROADCAST_LISTS = 100_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less |x|^2."""
    return (centres * centres).sum(1) - 2 * x @ centres.T


def fit_centres(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means; a centre that loses all its vectors takes the one farthest off."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        at = near.argmin(1)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            centres[:, d] = np.bincount(at, weights=x[:, d], minlength=k) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = (near[np.arange(len(x)), at] + (x * x).sum(1)).argsort()[::-1][: len(empty)]
            centres[empty] = x[far]
    return centres


@dataclass
class Index:
    """halves: the centroids of either half; list i * len(halves[1]) + j has the
    i-th of the first and the j-th of the second. All methods take vectors less `origin`."""

    halves: tuple[np.ndarray, np.ndarray]
    bounds: list[int]
    codes: list[np.ndarray]
    probes: int = 1
    rerank: float = 1.0
    origin: np.ndarray | float = 0.0

    @property
    def lists(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        i, j = np.divmod(lists, len(self.halves[1]))
        return np.concatenate([self.halves[0][i], self.halves[1][j]], axis=-1)

    def _to_halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.halves[0].shape[1]
        return _nearest(x[:, :at], self.halves[0]), _nearest(x[:, at:], self.halves[1])

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        first, second = self._to_halves(x)
        return first.argmin(1) * len(self.halves[1]) + second.argmin(1)

    def to_lists(self, x: np.ndarray) -> np.ndarray:
        """Distances to all lists' centroids, squared, less |x|^2."""
        first, second = self._to_halves(x)
        return (first[:, :, None] + second[:, None, :]).reshape(len(x), -1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = x - self.centroid(lists)
        parts = [_nearest(left[:, a:b], c).argmin(1) for a, b, c in zip(self.bounds, self.bounds[1:], self.codes, strict=False)]
        return np.stack(parts, axis=1).astype(np.uint8)

    def lost(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to their lists' centroids and to what their codes say."""
        left = x - self.centroid(lists)
        said = np.concatenate([c[codes[:, k]] for k, c in enumerate(self.codes)], axis=1)
        return np.linalg.norm(left, axis=1), np.linalg.norm(left - said, axis=1)

    def least_to_lists(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """No vector of a list, all of which lie between `inner` and `outer` of its
        centroid, is nearer to the query. Without differences of large squares."""
        at = self.halves[0].shape[1]
        first, second = (((q[:, None] - c) ** 2).sum(2) for q, c in zip((queries[:, :at], queries[:, at:]), self.halves, strict=True))
        far = np.sqrt(first[:, :, None] + second[:, None, :]).reshape(len(queries), -1)
        return np.maximum(far - outer, inner - far) - SLACK * (far + outer)

    def least(self, queries: np.ndarray, of: int, codes: np.ndarray, lost: np.ndarray) -> np.ndarray:
        """No vector of one list with these codes, whose errors are `lost`, is nearer."""
        near = np.sqrt(np.maximum(self.asymmetric(queries, of, codes), 0))
        left = np.linalg.norm(queries - self.centroid(np.array(of)), axis=1, keepdims=True)
        return near - lost - SLACK * (near + lost + left)

    def asymmetric(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Of each query to each coded vector of one list: squared distance."""
        left = queries - self.centroid(np.array(of))
        out = np.zeros((len(queries), len(codes)))
        for k, (a, b, c) in enumerate(zip(self.bounds, self.bounds[1:], self.codes, strict=False)):
            part = left[:, a:b]
            out += (_nearest(part, c) + (part * part).sum(1, keepdims=True))[:, codes[:, k]]
        return out


def fit(sample: np.ndarray, rows: int, k: int, recall: float = RECALL) -> Index:
    """An index for `rows` vectors from a sample of them, with the number of
    lists to probe and the share of a list to rerank that give the recall there."""
    width = sample.shape[1]
    origin = sample.mean(0)
    sample = sample - origin
    each = max(1, round(rows**0.25))
    at = (width + 1) // 2
    halves = fit_centres(sample[:, :at], each), fit_centres(sample[:, at:], each) if width > 1 else np.zeros((1, 0))
    bounds = [int(b) for b in np.linspace(0, width, min(PARTS, width) + 1)]
    index = Index(halves, bounds, [], origin=origin)
    lists = index.lists_of(sample)
    left = sample - index.centroid(lists)
    index.codes = [fit_centres(left[:, a:b], 256) for a, b in zip(bounds, bounds[1:], strict=False)]
    codes = index.encode(sample, lists)
    if recall >= 1:
        index.probes, index.rerank = index.lists, 1.0
        return index
    ranks, places = [], []
    for q in range(0, len(sample), max(1, len(sample) // 200)):
        far = _nearest(sample[q : q + 1], sample)[0]
        far[q] = np.inf
        true = far.argsort()[: min(k, len(far) - 1)]
        order = np.empty(index.lists, int)
        order[index.to_lists(sample[q : q + 1])[0].argsort()] = np.arange(index.lists)
        ranks += list(order[lists[true]] + 1)
        for t in true:
            own = np.flatnonzero(lists == lists[t])
            far_there = index.asymmetric(sample[q : q + 1], lists[t], codes[own])[0]
            places.append(((far_there < far_there[own == t][0]).sum() + 1) / len(own))
    share = (1 + recall) / 2  # either step may lose half of what may be lost
    index.probes = int(np.quantile(ranks, share, method="higher")) if ranks else index.lists
    index.rerank = float(min(1.0, np.quantile(places, share, method="higher"))) if places else 1.0
    return index


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width)


def search(vectors: DataFrame, queries: Column, k: int = 10, *, id_col: str = "vec_id", vector: str = "embedding", train: int = TRAIN, recall: float = RECALL, check: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which `queries` holds, its
    k nearest other rows, by Euclidean distance in doubles; without `check`, of those found."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.where(valid(F.col(vector)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), queries.alias("asks"), F.col(vector).alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if lengths is None:
        return spark.createDataFrame([], empty)
    width, total = lengths
    rows = rows.where(F.size("vector") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(train).select("vector").toPandas()["vector"]
    index = fit(np.array(sample.tolist(), dtype=float), total, k, recall)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["vector"].tolist(), dtype=float).reshape(len(batch), width)
            lists = index.lists_of(x - index.origin)
            codes = index.encode(x - index.origin, lists)
            far, lost = index.lost(x - index.origin, lists, codes)
            yield pd.DataFrame({"list": lists, "vec_id": batch["vec_id"], "asks": batch["asks"].fillna(False), "raw": [v.tobytes() for v in x.astype(kind)], "codes": [c.tobytes() for c in codes], "far": far, "lost": lost})

    index_rows = cut(rows.mapInPandas(coded, "list long, vec_id long, asks boolean, raw binary, codes binary, far double, lost double"))
    # One row a list, of which there are about the square root of all rows.
    sizes, inner, outer = np.zeros(index.lists, int), np.zeros(index.lists), np.zeros(index.lists)
    for list_id, *of in index_rows.groupBy("list").agg(F.count("*"), F.min("far"), F.max("far")).collect():
        sizes[list_id], inner[list_id], outer[list_id] = of

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, HELD // index.lists)
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.iloc[start : start + step]
                order = index.to_lists(_matrix(batch["raw"], kind, width).astype(float) - index.origin).argsort(1, kind="stable")
                # Further lists, where those hold too few rows for k neighbours.
                enough = (sizes[order].cumsum(1) <= 2 * k).sum(1) + 1
                n = np.minimum(np.maximum(index.probes, enough), order.shape[1])
                picks = np.concatenate([o[:m] for o, m in zip(order, n, strict=True)])
                at = np.repeat(np.arange(len(batch)), n)
                full = sizes[picks] > 0
                yield pd.DataFrame({"list": picks[full], "query_id": batch["vec_id"].to_numpy()[at][full], "query": batch["raw"].to_numpy()[at][full]})

    def may_hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, HELD // max(index.lists, sum(h.size for h in index.halves)))
        for whole in batches:
            for start in range(0, len(whole), step):
                batch = whole.iloc[start : start + step]
                q = _matrix(batch["raw"], kind, width).astype(float)
                # With what subtracting the origin, or the distance itself, may have rounded off.
                bounds = batch["bound"].to_numpy() * (1 + SLACK**2) + SLACK**2 * np.linalg.norm(q, axis=1)
                at, picks = np.nonzero((sizes > 0) & ~(index.least_to_lists(q - index.origin, inner, outer) > bounds[:, None]))
                yield pd.DataFrame({"list": picks, "query_id": batch["vec_id"].to_numpy()[at], "query": batch["raw"].to_numpy()[at], "bound": bounds[at]})

    asking = cut(index_rows.where("asks").groupBy("vec_id").agg(F.min("raw").alias("raw")))

    def meet(probes: DataFrame, search_one: Callable[..., pd.DataFrame]) -> DataFrame:
        """What search_one finds for the queries of `probes` in their lists: query_id, vec_id, score."""
        probes = cut(probes)
        asked = np.zeros(len(sizes), int)
        for list_id, n in probes.groupBy("list").count().collect():
            asked[list_id] = n
        chunks, blocks = -(-sizes // CHUNK), -(-asked // BLOCK)
        pieces = spark.createDataFrame([(k_, max(1, int(c)), int(b)) for k_, (c, b) in enumerate(zip(chunks, blocks, strict=True)) if b], "list long, chunks int, blocks int")
        pieces = small(pieces, BROADCAST_LISTS)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = index_rows.join(pieces, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), each("blocks").alias("block"), "vec_id", "raw", "codes", "lost")
        right = probes.join(pieces, "list").select("list", each("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), *[c for c in probes.columns if c != "list"])
        n = shuffle_partitions(spark)
        key = ["list", "chunk", "block"]
        found = left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key)).applyInPandas(search_one, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def best(key: tuple, there: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(there) and len(asking):
            there = there.sort_values("vec_id", kind="stable")
            ids, x, codes = there["vec_id"].to_numpy(), _matrix(there["raw"], kind, width).astype(float), _matrix(there["codes"], "u1", len(index.codes))
            depth = min(len(ids), max(2 * k, math.ceil(index.rerank * len(ids)) + k))
            q, q_ids = _matrix(asking["query"], kind, width).astype(float), asking["query_id"].to_numpy()
            for at in range(0, len(q), step := max(1, HELD // (len(ids) + depth * width))):
                own, own_ids = q[at : at + step], q_ids[at : at + step]
                near = index.asymmetric(own - index.origin, key[0], codes)
                near[own_ids[:, None] == ids] = np.inf
                # Stable and by id, so that of equal vectors the least ids are taken.
                picks = np.sort(near.argsort(1, kind="stable")[:, :depth], axis=1)
                exact = np.sqrt(((x[picks] - own[:, None]) ** 2).sum(2))
                exact[ids[picks] == own_ids[:, None]] = np.inf
                first = exact.argsort(1, kind="stable")[:, :k]
                found = np.take_along_axis(exact, first, 1).ravel()
                good = np.isfinite(found)
                out.append((np.repeat(own_ids, first.shape[1])[good], ids[np.take_along_axis(picks, first, 1)].ravel()[good], found[good]))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    def near_enough(key: tuple, there: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(there) and len(asking):
            ids, x, codes, lost = there["vec_id"].to_numpy(), _matrix(there["raw"], kind, width).astype(float), _matrix(there["codes"], "u1", len(index.codes)), there["lost"].to_numpy()
            q, q_ids, bounds = _matrix(asking["query"], kind, width).astype(float), asking["query_id"].to_numpy(), asking["bound"].to_numpy()
            for start in range(0, len(q), step := max(1, HELD // len(ids))):
                part = slice(start, start + step)
                far = index.least(q[part] - index.origin, key[0], codes, lost) > bounds[part, None]
                at, picks = np.nonzero(~far & (ids != q_ids[part, None]))
                at += start
                exact = np.zeros(len(at))
                for p in range(0, len(at), pairs := max(1, HELD // width)):
                    exact[p : p + pairs] = np.sqrt(((x[picks[p : p + pairs]] - q[at[p : p + pairs]]) ** 2).sum(1))
                good = exact <= bounds[at]
                at, picks, exact = at[good], picks[good], exact[good]
                # An id counts once, with its nearest vector; k ids a query are enough.
                order = np.lexsort((exact, ids[picks], at))
                at, own, exact = at[order], ids[picks][order], exact[order]
                once = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1])][: len(at)]
                at, own, exact = at[once], own[once], exact[once]
                order = np.lexsort((own, exact, at))
                at, own, exact = at[order], own[order], exact[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                out.append((q_ids[at[first]], own[first], exact[first]))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    def nearest(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
        return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)

    found = nearest(meet(asking.mapInPandas(probed, "list long, query_id long, query binary"), best))
    if not check or recall >= 1:
        return found
    found = cut(found)
    bounds = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    asking = asking.join(bounds, "vec_id", "left").select("vec_id", "raw", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    checked = meet(asking.mapInPandas(may_hold, "list long, query_id long, query binary, bound double"), near_enough)
    both = found.select("query_id", "vec_id", "score").unionByName(checked)
    return nearest(both.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))


def op8(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % 100 == 0, 10)
