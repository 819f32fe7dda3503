"""Connected components of a graph of any size, by alternating stars.

A round rewires every node to the least neighbour it knows: first the larger
neighbours (large star), then the smaller ones (small star). Both keep what is
connected, and after a few rounds (a logarithm of the longest chain) every node
hangs on its component's least node. Before each round every partition connects
what it holds by itself, which changes nothing but the number of rounds. Hot nodes:
the least neighbour is a partial aggregate, and the join that hands it out is one
AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a partition connects at once.
HELD = 1 << 21


def least_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n entries the least one it is connected with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _flat(pairs: DataFrame) -> bool:
    """Whether the links are stars: every node hangs on one, which hangs on none."""
    hangs, holds = pairs.select(F.col("u").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), pairs.select(F.col("v").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    ends = hangs.unionByName(holds).groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return ends.where("hangs + holds > 1").isEmpty()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: the links of a partition as stars around the least node of each part
    that they connect."""

    def star(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = least_of(len(nodes), iter([(at[: len(u)], at[len(u) :])]))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= HELD:
            yield star(held)
            held, size = [], 0
    if held:
        yield star(held)


def _round(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # A node's own least neighbour stays a link too.
    large = cut(large.unionByName(least.where("m < n").select(F.col("n").alias("u"), F.col("m").alias("v"))).mapInArrow(_stars, "u long, v long").distinct())
    least = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    small = large.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).mapInArrow(_stars, "u long, v long").distinct())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of its component, for each node that a link
    to another names. Nodes are longs. Null ends and loops count as no link."""
    u, v = F.greatest(a, b), F.least(a, b)
    pairs = links.where(F.col(a) != F.col(b)).select(u.cast("long").alias("u"), v.cast("long").alias("v"))
    pairs = cut(pairs.mapInArrow(_stars, "u long, v long").distinct())
    while not _flat(pairs):
        pairs = _round(pairs)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
