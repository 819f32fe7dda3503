"""Whitening of embeddings by a singular value decomposition.

Entries become whole numbers, x = floor(1024 c) + 100000, whose sums a dimension are
exact. The rows, centred on the means, are a distributed matrix; MLlib's
computeSVD gives its right singular vectors V and singular values s, from sums of
outer products that executors make of their rows (a square of the dimensions
reaches the driver, never a row). V's columns are the covariance's unit
eigenvectors and s * s / n its eigenvalues. The total variance is counted separately, from every
row's exact squared deviation. A row, projected on a component and divided by
the eigenvalue's root, is whitened; that the whitened columns' covariance is
the identity is measured over all rows.

The fit list is every vector that takes part. Nulls: a null vector, one with a null
or not finite entry, an empty one, and one with an entry beyond 2 to the 51st (whose
x isn't a long) take no part; a null id is kept. Where vectors have several lengths,
those of the most frequent one take part, of equally frequent ones the longest. Repeated rows are rows of their
own. Components come by falling eigenvalue, equal ones as the decomposition has
them. A direction without variance (a singular value below a billionth of the
first) is no component, so a single or all equal vectors have none and give no rows.
An empty table gives an empty result. Only id and vector are read, so other
columns may have any name. A deviation that no long can hold is null; `spread`
has it as a double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Larger entries have no x.
LARGEST = float(1 << 51)


@dataclass(frozen=True)
class Fit:
    """n vectors, the exact sums of their dimensions, components (a column each)
    and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray


def whole(entry: Column) -> Column:
    """Null where there is none: rows may be tested before they are dropped."""
    return F.try_add(F.floor(entry.cast("double") * SCALE).cast("long"), F.lit(SHIFT))


def prepared(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x, of all vectors that take part, lengths aside."""
    at = F.col(f"`{vector}`")
    good = F.forall(at, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)) & ~F.isnan(c))
    return rows.where(at.isNotNull() & (F.size(at) > 0) & good).select(F.col(f"`{key}`").alias("key"), F.transform(at, whole).alias("x"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n, and the exact sums by dimension, of the vectors of the most frequent
    length. Sums are split in two, so that no long overflows."""
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).head()
    if first is None:
        return 0, []
    each = rows.where(F.size("x") == first["size"]).select(F.posexplode("x").alias("at", "x"))
    by = each.groupBy("at").agg(F.sum(F.shiftright("x", 20)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 20) - 1))).alias("low"))
    return first["n"], [(r["high"] << 20) + r["low"] for r in by.orderBy("at").collect()]  # a row a dimension


def fit(rows: DataFrame, most: int = 8) -> Fit | None:
    """Of x-vectors; None where there are none."""
    n, total = sums(rows)
    if not n:
        return None
    means = F.array(*[F.lit(s / n) for s in total])
    centred = rows.where(F.size("x") == len(total)).select(array_to_vector(F.zip_with("x", means, lambda x, m: x.cast("double") - m)).alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v")).computeSVD(min(most, len(total)), computeU=False)
    singular = found.s.toArray()
    some = singular > 0
    return Fit(n, tuple(total), found.V.toArray()[:, some], singular[some] ** 2 / n)


def exact_squares(x: np.ndarray, n: int, total: np.ndarray) -> list[int]:
    """Of each row the sum over dimensions of (n x - S) squared, exactly."""
    if n * int(np.abs(x).max(initial=0)) + int(max(map(abs, total.tolist()))) < 1 << 62:
        away = n * x - total.astype(np.int64)
        if int(np.abs(away).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - total
    return (away * away).sum(axis=1).tolist()


def whitened(rows: DataFrame, of: Fit) -> DataFrame:
    """key, deviation, spread, and the row's whitened components as an array."""

    @F.pandas_udf("deviation long, spread double, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        total = np.array(of.sums, dtype=object)
        means = np.array([s / of.n for s in of.sums])
        onto = of.components / np.sqrt(of.values)
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(of.sums)), np.int64)
            exact = exact_squares(x, of.n, total)
            white = (x.astype(np.float64) - means) @ onto
            longs = pd.array([v if v < 1 << 63 else None for v in exact], dtype="Int64")
            yield pd.DataFrame({"deviation": longs, "spread": [float(v) for v in exact], "whitened": list(white)})

    return rows.where(F.size("x") == len(of.sums)).select("key", project("x").alias("of")).select("key", "of.*")


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest entry of the whitened columns' covariance (divisor n, centred)
    minus the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).head()
    return max((abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True)), default=0.0)


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each vector and component (from 1): key, component, n, deviation,
    whitened, explained, identity_error."""
    rows = prepared(vectors, key=key, vector=vector)
    of = fit(rows, components)
    schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if of is None or not len(of.values):
        return vectors.sparkSession.createDataFrame([], schema)
    done = cut(whitened(rows, of))
    total = done.agg(F.sum("spread")).head()[0] / float(of.n) ** 3
    error = identity_error(done, len(of.values))
    explained = F.array(*[F.lit(float(v / total)) for v in of.values])
    each = done.select("key", "deviation", F.posexplode("whitened").alias("at", "white"))
    return each.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(of.n).cast("long").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
