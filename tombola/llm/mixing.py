"""Mixing sources to target weights along a time-varying curriculum.

A schedule gives each class of sources a weight at knots of training time from 0
to 1, linear between. Integrating it gives the source's share of the budget, and
its cumulative token demand over time. Each source's documents stand in a fixed
pseudo-random order, pass after pass; inverting the cumulative demand at the
words before a document gives the training position at which it is due. Documents
are range-sorted by position.

Rows that are equal in all columns are planned as one row with a number and dealt
out again afterwards; rows are known by a hash of all their columns, never by
their id, so ids may repeat, within and across sources, or be null.

Nulls: a null text has no words; a null source is a source of its own, the last
in code-point order. A document without words is never due. Repeated rows are
documents of their own. Ties in the order (only rows of one id and one text) are broken by the hash of the
row. A very long text is one document, cut only where a target ends. Columns that
documents have besides may have any name (but not the type map, which can't be
hashed). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, running, shuffle_partitions, small

#: Up to so many sources their figures are broadcast, beyond they are joined.
BROADCAST_SOURCES = 20_000
#: Documents of one source meet in one task by the run of the shuffled order
#: they fall into; a source has so many runs that each has about this many.
RUN_ROWS = 2_000
#: So many copies of one row are dealt out by one task.
COPY_RUN = 1_000


@dataclass(frozen=True)
class Curriculum:
    """weights[class][knot]: the class's weight at each of the evenly spaced
    knots over training time 0 to 1."""

    weights: tuple[tuple[float, ...], ...]

    def __post_init__(self) -> None:
        if len({len(w) for w in self.weights}) != 1 or len(self.weights[0]) < 2 or min(map(min, self.weights)) < 0:
            raise ValueError("every class needs the same number of knots, two or more, and weights of 0 or more")

    def integral(self, k: int) -> float:
        w = self.weights[k]
        return sum((a + b) / 2 for a, b in zip(w, w[1:], strict=False)) / (len(w) - 1)

    def invert(self, klass: Column, share: Column) -> Column:
        """The time at which the class's cumulative demand reaches `share` (0 to
        1) of its whole: in the linear piece where that happens, the root of
        a quadratic."""
        out = F.lit(None).cast("double")
        for k, w in reversed(list(enumerate(self.weights))):
            out = F.when(klass == k, self._time(w, share * F.lit(self.integral(k)))).otherwise(out)
        return out

    def _time(self, w: tuple[float, ...], due: Column) -> Column:
        width = 1.0 / (len(w) - 1)
        areas = [(a + b) / 2 * width for a, b in zip(w, w[1:], strict=False)]
        out = F.lit(1.0)
        for k in range(len(areas) - 1, -1, -1):
            before, a, slope = sum(areas[:k]), w[k], (w[k + 1] - w[k]) / width
            rest = F.greatest(due - F.lit(before), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0)))
            step = F.when(rest <= 0, F.lit(0.0)).otherwise(F.try_divide(2 * rest, F.lit(a) + root))
            out = F.when(due <= F.lit(before + areas[k]), F.lit(k * width) + F.least(F.coalesce(step, F.lit(width)), F.lit(width))).otherwise(out)
        return out


#: Weights 3, 1 and 2 as integrals: the first class fades, the second grows.
THREE_ONE_TWO = Curriculum(((4.0, 3.0, 2.0), (0.5, 1.0, 1.5), (2.0, 2.0, 2.0)))


def source_targets(sizes: DataFrame, curriculum: Curriculum, share: float, most_passes: float) -> DataFrame:
    """One row a source: source, source_rows, source_size, klass, target. sizes:
    source, size and copies (of rows of that size).

    The budget, `share` of all sizes, goes out by weight; a source stops at
    `most_passes` times its size and what it leaves is reshared by weight, until
    none is above. That ends at a level L where a source has the lesser of L
    times its weight and its limit; with the sources in order of limit by weight
    the level is found in one pass of running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("copies").alias("source_rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    n = len(curriculum.weights)
    klass = F.pmod("place", F.lit(n)).cast("int")
    weight = F.lit(0.0)
    for k in range(n):
        weight = F.when(F.col("klass") == k, F.lit(curriculum.integral(k))).otherwise(weight)
    sources = running(by, [F.col("source").asc_nulls_last()], []).withColumn("klass", klass).drop("place")
    sources = cut(sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most_passes)) * F.col("source_size")))
    budget, weights = sources.agg(F.lit(share) * F.sum("source_size"), F.sum("weight")).head()
    filled = running(sources.withColumn("full_at", F.expr("try_divide(`limit`, weight)")), [F.col("full_at").asc_nulls_last(), F.col("source").asc_nulls_last()], ["limit", "weight"])
    here = F.try_divide(F.lit(budget).cast("double") - F.col("before_limit"), F.lit(weights).cast("double") - F.col("before_weight"))
    level = filled.withColumn("here", here).where(F.col("here") * F.col("weight") <= F.col("limit")).agg(F.min_by("here", "place")).head()[0]
    target = F.col("limit") if level is None else F.least(F.lit(level) * F.col("weight"), F.col("limit"))
    return sources.select("source", "source_rows", "source_size", "klass", target.alias("target"))


def _row_hash(docs: DataFrame) -> list[Column]:
    """128 bits of all columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias("one"), F.xxhash64(F.lit(1), *columns).alias("two")]


def _plan(docs: DataFrame, *, curriculum: Curriculum, share: float, most_passes: int, text: str, key: str, source: str, seed: str) -> DataFrame:
    """One row for all equal rows: key, source, size, one and two (the row's hash),
    copies, source_size, target, klass, and `start`, the words that stand before
    the first of them in a pass over the source."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.regexp_count(raw, F.lit(WORD)).cast("long")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(raw)))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words.alias("size"), order.alias("shuffled"), *_row_hash(docs))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))  # words are counted once
    targets = small(cut(source_targets(rows, curriculum, share, most_passes)), BROADCAST_SOURCES)
    # Two-level running sum. A run is a range of the first 16 bits of the order.
    place = F.conv(F.substring("shuffled", 1, 4), 16, 10).cast("long")
    runs = F.least(F.greatest(F.ceil(F.col("source_rows") / RUN_ROWS), F.lit(1)), F.lit(65536))
    rows = rows.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    rows = rows.withColumn("run", F.floor(place * runs / 65536).cast("long")).withColumn("all_words", F.col("size") * F.col("copies"))
    per_run = rows.groupBy("source", "run").agg(F.sum("all_words").alias("run_size"))
    in_source = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.select(F.col("source").alias("of_source"), F.col("run").alias("of_run"), F.coalesce(F.sum("run_size").over(in_source), F.lit(0)).alias("run_start"))
    per_run = small(cut(per_run), BROADCAST_SOURCES)
    rows = rows.join(per_run, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("run") == F.col("of_run")), "left").drop("of_source", "of_run")
    in_run = Window.partitionBy("source", "run").orderBy("shuffled", F.col("key").asc_nulls_last(), "size", "one", "two").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("run_start") + F.coalesce(F.sum("all_words").over(in_run), F.lit(0))
    return rows.select("key", "source", "size", "one", "two", "copies", "source_size", "target", "klass", start.alias("start"))


def _dealt(plan: DataFrame, curriculum: Curriculum, most_passes: int) -> DataFrame:
    """One row a document again, with `passes`: words taken and position, for each
    pass in which it is taken. Copies are dealt out in runs of COPY_RUN."""
    spread = plan.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPY_RUN}"))))
    spread = spread.repartition(shuffle_partitions(plan.sparkSession), "one", "two", "part")
    nth = F.explode(F.sequence(F.col("part") * COPY_RUN, F.least((F.col("part") + 1) * COPY_RUN, F.col("copies")) - 1)).alias("nth")
    rows = spread.select("*", nth).withColumn("before", F.col("start") + F.col("nth") * F.col("size"))
    whole = F.floor("target")
    each = []
    for k in range(most_passes):
        words = F.least(F.greatest(whole - k * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size")).cast("long")
        due = F.when(F.col("target") > 0, (F.col("before") + k * F.col("source_size")) / F.col("target"))
        each.append(F.struct(words.alias("words"), F.least(due, F.lit(1.0)).alias("due")))
    # Inside a lambda what is due is a variable, so that the many branches of the
    # inversion don't repeat its expression.
    placed = F.transform(F.array(*each), lambda p: F.struct(p["words"].alias("words"), curriculum.invert(F.col("klass"), p["due"]).alias("position")))
    return rows.withColumn("passes", F.filter(placed, lambda p: p["words"] > 0))


def mix(docs: DataFrame, *, curriculum: Curriculum = THREE_ONE_TWO, share: float = 1.5, most_passes: int = 2, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row a document: key, source, size, source_size, target, taken,
    position (when it is first due, null if it isn't taken), passes (words taken
    and position, for each pass it is taken in). `taken` counts repeats. Each
    source's taken words add up to its target's whole part: its documents are
    taken in order, pass after pass, and the last one is cut where the target
    ends."""
    plan = _plan(docs, curriculum=curriculum, share=share, most_passes=most_passes, text=text, key=key, source=source, seed=seed)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    rows = _dealt(plan, curriculum, most_passes)
    return rows.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), F.get("passes", F.lit(0))["position"].alias("position"), "passes")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; what isn't taken comes last."""
    n = shuffle_partitions(mixed.sparkSession)
    order = [F.col("position").asc_nulls_last(), F.xxhash64(mixed.columns[0])]
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order)


def op1(docs: DataFrame) -> DataFrame:
    return in_training_order(mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "position")


def mixed_documents(docs: DataFrame, *, curriculum: Curriculum = THREE_ONE_TWO, share: float = 1.5, most_passes: int = 2, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """The documents of the mix in training order, with the columns of `docs`:
    whole texts, as often as they are taken. Where a target ends inside
    a document, it is in if at least half of it is.

    Rows meet their plan by the hash of the row. Of rows that are equal in all
    columns one is taken as often as all of them are due."""
    plan = cut(_plan(docs, curriculum=curriculum, share=share, most_passes=most_passes, text=text, key=key, source=source, seed=seed))
    due = _dealt(plan, curriculum, most_passes).select(F.col("one").alias("of_one"), F.col("two").alias("of_two"), "copies", F.explode(F.filter("passes", lambda p: 2 * p["words"] >= F.col("size"))).alias("pass"))
    due = cut(due.select("of_one", "of_two", "copies", "pass.position"))
    rows = docs.select(F.struct("*").alias("row"), *_row_hash(docs))
    same = (F.col("one") == F.col("of_one")) & (F.col("two") == F.col("of_two"))
    many = small(plan.where("copies > 1").select(F.col("one").alias("of_one"), F.col("two").alias("of_two")), BROADCAST_SOURCES)
    repeated = cut(rows.join(many, same, "left_semi").groupBy("one", "two").agg(F.first("row").alias("row")))
    out = rows.join(due.where("copies = 1"), same).unionByName(repeated.join(due.where("copies > 1"), same), allowMissingColumns=False)
    order = [F.col("position"), F.col("one"), F.col("two")]
    return out.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("row.*")


#: op1 in SQL: the same schedule (weights 4-3-2, 0.5-1-1.5 and 2-2-2 over two
#: pieces of time), targets, order and positions.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS shuffled
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS klass FROM s),
w AS (SELECT *, CASE klass WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, 2e0 * source_size AS most FROM k),
filling AS (
  SELECT *, 1.5e0 * sum(source_size) OVER () AS budget,
         coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS full_before,
         sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM w),
lv AS (SELECT arg_min((budget - full_before) / weight_from, full_before) AS level FROM filling WHERE (budget - full_before) / weight_from * weight <= most),
t AS (SELECT source, source_size, klass, least((SELECT level FROM lv) * weight, most) AS target FROM w),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.klass, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, least(greatest(CAST(floor(target) AS BIGINT) - before, 0), size) AS first_words,
         least(greatest(CAST(floor(target) AS BIGINT) - source_size - before, 0), size) AS second_words,
         CASE WHEN target > 0 THEN least(before / target, 1e0) * (CASE klass WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END) END AS due
  FROM o),
q AS (
  SELECT *, CASE klass WHEN 0 THEN 1.75e0 WHEN 1 THEN 0.375e0 ELSE 1e0 END AS half, CASE klass WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS whole,
         CASE klass WHEN 0 THEN -2e0 WHEN 1 THEN 1e0 ELSE 0e0 END AS slope FROM p),
r AS (
  SELECT *, CASE WHEN due <= half THEN CASE klass WHEN 0 THEN 4e0 WHEN 1 THEN 0.5e0 ELSE 2e0 END ELSE CASE klass WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END END AS a,
         CASE WHEN due <= half THEN 0e0 ELSE 0.5e0 END AS begins, greatest(CASE WHEN due <= half THEN due ELSE due - half END, 0e0) AS rest FROM q)
SELECT doc_id, size, source_size, target, CAST(first_words + second_words AS BIGINT) AS taken,
       CASE WHEN first_words > 0 THEN CASE WHEN due > whole THEN 1e0 WHEN rest <= 0 THEN begins
         ELSE begins + least(2 * rest / (a + sqrt(greatest(a * a + 2 * slope * rest, 0e0))), 0.5e0) END END AS position
FROM r
"""
