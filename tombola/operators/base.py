"""The base report: statistics of the eligible draws over the numbers 0 to 99.

All small reports come from one exploded frame (`exploded`), which callers may
cache. Ties are broken by a total order everywhere: where the order of first
encounter matters, the least (date, lottery, draw, position) goes along.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import mirror, normalized
from ..sources.schema import Dims
from .frequency import UNIVERSE

LATEST_ROWS = 80
MIRROR_DAYS = 14
#: Days of a block in which the order of all rows is taken.
BLOCK_DAYS = 8


def _pairs(spark, rows: tuple, *names: str) -> DataFrame:
    """The rows as a table that the plan holds itself, so Spark knows its size."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns, strict=True)}))


def visible(draws: DataFrame, dims: Dims) -> DataFrame:
    """Rows whose draw is visible by its normalised name or by its alias's."""
    spark = draws.sparkSession
    shown = _pairs(spark, dims.visible, "_lottery", "_draw").select("_lottery", normalized(F.col("_draw")).alias("_key"))
    if dims.aliases:
        alias = _pairs(spark, dims.aliases, "_alias", "_draw").select("_alias", normalized(F.col("_draw")).alias("_to"))
        more = shown.join(alias, F.col("_key") == F.col("_to")).select("_lottery", F.col("_alias").alias("_key"))
        shown = shown.unionByName(more)
    return draws.join(shown, (F.col("lottery") == F.col("_lottery")) & (normalized(F.col("draw")) == F.col("_key")), "left_semi")


def canonical_label(draws: DataFrame, dims: Dims) -> DataFrame:
    """Adds canonical: the draw's alias, else its name cleaned."""
    alias = _pairs(draws.sparkSession, dims.aliases, "_alias", "canonical")
    return draws.join(alias, normalized(F.col("draw")) == F.col("_alias"), "left").drop("_alias").withColumn("canonical", F.coalesce("canonical", F.trim("draw")))


def display_label(draws: DataFrame, dims: Dims) -> DataFrame:
    """Adds label, of the exact pair or else of its alias; drops rows with neither."""
    spark = draws.sparkSession
    labels = _pairs(spark, dims.labels, "_lottery", "_draw", "_label")
    alias = _pairs(spark, dims.aliases, "_alias", "_to")
    rows = draws.join(alias, normalized(F.col("draw")) == F.col("_alias"), "left").drop("_alias")
    rows = rows.join(labels, (F.col("lottery") == F.col("_lottery")) & (F.col("draw") == F.col("_draw")), "left").withColumnRenamed("_label", "_exact").drop("_lottery", "_draw")
    rows = rows.join(labels, (F.col("lottery") == F.col("_lottery")) & (F.col("_to") == F.col("_draw")), "left")
    return rows.withColumn("label", F.coalesce("_exact", "_label")).where("label IS NOT NULL").drop("_exact", "_label", "_lottery", "_draw", "_to")


def eligible(draws: DataFrame, dims: Dims) -> DataFrame:
    rows = draws.where((F.col("draw_date") >= F.lit(dims.start).cast("date")) & (F.size("numbers") >= 3) & F.col("lottery").isin(*dims.lotteries))
    return visible(rows, dims)


def window(base: DataFrame, dims: Dims) -> DataFrame:
    start = F.lit(dims.start).cast("date")
    return base.agg(start.alias("from_date"), F.coalesce(F.max("draw_date"), start).alias("to_date"), F.count("*").alias("results"))


def last_day(base: DataFrame, dims: Dims) -> Column:
    """The newest eligible date, as a scalar subquery."""
    return window(base, dims).select("to_date").scalar()


def exploded(base: DataFrame, dims: Dims) -> DataFrame:
    """A row a date, draw and position 1 to 3, with the flags recent_7 and
    recent_30 and the order of encounter."""
    rows = base.withColumn("_last", last_day(base, dims))
    rows = rows.select("draw_date", "lottery", "draw", "_last", F.posexplode(F.slice("numbers", 1, 3)).alias("pos", "number"))
    return rows.select(
        "draw_date", "lottery", "draw", (F.col("pos") + 1).alias("pos"), "number", F.struct("draw_date", "lottery", "draw", "pos").alias("met"),
        (F.col("draw_date") >= F.date_sub("_last", 6)).alias("recent_7"), (F.col("draw_date") >= F.date_sub("_last", 29)).alias("recent_30"), F.col("_last").alias("last_day"),
    )


def _top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n with their rank: each task passes on n rows at most."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def counts(each: DataFrame) -> DataFrame:
    return each.groupBy("number").agg(F.count("*").alias("frequency"), F.count_if("recent_7").alias("recent_7"), F.count_if("recent_30").alias("recent_30"))


def top_repeated(each: DataFrame, recent: bool, n: int = 10) -> DataFrame:
    rows = each.where("recent_30") if recent else each
    rows = rows.groupBy("number").agg(F.count("*").alias("cnt"), F.min("met").alias("met"))
    return _top(rows, n, F.desc("cnt"), F.asc("met")).select("rank", "number", "cnt")


def position_counts(each: DataFrame) -> DataFrame:
    return each.groupBy("pos", "number").agg(F.count("*").alias("frequency"), F.max("draw_date").alias("last_seen"))


def _delays(each: DataFrame, by: list[str], n: int) -> DataFrame:
    rows = each.groupBy(*by, "number").agg(F.count("*").alias("frequency"), F.max("draw_date").alias("last_seen"), F.min("met").alias("met"), F.max("last_day").alias("last_day"))
    rows = rows.withColumn("delay_days", F.datediff("last_day", "last_seen"))
    order = Window.partitionBy(*by).orderBy(F.desc("delay_days"), F.desc("frequency"), F.asc("met"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(*by, "rank", "number", "delay_days", "last_seen", "frequency")


def delayed_by_position(each: DataFrame, n: int = 10) -> DataFrame:
    return _delays(each, ["pos"], n)


def delayed_by_label(each: DataFrame, dims: Dims, n: int = 3) -> DataFrame:
    """Over labels that match the raw names exactly."""
    labels = _pairs(each.sparkSession, dims.delay_labels, "_lottery", "_draw", "label")
    rows = each.join(labels, (F.col("lottery") == F.col("_lottery")) & (F.col("draw") == F.col("_draw")))
    return _delays(rows, ["label", "pos"], n)


def pair_counts(base: DataFrame, dims: Dims) -> DataFrame:
    """a < b of one row's first three numbers, all-time and in 30 days."""
    rows = base.withColumn("_last", last_day(base, dims))
    distinct = F.array_sort(F.array_distinct(F.slice("numbers", 1, 3)))
    rows = rows.select("draw_date", "lottery", "draw", "_last", distinct.alias("n"))
    rows = rows.select("*", F.posexplode("n").alias("i", "a")).select("*", F.explode(F.slice("n", F.col("i") + 2, 3)).alias("b"))
    return rows.groupBy("a", "b").agg(
        F.count("*").alias("cnt"), F.count_if(F.col("draw_date") >= F.date_sub("_last", 29)).alias("recent_30"), F.min(F.struct("draw_date", "lottery", "draw")).alias("met"),
        F.min(F.when(F.col("draw_date") >= F.date_sub("_last", 29), F.struct("draw_date", "lottery", "draw"))).alias("met_recent"),
    )


def frequent_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return _top(pairs, n, F.desc("cnt"), F.asc("met"), F.asc("a"), F.asc("b")).select("rank", "a", "b", "cnt")


def bullet_pair(pairs: DataFrame) -> DataFrame:
    """The best pair of the last 30 days, or else of all time: a pair seen lately
    sorts before any that isn't."""
    order = [F.desc(F.col("recent_30") > 0), F.desc(F.when(F.col("recent_30") > 0, F.col("recent_30")).otherwise(F.col("cnt"))), F.coalesce("met_recent", "met").asc(), F.asc("a"), F.asc("b")]
    count = F.when(F.col("recent_30") > 0, F.col("recent_30")).otherwise(F.col("cnt"))
    return pairs.orderBy(*order).limit(1).select("a", "b", count.alias("cnt"))


def latest_counts(base: DataFrame, dims: Dims, rows: int = LATEST_ROWS) -> DataFrame:
    """Counts over the newest rows that are also within 30 days."""
    lately = F.col("draw_date") >= F.date_sub(last_day(base, dims), 29)
    newest = base.orderBy(F.desc("draw_date"), F.desc("lottery"), F.desc("draw")).limit(rows).where(lately)
    return newest.select(F.explode(F.slice("numbers", 1, 3)).alias("number")).groupBy("number").agg(F.count("*").alias("cnt"))


def coincidences(each: DataFrame) -> DataFrame:
    """Per number, the lotteries that drew it on one day, summed over the days on
    which more than one did."""
    days = each.groupBy("draw_date", "number").agg(F.count_distinct("lottery").alias("n"), F.min("met").alias("met"), F.first("recent_30").alias("recent_30")).where("n > 1")
    return days.groupBy("number").agg(F.sum("n").alias("cnt"), F.coalesce(F.sum(F.when(F.col("recent_30"), F.col("n"))), F.lit(0)).alias("recent_30"), F.min("met").alias("met"))


def _carried(base: DataFrame) -> DataFrame:
    """draw_date, lottery, draw, number of numbers repeated from the row before, in
    the order of all rows, if that is at most a day older. The order is taken in
    blocks of days; the last day of a block also goes before the next one."""
    number = F.datediff("draw_date", F.lit("1970-01-01").cast("date"))
    block = F.floor(number / BLOCK_DAYS)
    blocks = F.when(F.pmod(number, F.lit(BLOCK_DAYS)) == BLOCK_DAYS - 1, F.array(block, block + 1)).otherwise(F.array(block))
    rows = base.select("draw_date", "lottery", "draw", F.array_distinct(F.slice("numbers", 1, 3)).alias("numbers"), block.alias("_own"), F.explode(blocks).alias("_block"))
    order = Window.partitionBy("_block").orderBy("draw_date", "lottery", "draw")
    rows = rows.select("*", F.lag("numbers").over(order).alias("_prev"), F.lag("draw_date").over(order).alias("_seen"))
    rows = rows.where((F.col("_block") == F.col("_own")) & (F.col("_seen") >= F.date_sub("draw_date", 1)))
    return rows.select("draw_date", "lottery", "draw", F.explode(F.array_intersect("numbers", "_prev")).alias("number"))


def drags(base: DataFrame, dims: Dims) -> DataFrame:
    """Numbers repeated from the row before, counted."""
    rows = _carried(base).withColumn("_last", last_day(base, dims))
    lately = F.col("draw_date") >= F.date_sub("_last", 29)
    return rows.groupBy("number").agg(F.count("*").alias("cnt"), F.count_if(lately).alias("recent_30"), F.min(F.struct("draw_date", "lottery", "draw")).alias("met"))


def moves(each: DataFrame) -> DataFrame:
    """Lotteries that drew the number; 0 if it is just one."""
    n, lately = F.count_distinct("lottery"), F.count_distinct(F.when(F.col("recent_30"), F.col("lottery")))
    several = lambda c: F.when(c > 1, c).otherwise(F.lit(0))
    return each.groupBy("number").agg(several(n).alias("cnt"), several(lately).alias("recent_30"))


def mirror_counts(each: DataFrame) -> DataFrame:
    """A number's count and its mirror's, where both were seen; lately, where the
    mirror was."""
    return _mirrors(counts(each))


def _mirrors(counted: DataFrame) -> DataFrame:
    own = counted.select("number", "frequency", F.col("recent_30").alias("r"))
    other = own.select(F.col("number").alias("m"), F.col("frequency").alias("mf"), F.col("r").alias("mr"))
    rows = own.join(other, (mirror(F.col("number")) == F.col("m")) & (F.col("m") != F.col("number")))
    return rows.select("number", F.col("m").alias("mirror"), (F.col("frequency") + F.col("mf")).alias("cnt"), F.when(F.col("mr") > 0, F.col("r") + F.col("mr")).otherwise(F.lit(0)).alias("recent_30"))


def top_coincidences(each: DataFrame, n: int = 10) -> DataFrame:
    return _top(coincidences(each), n, F.desc("cnt"), F.asc("met")).select("rank", "number", "cnt")


def top_drags(base: DataFrame, dims: Dims, n: int = 10) -> DataFrame:
    return _top(drags(base, dims), n, F.desc("cnt"), F.asc("met"), F.asc("number")).select("rank", "number", "cnt")


def top_moves(each: DataFrame, n: int = 10) -> DataFrame:
    return _top(moves(each).where("cnt > 0"), n, F.desc("cnt"), F.asc("number")).select("rank", "number", F.col("cnt").alias("lotteries"))


def active_mirrors(each: DataFrame, n: int = 12, days: int = MIRROR_DAYS) -> DataFrame:
    seen = each.groupBy("number").agg(F.max("draw_date").alias("seen"), F.max("last_day").alias("last_day")).where(F.col("seen") >= F.date_sub("last_day", days))
    other = seen.select(F.col("number").alias("mirror"), F.col("seen").alias("mirror_seen"))
    rows = seen.join(other, (mirror(F.col("number")) == F.col("mirror")) & (F.col("number") < F.col("mirror")))
    rows = rows.select(
        "number", "mirror", F.abs(F.datediff("seen", "mirror_seen")).alias("diff_days"), F.datediff("last_day", "seen").alias("days_ago_a"), F.datediff("last_day", "mirror_seen").alias("days_ago_b"),
    )
    return _top(rows, n, F.asc("diff_days"), F.asc("days_ago_a"), F.asc("number"))


#: Weights of the strength score, in the order of addition.
WEIGHTS = (
    ("frequency", 0.08), ("recent", 3.0), ("recent_30", 7.0), ("recent_7", 10.0), ("recent_coincidences", 4.0), ("recent_drags", 3.5),
    ("recent_mirrors", 1.0), ("recent_moves", 4.0), ("coincidences", 0.15), ("drags", 0.15), ("mirrors", 0.03), ("moves", 0.5),
)


def _measures(base: DataFrame, dims: Dims) -> DataFrame:
    """All counts of each number, with the first encounters that order ties, by one
    aggregate over three kinds of rows: days of a number, its repeats from the row
    before, and the newest rows."""
    last = last_day(base, dims)
    lately = F.col("draw_date") >= F.date_sub(last, 29)
    # Lotteries as bits: those of a day and of all days come from the same partial aggregates.
    places = {lottery: k for k, lottery in enumerate(dims.lotteries)}
    words = range(0, max(len(places), 1), 62)
    bits = [reduce(lambda c, x: c.when(F.col("lottery") == x[0], F.lit(1 << (x[1] - w))), [p for p in places.items() if w <= p[1] < w + 62], F.when(F.lit(False), F.lit(0))) for w in words]
    seen = [f"seen_{w}" for w in words]
    number = lambda names: reduce(lambda a, b: a + b, [F.bit_count(n) for n in names])

    each = base.select("draw_date", "lottery", "draw", F.posexplode(F.slice("numbers", 1, 3)).alias("pos", "number"))
    met = F.struct("draw_date", "lottery", "draw", (F.col("pos") + 1).alias("pos"))
    days = each.groupBy("draw_date", "number").agg(F.count("*").alias("frequency"), F.min(met).alias("met"), *[F.bit_or(F.coalesce(b, F.lit(0)).cast("long")).alias(c) for b, c in zip(bits, seen, strict=True)])
    n = number(seen).cast("long")
    several = n > 1
    when = lambda condition, value: F.when(condition, value).otherwise(F.lit(0).cast("long"))
    parts = [
        days.select(
            "number", "frequency", when(lately, F.col("frequency")).alias("recent_30"), when(F.col("draw_date") >= F.date_sub(last, 6), F.col("frequency")).alias("recent_7"),
            when(several, n).alias("coincidences"), when(several & lately, n).alias("recent_coincidences"), *seen, *[F.when(lately, F.col(c)).alias(f"recent_{c}") for c in seen],
            F.when(lately, F.col("met")).alias("recent_met"), F.when(several, F.col("met")).alias("coincidences_met"), F.col("draw_date").alias("last_seen"),
        ),
        _carried(base).select("number", F.lit(1).cast("long").alias("drags"), when(lately, F.lit(1)).alias("recent_drags"), F.struct("draw_date", "lottery", "draw", F.lit(0).alias("pos")).alias("drags_met")),
        latest_counts(base, dims).select("number", F.col("cnt").alias("recent")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = ["frequency", "recent_30", "recent_7", "coincidences", "recent_coincidences", "drags", "recent_drags", "recent"]
    rows = rows.groupBy("number").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.bit_or(c).alias(c) for c in [*seen, *(f"recent_{c}" for c in seen)]],
        *[F.min(c).alias(c) for c in ("recent_met", "coincidences_met", "drags_met")], F.max("last_seen").alias("last_seen"),
    )
    moved = lambda names: F.coalesce(when(number(names) > 1, number(names).cast("long")), F.lit(0))
    rows = rows.withColumns({"moves": moved(seen), "recent_moves": moved([f"recent_{c}" for c in seen])}).drop(*seen, *(f"recent_{c}" for c in seen))
    # A number and its mirror; each row knows the other one's counts.
    own = F.col("number") != mirror(F.col("number"))
    pair = Window.partitionBy(F.when(own, F.least("number", mirror(F.col("number")))).otherwise(F.col("number")))
    both, other = F.count("*").over(pair) == 2, F.sum("recent_30").over(pair) - F.col("recent_30")
    return rows.withColumn("mirrors", when(both, F.sum("frequency").over(pair))).withColumn("recent_mirrors", when(both & (other > 0), F.sum("recent_30").over(pair))).withColumn("last_day", last)


def _ranked(measures: DataFrame) -> DataFrame:
    rows = measures.where((F.col("number") >= 0) & (F.col("number") < UNIVERSE))
    total = reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for c, w in WEIGHTS])
    rows = rows.withColumn("score", F.round(total, 2)).withColumn("mirror", mirror(F.col("number")))
    order = Window.orderBy(F.desc("score"), F.desc("recent_7"), F.desc("recent_30"), F.desc("frequency"), F.asc("number"))
    return rows.withColumn("rank", F.row_number().over(order))  # a hundred rows at most


def strength(base: DataFrame, dims: Dims) -> DataFrame:
    """All numbers seen, with every count and the score, ranked."""
    return _ranked(_measures(base, dims)).select("number", "mirror", "rank", "score", *[c for c, _ in WEIGHTS])


def leader(ranked: DataFrame) -> DataFrame:
    """The first, if there is any."""
    return ranked.where("rank = 1")


def elite(ranked: DataFrame, n: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= n)


def four_conditions(base: DataFrame, dims: Dims, fix_delay: bool = False) -> DataFrame:
    """The best ten under four conditions: among the ten of the last 30 days, a
    useful delay (3 to 45 days), over 50 coincidences and over 100 drags, both
    only of the ten best. As published, the delay isn't known there and its
    condition never holds; fix_delay=True measures it. All that meet the four
    (five at most), or else the three that meet most."""
    rows = _ranked(_measures(base, dims))
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  a hundred rows
    rows = rows.select(
        "number", "rank", F.datediff("last_day", "last_seen").between(3, 45).alias("delayed"),
        ((F.col("recent_30") > 0) & (place(F.desc("recent_30"), F.asc_nulls_last("recent_met")) <= 10)).alias("recent"),
        ((F.col("coincidences") > 50) & (place(F.desc("coincidences"), F.asc_nulls_last("coincidences_met")) <= 10)).alias("coincides"),
        ((F.col("drags") > 100) & (place(F.desc("drags"), F.asc_nulls_last("drags_met"), F.asc("number")) <= 10)).alias("drags"),
    ).where(F.col("rank") <= 10)
    if not fix_delay:
        rows = rows.withColumn("delayed", F.lit(False))
    conditions = ["recent", "delayed", "coincides", "drags"]
    rows = rows.withColumn("met", reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in conditions]))
    place = F.row_number().over(Window.orderBy(F.desc("met"), F.asc("rank")))  # ten rows
    full = F.count_if(F.col("met") == 4).over(Window.partitionBy())
    rows = rows.withColumn("place", place).withColumn("full", full)
    return rows.where((F.col("place") <= F.when(F.col("full") > 0, F.least("full", F.lit(5))).otherwise(3))).drop("full")
