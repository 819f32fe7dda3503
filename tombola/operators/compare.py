"""Comparing two lotteries: monthly rollup, calendar filters, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import weekday


def daily_series(draws: DataFrame) -> DataFrame:
    """lottery, ymd, n1, n2, n3; rows without numbers are skipped."""
    n = lambda k: F.get("numbers", F.lit(k)).alias(f"n{k + 1}")
    return draws.where(F.size("numbers") > 0).select("lottery", "draw", F.date_format("draw_date", "yyyyMMdd").alias("ymd"), n(0), n(1), n(2))


def positions(draws: DataFrame) -> DataFrame:
    """Each of the first three numbers of any draw, visible or not, with its
    position."""
    return draws.select("lottery", "draw_date", F.posexplode(F.slice("numbers", 1, 3)).alias("at", "number")).withColumn("pos", F.col("at") + 1).drop("at")


def month_rollup(draws: DataFrame) -> DataFrame:
    """Counts by lottery, month, position and number; position 0 is all three.
    This is the table to keep: comparisons re-aggregate it."""
    each = positions(draws).withColumn("month", F.date_format("draw_date", "yyyy-MM"))
    each = each.select("lottery", "month", "number", F.explode(F.array(F.lit(0), "pos")).alias("pos"))
    return each.groupBy("lottery", "month", "pos", "number").agg(F.count("*").alias("cnt"))


def by_months(rollup: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """lottery, pos, number, cnt of a range of months, both ends in; full dates
    count by their month. One end at least is required."""
    if not start and not end:
        raise ValueError("a range needs a start or an end")
    rows = rollup.where(F.col("month") >= start[:7]) if start else rollup
    rows = rows.where(F.col("month") <= end[:7]) if end else rows
    return rows.groupBy("lottery", "pos", "number").agg(F.sum("cnt").alias("cnt"))


def by_calendar(draws: DataFrame, *, month: int | None = None, day: int | None = None, week_day: int | None = None) -> DataFrame:
    """The same for days that meet all given conditions; 0 is Sunday. One at
    least is required."""
    asked = [(F.month("draw_date"), month), (F.dayofmonth("draw_date"), day), (weekday(F.col("draw_date")), week_day)]
    if all(v is None for _, v in asked):
        raise ValueError("a calendar filter needs a month, a day or a weekday")
    each = positions(draws)
    for column, value in asked:
        each = each if value is None else each.where(column == value)
    each = each.select("lottery", "number", F.explode(F.array(F.lit(0), "pos")).alias("pos"))
    return each.groupBy("lottery", "pos", "number").agg(F.count("*").alias("cnt"))


def current(suggestions: DataFrame) -> DataFrame:
    """The same from suggestions by lottery: their frequency, or else their
    score, or else 1, stands for the count; there are no positions."""
    shown = F.coalesce(F.nullif(F.col("frequency").cast("double"), F.lit(0.0)), F.nullif(F.round("score", 2), F.lit(0.0)), F.lit(1.0))
    return suggestions.select("lottery", F.lit(0).alias("pos"), "number", shown.alias("cnt"))


def matching_draws(stats: DataFrame) -> DataFrame:
    return stats.where("pos = 1").groupBy("lottery").agg(F.sum("cnt").alias("draws"))


def top(stats: DataFrame, n: int) -> DataFrame:
    """The n most frequent numbers of each lottery."""
    order = Window.partitionBy("lottery").orderBy(F.desc("cnt"), F.asc("number"))
    return stats.where("pos = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("lottery", "rank", "number", "cnt")


def delayed(stats: DataFrame, n: int = 3) -> DataFrame:
    """The least frequent numbers seen in each position."""
    order = Window.partitionBy("lottery", "pos").orderBy(F.asc("cnt"), F.asc("number"))
    return stats.where("pos > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("lottery", "pos", "rank", "number", "cnt")


def shared(stats: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    """Numbers among the n most frequent of both."""
    best = top(stats, n)
    left, right = (best.where(F.col("lottery") == x).select("number", F.col("cnt").alias(f"cnt_{k}"), F.col("rank").alias(f"rank_{k}")) for k, x in (("a", a), ("b", b)))
    return left.join(right, "number")


def four_conditions(stats: DataFrame, a: str, b: str, limit: int | None = 6) -> DataFrame:
    """Of the numbers among the 15 most frequent of either: in a's top 10; seen
    in a but not in its top 3; in b's top 20; in both top 10. limit=None keeps
    all candidates among the 20 most frequent that meet all four."""
    pool = 15 if limit is not None else 20
    best = top(stats, 20)
    of = lambda x, k: best.where(F.col("lottery") == x).select("number", F.col("rank").alias(f"rank_{k}"))
    rows = of(a, "a").join(of(b, "b"), "number", "full_outer")
    seen = stats.where((F.col("pos") == 0) & (F.col("lottery") == a) & (F.col("cnt") > 0)).select("number", F.lit(True).alias("seen"))
    rows = rows.join(seen, "number", "left").where((F.col("rank_a") <= pool) | (F.col("rank_b") <= pool))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select(
        "number", yes(F.col("rank_a") <= 10).alias("repeats"), (yes(F.col("seen")) & ~yes(F.col("rank_a") <= 3)).alias("delayed"),
        yes(F.col("rank_b") <= 20).alias("coincides"), yes((F.col("rank_a") <= 10) & (F.col("rank_b") <= 10)).alias("drags"),
    )
    met = sum((F.col(c).cast("int") for c in ("repeats", "delayed", "coincides", "drags")), F.lit(0))
    rows = rows.withColumn("met", met)
    if limit is None:
        return rows.where("met = 4")
    order = [F.desc("met"), F.asc("number")]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
