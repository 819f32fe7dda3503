"""Counts, recency and the suggestion score, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers run from 0 to UNIVERSE - 1.
UNIVERSE = 100
RECENT_ROWS = 30
#: The delay that counts most, and that of numbers never seen or seen on the day.
MOST_DELAY = 365
_NEWEST = ["draw_date", "lottery", "draw"]


def coverage(draws: DataFrame) -> DataFrame:
    return draws.agg(F.min("draw_date").alias("from_date"), F.max("draw_date").alias("to_date"))


def group_totals(draws: DataFrame, by: list[str]) -> DataFrame:
    return draws.groupBy(*by).agg(F.count("*").alias("total"))


def groups_in_order(draws: DataFrame, by: list[str]) -> DataFrame:
    """The groups and their places in code-point order, as reports list them: one
    row a group, ordered in one task."""
    return draws.select(*by).distinct().withColumn("place", F.row_number().over(Window.orderBy(*by)))


def newest(draws: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n newest rows of each group, with their place. Each task passes on no
    more than n rows a group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*map(F.desc, _NEWEST))).alias("place")
    return draws.select("*", place).where(F.col("place") <= n)


def number_counts(draws: DataFrame, by: list[str], into: str = "frequency") -> DataFrame:
    """Over all numbers of a row, not just the first three; with the last date."""
    each = draws.select(*by, "draw_date", F.explode("numbers").alias("number"))
    return each.groupBy(*by, "number").agg(F.count("*").alias(into), F.max("draw_date").alias("last_seen"))


def recent_counts(draws: DataFrame, by: list[str], rows: int = RECENT_ROWS) -> DataFrame:
    """The same over the newest rows of each group: rows, not days."""
    return number_counts(newest(draws, by, rows), by, "recent_frequency").drop("last_seen")


def score(frequency: Column, recent: Column, delay: Column) -> Column:
    """A delay of 0 weighs as much as the longest. The order of the additions
    matters for equal results."""
    waited = F.when(delay.isNull() | (delay == 0), F.lit(MOST_DELAY)).otherwise(F.least(delay, F.lit(MOST_DELAY)))
    raw = frequency * F.lit(1.0) + recent * F.lit(1.8) + waited / F.lit(float(MOST_DELAY)) * F.lit(3.0)
    return F.when((frequency == 0) & (recent == 0), raw * F.lit(0.25)).otherwise(raw)


def best(scored: DataFrame, by: list[str], limit: int) -> DataFrame:
    order = [F.desc("score"), F.desc("frequency"), F.desc("recent_frequency"), F.asc("number")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank")
    return scored.select("*", rank).where(F.col("rank") <= limit)


def suggest(draws: DataFrame, by: list[str], reference: Column, limit: int = 10) -> DataFrame:
    """The best numbers of each group as of the reference date: one plan for all
    groups. No rows, no suggestions."""
    grid = draws.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(UNIVERSE - 1))).alias("number"))
    rows = grid.join(number_counts(draws, by), [*by, "number"], "left").join(recent_counts(draws, by), [*by, "number"], "left")
    rows = rows.select(
        *by, "number", F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("recent_frequency", F.lit(0)).alias("recent_frequency"),
        F.datediff(reference, F.col("last_seen")).alias("delay_days"),
    )
    rows = rows.withColumn("score", score(F.col("frequency"), F.col("recent_frequency"), F.col("delay_days")))
    return best(rows, by, limit)
