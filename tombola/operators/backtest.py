"""Historical validation: what would have been suggested before each draw?

Every target date needs the counts over all strictly earlier rows of its draw.
Targets lie in the last days of a draw, so all that is older is folded into one
count a number, by partial aggregates (`fold`). Only the rows of those days and the
newest ones before them are put in order: there, running sums over a row's place
answer for all targets at once.

A fold is kept up to date by `add`: new rows join it, and days that leave the
window are folded. The history isn't read again. `write` and `read` store one. A fold
can't forget: where a record is replaced or taken away, it has to be made again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frequency import RECENT_ROWS, UNIVERSE, best, score

BY = ["lottery", "draw"]
WINDOW_DAYS, LEAST_HISTORY = 60, 30
_ROW = [*BY, "draw_date", "seq", "numbers"]


@dataclass(frozen=True)
class Fold:
    """near: the rows of each draw's last `window_days` days (in_window 1) and the newest
    `tail` before them (0). older: old, old_seen of each lottery, draw and number
    over all rows outside the window, those of the tail too."""

    near: DataFrame
    older: DataFrame
    window_days: int
    tail: int


def _inside(rows: DataFrame, window_days: int) -> tuple[DataFrame, Column]:
    """Rows with last_date, and whether they are of their draw's last days."""
    ends = rows.groupBy(*BY).agg(F.max("draw_date").alias("last_date"))
    return rows.join(ends, BY), F.col("draw_date") >= F.date_sub("last_date", window_days)


def _counts(rows: DataFrame) -> DataFrame:
    each = rows.select(*BY, "draw_date", F.explode("numbers").alias("number"))
    return each.groupBy(*BY, "number").agg(F.count("*").alias("old"), F.max("draw_date").alias("old_seen"))


def _near(late: DataFrame, before: DataFrame, tail: int) -> DataFrame:
    back = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("draw_date"), F.desc("seq")))
    newest = before.select(*_ROW, back.alias("back")).where(F.col("back") <= tail)
    return late.select(*_ROW, F.lit(1).alias("in_window")).unionByName(newest.select(*_ROW, F.lit(0).alias("in_window")))


def fold(draws: DataFrame, window_days: int = WINDOW_DAYS, least: int = LEAST_HISTORY) -> Fold:
    """`draws` is read several times."""
    rows, inside = _inside(draws.select(*_ROW), window_days)
    tail = max(RECENT_ROWS, least)
    return Fold(_near(rows.where(inside), rows.where(~inside), tail), _counts(rows.where(~inside)), window_days, tail)


def add(state: Fold, new: DataFrame) -> Fold:
    """The fold of the old rows and the new ones, whatever their dates; rows that
    are there already must not come again."""
    # 2: not folded yet.
    both = state.near.unionByName(new.select(*_ROW, F.lit(2).alias("in_window")))
    rows, inside = _inside(both, state.window_days)
    left = _counts(rows.where(~inside & (F.col("in_window") > 0)))
    older = state.older.unionByName(left).groupBy(*BY, "number").agg(F.sum("old").alias("old"), F.max("old_seen").alias("old_seen"))
    return Fold(_near(rows.where(inside), rows.where(~inside), state.tail), older, state.window_days, state.tail)


def write(state: Fold, path: str) -> None:
    """Two tables in the folder `path`, which replace what is there: a run that
    failed between them is run again from the fold before, in a folder of its own."""
    state.near.write.mode("overwrite").parquet(f"{path}/near")
    state.older.write.mode("overwrite").parquet(f"{path}/older")


def read(spark: SparkSession, path: str, window_days: int = WINDOW_DAYS, least: int = LEAST_HISTORY) -> Fold:
    """With the options it was made with."""
    return Fold(spark.read.parquet(f"{path}/near"), spark.read.parquet(f"{path}/older"), window_days, max(RECENT_ROWS, least))


def _folded(draws: DataFrame | Fold, window_days: int, least: int) -> Fold:
    if not isinstance(draws, Fold):
        return fold(draws, window_days, least)
    if draws.window_days != window_days or draws.tail < least:
        raise ValueError(f"the fold is of {draws.window_days} days and {draws.tail} rows before them")
    return draws


def _placed(state: Fold) -> DataFrame:
    """The near rows with their place (by date) and the number of strictly earlier
    ones. A draw has `least` rows before a date exactly if it has them among the
    near rows, whose tail is no shorter."""
    one = Window.partitionBy(*BY)
    return state.near.select("*", F.row_number().over(one.orderBy("draw_date", "seq")).alias("place"), (F.rank().over(one.orderBy("draw_date")) - 1).alias("before"))


def _targets(rows: DataFrame, least: int) -> DataFrame:
    return rows.where((F.col("in_window") == 1) & (F.col("before") >= least))


def predictions(draws: DataFrame | Fold, limit: int = 10, window_days: int = WINDOW_DAYS, least: int = LEAST_HISTORY) -> DataFrame:
    """lottery, draw, target_date, rank, number, score, frequency,
    recent_frequency for each target date, of a history or its fold."""
    return _predictions(_folded(draws, window_days, least), limit, least)


def _predictions(state: Fold, limit: int, least: int) -> DataFrame:
    # A row says its numbers at its place; the first row of a target date asks for all numbers at the place before it.
    entry = lambda number, at, seen, late, hit, asked: F.struct(
        number.alias("number"), at.alias("at"), seen.cast("date").alias("seen"), late.cast("long").alias("late"), hit.cast("long").alias("hit"), asked.cast("date").alias("target_date")
    )
    none, zero = F.lit(None), F.lit(0)
    said = F.transform("numbers", lambda n: entry(n, F.col("place"), F.col("draw_date"), F.col("in_window"), F.lit(1), none))
    asked = F.transform(F.sequence(zero, F.lit(UNIVERSE - 1)), lambda n: entry(n, F.col("before"), none, zero, zero, F.col("draw_date")))
    is_asked = (F.col("in_window") == 1) & (F.col("before") >= least) & (F.col("place") == F.col("before") + 1)
    rows = _placed(state).select(*BY, F.explode(F.when(is_asked, F.concat(said, asked)).otherwise(said)).alias("entry"))
    # What is folded lies before every place that recent rows reach back to.
    older = state.older.select(*BY, entry(F.col("number"), F.lit(-RECENT_ROWS), F.col("old_seen"), F.col("old"), zero, none).alias("entry"))
    rows = rows.unionByName(older).select(*BY, "entry.*")
    order = Window.partitionBy(*BY, "number").orderBy("at")
    so_far, lately = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(1 - RECENT_ROWS, 0)
    rows = rows.select(
        *BY, "number", "target_date", F.sum("late").over(so_far).alias("frequency"), F.sum("hit").over(lately).alias("recent_frequency"), F.max("seen").over(so_far).alias("last_seen"),
    ).where(F.col("target_date").isNotNull())
    rows = rows.withColumn("score", score(F.col("frequency"), F.col("recent_frequency"), F.datediff("target_date", "last_seen")))
    return best(rows, [*BY, "target_date"], limit).select(*BY, "number", "target_date", "frequency", "recent_frequency", "score", "rank")


def hits(draws: DataFrame | Fold, limit: int = 10, window_days: int = WINDOW_DAYS, least: int = LEAST_HISTORY) -> DataFrame:
    """One row a target: whether its first three numbers met the best three and
    five suggestions, how many of five, and whether its first number was there."""
    return _hits(_folded(draws, window_days, least), limit, least)


def _hits(state: Fold, limit: int, least: int) -> DataFrame:
    top = _predictions(state, min(limit, 5), least)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "number")))  # five entries at most
    top = top.groupBy(*BY, F.col("target_date").alias("draw_date")).agg(F.transform(ranked, lambda r: r["number"]).alias("predicted"))
    rows = _targets(_placed(state), least).join(top, [*BY, "draw_date"])
    actual = F.array_distinct(F.slice("numbers", 1, 3))
    hit5 = F.array_sort(F.array_intersect(actual, "predicted"))
    return rows.select(
        *BY, "draw_date", "seq", F.slice("numbers", 1, 3).alias("actual"), "predicted", hit5.alias("hits"),
        (F.size(F.array_intersect(actual, F.slice("predicted", 1, 3))) > 0).alias("top3_any"), (F.size(hit5) > 0).alias("top5_any"),
        F.coalesce(F.array_contains("predicted", F.get("numbers", F.lit(0))), F.lit(False)).alias("first_position"), F.size(hit5).cast("long").alias("hits_top5"),
    )


def report(draws: DataFrame | Fold, limit: int = 10, window_days: int = WINDOW_DAYS, least: int = LEAST_HISTORY) -> DataFrame:
    """One row a draw. Draws with too few rows, or without a target that has
    enough history, are insufficient; numerators come beside the rounded rates."""
    state = _folded(draws, window_days, least)
    by = _hits(state, limit, least).groupBy(*BY).agg(
        F.count("*").alias("tested"), F.count_if("top3_any").alias("top3_hits"), F.count_if("top5_any").alias("top5_hits"),
        F.count_if("first_position").alias("first_hits"), F.sum("hits_top5").alias("total_hits"),
    )
    # Up to `least` rows, a draw's rows are all near ones.
    rows = state.near.groupBy(*BY).agg(F.count("*").alias("rows")).join(by, BY, "left").withColumn("tested", F.coalesce("tested", F.lit(0)))
    rate = F.col("top5_hits") / F.col("tested")
    # The labels and their bounds.
    label = F.when(F.col("tested") < 20, "Muestra baja").when(rate >= 0.35, "Alta").when(rate >= 0.18, "Media").otherwise("Baja")
    ok = F.col("tested") > 0
    why = F.when(ok, None).when(F.col("rows") <= least, F.lit(f"needs {least + 1} rows")).otherwise(F.lit("no recent row has enough history"))
    share = lambda c, n: F.when(ok, F.round(F.col(c) / F.col("tested"), n))
    return rows.select(
        *BY, F.when(ok, "ok").otherwise("insufficient").alias("status"), why.alias("message"), F.lit(window_days).alias("window_days"), F.col("tested").alias("tested_draws"),
        "top3_hits", "top5_hits", "first_hits", "total_hits",
        share("top3_hits", 3).alias("top3_any_hit_rate"), share("top5_hits", 3).alias("top5_any_hit_rate"), share("first_hits", 3).alias("first_position_hit_rate"),
        share("total_hits", 2).alias("average_hits_top5"), F.when(ok, label).alias("confidence_label"),
    )


def recent_evaluations(draws: DataFrame | Fold, n: int = 5, **options: int) -> DataFrame:
    """The last n targets of each draw, `place` from the oldest."""
    rows = hits(draws, **options)
    back = F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("draw_date"), F.desc("seq")))
    rows = rows.withColumn("back", back).where(F.col("back") <= n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc("back")))).drop("back")
