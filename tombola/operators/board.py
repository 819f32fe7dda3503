"""Today's board and the list of recent draws with their suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import pad2
from ..sources.schema import Dims
from .base import canonical_label, display_label, visible
from .frequency import newest

LAST_ROWS = 8


def last_results(draws: DataFrame, by: list[str], n: int = LAST_ROWS) -> DataFrame:
    return newest(draws, by, n)


def today(draws: DataFrame, suggestions: DataFrame, dims: Dims) -> DataFrame:
    """For each label its newest result among its lottery's last rows, whether
    each number was in the result before, and the five best suggestions of the
    first (lottery, draw) that the label names."""
    rows = display_label(visible(last_results(draws, ["lottery"]), dims), dims)
    order = Window.partitionBy("label").orderBy(F.desc("draw_date"), F.asc("lottery"), F.asc("place"))
    rows = rows.withColumn("turn", F.row_number().over(order)).withColumn("before", F.lead("numbers").over(order)).where("turn = 1")
    n = lambda k: F.get("numbers", F.lit(k))
    again = lambda k: F.coalesce(F.array_contains(F.slice("before", 1, 3), n(k)), F.lit(False)).alias(f"repeats_{k + 1}")
    first: dict[str, tuple[str, str]] = {}
    for lottery, draw, label in dims.labels:
        first.setdefault(label, (lottery, draw))
    named = draws.sparkSession.createDataFrame([(label, *pair) for label, pair in first.items()], "label string, lottery string, draw string")
    best = suggestions.where(F.col("rank") <= 5).join(named, ["lottery", "draw"])
    listed = F.array_sort(F.collect_list(F.struct("rank", "number")))  # five entries
    best = best.groupBy("label").agg(F.array_join(F.transform(listed, lambda r: pad2(r["number"])), " ").alias("suggested"))
    return rows.select("label", "draw_date", n(0).alias("n1"), n(1).alias("n2"), n(2).alias("n3"), again(0), again(1), again(2)).join(best, "label", "left")


def draw_items(draws: DataFrame, dims: Dims, each: int = 3, most: int = 21) -> DataFrame:
    """Up to three of each lottery's last rows, newest first: none of a draw that
    has been picked, and none that repeats a picked row's date and numbers. The
    picking is a fold over at most eight rows a lottery."""
    rows = canonical_label(visible(last_results(draws, ["lottery"]), dims), dims)
    numbers = F.array_join(F.transform(F.slice("numbers", 1, 3), pad2), "-")
    item = F.struct("place", F.lower(F.trim("canonical")).alias("key"), F.concat_ws("|", F.col("draw_date").cast("string"), numbers).alias("same"), "draw", "draw_date", numbers.alias("shown"))
    lists = rows.groupBy("lottery").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("sames"), F.slice("items", 1, 0).alias("picked"))

    def step(acc, x):
        skip = F.array_contains(acc["keys"], x["key"]) | F.array_contains(acc["sames"], x["same"]) | (F.size(acc["picked"]) >= each)
        taken = F.struct(F.array_append(acc["keys"], x["key"]).alias("keys"), F.array_append(acc["sames"], x["same"]).alias("sames"), F.array_append(acc["picked"], x).alias("picked"))
        return F.when(skip, acc).otherwise(taken)

    picked = lists.select("lottery", F.explode(F.aggregate("items", start, step, lambda acc: acc["picked"])).alias("x"))
    order = [F.desc("draw_date"), F.asc("lottery"), F.asc("place")]
    return picked.select("lottery", "x.draw", "x.draw_date", F.col("x.shown").alias("numbers"), "x.place").orderBy(*order).limit(most)
