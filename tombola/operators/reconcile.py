"""Bringing several sources together: one record a slot, corrections, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.history import with_key
from ..sources.schema import LAST_RANK, SLOT


def source_rank(source: Column, ranks: tuple[tuple[str, int], ...]) -> Column:
    out = F.lit(LAST_RANK)
    for prefix, rank in reversed(ranks):
        out = F.when(source.startswith(prefix), F.lit(rank)).otherwise(out)
    return out


def _first_by(draws: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. A row isn't a fixed-width value, so Spark sorts
    by key to aggregate, before the shuffle and after it; what is shuffled is one
    row a key and task. What is sorted holds each column once."""
    best = F.min_by(F.struct(*[c for c in draws.columns if c not in keys]), F.struct(*order)).alias("_best")
    return draws.groupBy(*keys).agg(best).select(*[c if c in keys else F.col("_best")[c].alias(c) for c in draws.columns])


def dedupe(draws: DataFrame, ranks: tuple[tuple[str, int], ...]) -> DataFrame:
    """One record a slot: the best source's, of equals the first."""
    return _first_by(draws, SLOT, source_rank(F.col("source"), ranks), F.col("seq"))


def last_per_slot(draws: DataFrame) -> DataFrame:
    """One record a slot: the last one loaded."""
    return _first_by(draws, SLOT, -F.col("seq"))


def remove_future_republished(existing: DataFrame, authoritative: DataFrame) -> DataFrame:
    """Existing rows but those that repeat an authoritative result (lottery, draw
    and numbers) under a later date than its newest."""
    newest = authoritative.groupBy(F.col("lottery").alias("_l"), F.col("draw").alias("_d"), F.col("numbers").alias("_n")).agg(F.max("draw_date").alias("_date"))
    same = (F.col("lottery") == F.col("_l")) & (F.col("draw") == F.col("_d")) & (F.col("numbers") == F.col("_n"))
    return existing.join(newest, same & (F.col("draw_date") > F.col("_date")), "left_anti")


def merge_history(existing: DataFrame, new: DataFrame, ranks: tuple[tuple[str, int], ...]) -> DataFrame:
    """Existing rows without future copies of new ones, and the new rows: the
    best source for each slot, of equals the existing and then the first row."""
    both = remove_future_republished(existing, new).withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    return _first_by(both, SLOT, source_rank(F.col("source"), ranks), F.col("batch"), F.col("seq")).drop("batch")


def with_fallback(primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """The primary source's rows, and the fallback's for keys it has none of."""
    return primary.unionByName(fallback.join(primary.select(*by).distinct(), by, "left_anti"))


def added(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what a batch has added to a history, and the total."""
    total = after.agg(F.count("*").alias("total"))
    return total.withColumn("new", F.col("total") - before.agg(F.count("*")).scalar()).select("new", "total")


def insert_if_absent(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows to append: one for each full key the table lacks."""
    fresh = _first_by(with_key(new), ["result_key"], F.col("seq"))
    return fresh.join(with_key(existing).select("result_key"), "result_key", "left_anti").select(*new.columns, "result_key")


def import_merge(existing: DataFrame, sheet: DataFrame, sheet_source: str) -> DataFrame:
    """Rows of a spreadsheet where the slot is free or holds a spreadsheet row;
    elsewhere the existing row stays. Of several rows a slot the last counts."""
    foreign = (F.col("source") != sheet_source) & (F.col("batch") == 0)
    both = last_per_slot(existing).withColumn("batch", F.lit(0)).unionByName(last_per_slot(sheet).withColumn("batch", F.lit(1)))
    return _first_by(both, SLOT, F.when(foreign, 0).otherwise(1), -F.col("batch"), F.col("seq")).drop("batch")


def import_counters(existing: DataFrame, sheet: DataFrame, sheet_source: str) -> DataFrame:
    """One row: added and conflicting rows of the sheet, and the merged range. A
    slot's first sheet row adds it; none that follow conflict with it."""
    have = last_per_slot(existing).select(*SLOT, F.col("source").alias("had"))
    hit = sheet.join(have, SLOT, "left")
    slot = F.struct(*SLOT)
    counts = hit.agg(
        F.count_distinct(F.when(F.col("had").isNull(), slot)).alias("added"),
        F.count_if(F.col("had") != sheet_source).alias("conflicts"),
    )
    merged = import_merge(existing, sheet, sheet_source).agg(F.count("*").alias("total"), F.min("draw_date").alias("from_date"), F.max("draw_date").alias("to_date"))
    return counts.join(merged)


def import_rows_by_draw(merged: DataFrame, sheet_source: str) -> DataFrame:
    return merged.where(F.col("source") == sheet_source).groupBy("lottery", "draw").agg(F.count("*").alias("rows"))


def date_gaps(draws: DataFrame, start: str, end: str, lotteries: tuple[str, ...]) -> DataFrame:
    """Days from start to end on which none of the lotteries has a row."""
    covered = draws.where(F.col("lottery").isin(*lotteries)).select("draw_date").distinct()
    days = draws.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("draw_date"))
    return days.join(covered, "draw_date", "left_anti")
