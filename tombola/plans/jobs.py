"""The jobs that keep a history up to date, as plans over landed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import parse, reconcile
from ..sources import history, versions
from ..sources.schema import DRAWS, SLOT, Dims
from ..sources.versions import Version


def daily(existing: DataFrame, pages: DataFrame, dims: Dims) -> DataFrame:
    """The history with the results of landed block pages (html, page_date)."""
    new = reconcile.dedupe(parse.from_block_page(pages, dims.slugs), dims.ranks)
    return reconcile.merge_history(existing, new, dims.ranks)


def backfill(existing: DataFrame, blocks: DataFrame, tables: DataFrame, dims: Dims, keywords: tuple[tuple[str, str], ...]) -> DataFrame:
    """The history with a range of block pages and of monthly tables (html,
    lottery); the pages' rows come before the tables'."""
    first = parse.from_block_page(blocks, dims.slugs).withColumn("_turn", F.lit(0))
    both = first.unionByName(parse.from_table_page(tables, keywords).withColumn("_turn", F.lit(1)))
    both = both.withColumn("seq", F.col("_turn") * F.lit(1 << 60) + F.col("seq"))
    return reconcile.merge_history(existing, reconcile.dedupe(both.drop("_turn"), dims.ranks), dims.ranks)


def gap_fill(existing: DataFrame, pages: DataFrame, start: str, end: str, reference: tuple[str, ...], names: tuple[tuple[str, str, str, str], ...], dims: Dims) -> DataFrame:
    """Only the wanted draws, under their canonical names, the last row of each
    slot; with those of landed pages whose day none of the reference lotteries
    covers, where the slot is free."""
    kept = reconcile.last_per_slot(parse.wanted(existing, names))
    gaps = reconcile.date_gaps(kept, start, end, reference).withColumnRenamed("draw_date", "page_date")
    found = parse.wanted(parse.from_block_page(pages.join(gaps, "page_date", "left_semi"), dims.slugs), names)
    found = reconcile.dedupe(found, dims.ranks)
    return kept.unionByName(found.join(kept.select(*SLOT), SLOT, "left_anti"))


def spreadsheet_import(existing: DataFrame, sheet: DataFrame, source: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The merged history and its counters. Unless `path` is None (a dry run) the
    merged history is a new table there, and what is returned is read from it: a
    table that exists already is refused, as it may be the one that `existing`
    reads. The caller names the next version and swaps."""
    counted = reconcile.import_counters(existing, sheet, source)
    merged = reconcile.import_merge(existing, sheet, source)
    if path is not None:
        spark = merged.sparkSession
        counted = spark.createDataFrame(counted.collect(), counted.schema)  # one row
        history.write_table(merged, path, "errorifexists")
        merged = spark.read.parquet(path).select(*merged.columns)
    return merged, counted


def keep_daily(spark: SparkSession, root: str, pages: DataFrame, dims: Dims) -> Version:
    """`daily` as the next version of the history at `root`; its entry has the
    counters of the batch."""
    return versions.update(spark, root, lambda existing: daily(existing, pages, dims))


def keep_backfill(spark: SparkSession, root: str, blocks: DataFrame, tables: DataFrame, dims: Dims, keywords: tuple[tuple[str, str], ...]) -> Version:
    return versions.update(spark, root, lambda existing: backfill(existing, blocks, tables, dims, keywords))


def keep_import(spark: SparkSession, root: str, sheet: DataFrame, source: str) -> tuple[Version, DataFrame]:
    """A sheet merged into the next version, and the counters of that merge."""
    made = versions.update(spark, root, lambda existing: reconcile.import_merge(existing, sheet, source))
    before = versions.read(spark, root, made.number - 1) if made.number else spark.createDataFrame([], DRAWS)
    return made, reconcile.import_counters(before, sheet, source)


def keep_migrated(spark: SparkSession, root: str, json_path: str) -> Version:
    """What a JSON history has and the newest version lacks, added to it."""
    found = history.read_json(spark, json_path)
    return versions.update(spark, root, lambda there: there.unionByName(reconcile.insert_if_absent(there, found).drop("result_key")))


def migrate(spark: SparkSession, json_path: str, table_path: str) -> int:
    """Appends to the table what a JSON history has and the table lacks; the
    number of rows added, counted as they are written."""
    seen = Observation()
    new = history.clustered(history.insert(history.read_json(spark, json_path), table_path)).observe(seen, F.count(F.lit(1)).alias("rows"))
    history.save(new, table_path, "append")
    return seen.get["rows"]
