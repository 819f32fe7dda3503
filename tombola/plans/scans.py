"""Scans of pages, from the keys to the records: enumerate, fetch and land, parse. Each
gives its records and, beside them, the keys that failed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parse
from ..sources import web
from ..sources.schema import DRAWS, Dims

Scan = tuple[DataFrame, DataFrame]


def scan_days(spark: SparkSession, start: str, end: str, template: str, folder: str, dims: Dims, *, source: str = "blocks", **options: int) -> Scan:
    """The block pages of all days from start to end."""
    pages, failed = web.land(web.days(spark, start, end), "day", template, folder, **options)
    rows = parse.from_block_page(pages.withColumn("page_date", F.col("day").cast("date")), dims.slugs, source=source)
    return rows, failed.select(F.col("day").alias("key"), "url", "error")


def scan_day(spark: SparkSession, day: str, template: str, folder: str, dims: Dims, *, session: str | None = None, **options: int) -> Scan:
    """One day's page; of one session only, if it is named."""
    rows, failed = scan_days(spark, day, day, template, folder, dims, **options)
    return rows if session is None else rows.where(F.col("draw") == session), failed


def scan_months(
    spark: SparkSession, index: str, endpoints: tuple[tuple[str, str], ...], folder: str, *, start_year: int = 2010, form: str = "month={}",
    keywords: tuple[tuple[str, str], ...] = (), source: str = "table", **options: int,
) -> Scan:
    """The archives of all months that the page `index` offers from a year on, by a form
    that each endpoint (lottery, address) answers. {} in a template is the month."""
    of = spark.createDataFrame([("index",)], "key string")
    listed, lost = web.land(of, "key", index, f"{folder}/index", **options)
    months = listed.select(F.explode(parse.months_in(F.col("html"), start_year)).alias("month")).distinct()
    all_rows, all_failed = [], [lost.select("key", "url", "error")]
    for k, (lottery, template) in enumerate(endpoints):
        pages, failed = web.land(months, "month", template, f"{folder}/{k}", form=form, **options)
        all_rows.append(parse.from_table_page(pages.withColumn("lottery", F.lit(lottery)), keywords, source=source))
        all_failed.append(failed.select(F.col("month").alias("key"), "url", "error"))
    rows = reduce(DataFrame.unionByName, all_rows) if all_rows else spark.createDataFrame([], DRAWS)
    return rows, reduce(DataFrame.unionByName, all_failed)


def scan_all(spark: SparkSession, scans: dict[str, Callable[[], Scan]]) -> Scan:
    """Several sources at once. One that can't be reached at all (an OSError) leaves the
    others' records and is one of the failures; records keep the sources' order."""
    all_rows, all_failed, lost = [], [], []
    for turn, (name, scan) in enumerate(scans.items()):
        try:
            rows, failed = scan()
        except OSError as e:
            lost.append((name, name, str(e)))
            continue
        all_rows.append(rows.withColumn("seq", F.lit(turn).cast("long") * F.lit(1 << 56) + F.col("seq")).select(*DRAWS.names))
        all_failed.append(failed.select(F.concat_ws("/", F.lit(name), "key").alias("key"), "url", "error"))
    none = spark.createDataFrame(lost, "key string, url string, error string")
    return reduce(DataFrame.unionByName, all_rows, spark.createDataFrame([], DRAWS)), reduce(DataFrame.unionByName, all_failed, none)
