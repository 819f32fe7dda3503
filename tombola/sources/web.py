"""Fetching, for whoever lands pages with Spark: a page for each day or month,
and a REST feed read in ranges. Addresses are parameters."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 20  # seconds
PAGE_ROWS = 1000
FEED = "loteria string, juego string, turno string, fecha string, numeros array<string>"


def fetch(url: str, headers: dict[str, str] | None = None, form: bytes | None = None) -> str:
    """The answer's text; statuses of 400 and above raise."""
    request = urllib.request.Request(url, data=form, headers=headers or {})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def pages(keys: DataFrame, key: str, template: str, tasks: int = 8, form: str | None = None) -> DataFrame:
    """key, url, html, error: a page for each key, which stands for {} in the
    template (and in the form, if it is a POST). A page that fails has no html
    but an error, and stops nothing."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch[key]:
                url = template.format(k)
                try:
                    rows.append((k, url, fetch(url, form=form.format(k).encode() if form else None), None))
                except OSError as e:
                    rows.append((k, url, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "url", "html", "error"])

    texts = keys.select(F.col(key).cast("string").alias(key)).repartition(tasks)
    return texts.mapInPandas(get, f"`{key}` string, url string, html string, error string")


def land(keys: DataFrame, key: str, template: str, folder: str, *, tries: int = 2, tasks: int = 8, form: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages for all keys, written below `folder` and read from there, and the keys that failed
    every time with their last error. Each try fetches only what failed
    before, so nothing is fetched twice, however often what is landed is read."""
    spark, left, landed = keys.sparkSession, keys, []
    for k in range(tries):
        at = f"{folder}/try={k}"
        pages(left, key, template, tasks, form).write.mode("overwrite").parquet(at)
        landed.append(spark.read.parquet(at))
        left = landed[-1].where(F.col("error").isNotNull()).select(key)
        if left.isEmpty():
            break
    got = reduce(DataFrame.unionByName, landed).where(F.col("html").isNotNull()).select(key, "url", "html")
    return got, landed[-1].where(F.col("error").isNotNull()).select(key, "url", "error")


def days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All days from start to end."""
    each = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(each).alias("day"))


class _Stripe(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        asked = "&".join(p for p in (f"order={options['order']}" if "order" in options else "", options.get("filter", "")) if p)
        self.url, self.stripes, self.rows = options["url"] + (f"?{asked}" if asked else ""), int(options.get("stripes", "4")), int(options.get("pageRows", str(PAGE_ROWS)))
        self.headers = json.loads(options.get("headers", "{}"))

    def partitions(self) -> list[_Stripe]:
        return [_Stripe(k) for k in range(self.stripes)]

    def read(self, stripe: _Stripe) -> Iterator[tuple]:
        """Every stripes-th page from its own on, until one is short or, as some
        servers say it, out of range (416)."""
        page = stripe.number
        while True:
            first = page * self.rows
            try:
                rows = json.loads(fetch(self.url, {**self.headers, "Range-Unit": "items", "Range": f"{first}-{first + self.rows - 1}"}))
            except urllib.error.HTTPError as e:
                if e.code != 416:
                    raise
                return
            for r in rows:
                numbers = r.get("numeros")
                yield (*(None if r.get(c) is None else str(r[c]) for c in ("loteria", "juego", "turno", "fecha")), None if numbers is None else [str(n) for n in numbers])
            if len(rows) < self.rows:
                return
            page += self.stripes


class PagedFeed(DataSource):
    """spark.read.format("paged_feed"): a JSON feed that answers ranges of rows;
    options url, headers (JSON), pageRows and stripes (parallel readers); order
    and filter go to the server as they are (order=..., column=neq.value). Ranges
    read in parallel need an order, or rows may come twice or not at all."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> _FeedReader:  # noqa: ANN001
        return _FeedReader(self.options)


def read_feed(spark: SparkSession, url: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").options(url=url, **options).load()
