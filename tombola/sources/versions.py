"""A history as whole versions, of which one is the newest.

A version is a table in a folder of its own, written first; then an entry in the log
names it and makes it the newest, by a rename that fails where the entry is there
already. So readers see whole versions only, and of two writers that began from
the same version one wins and the other is told. An entry holds the
version's counters too, counted in the pass that wrote it. Old versions stay until
`forget`. The rename decides atomically on HDFS and the like; a store that only copies
needs another way to commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .history import clustered, read_table, save
from .schema import DRAWS


class Conflict(RuntimeError):
    """Another writer has made that version."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    rows: int
    new: int
    first_day: str | None
    last_day: str | None


def _files(spark: SparkSession, root: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = lambda p: hadoop.Path(f"{root}/{p}")
    return path("log").getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    files, path = _files(spark, root)
    if not files.exists(path("log")):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path("log"))]
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """That version, or the newest; None before the first."""
    known = versions(spark, root)
    if not known:
        return None
    number = known[-1] if number is None else number
    text = spark.read.text(f"{root}/log/{number:020d}", wholetext=True).head()[0]
    return Version(**json.loads(text))


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The records of a version; none before the first."""
    found = version(spark, root, number)
    return spark.createDataFrame([], DRAWS) if found is None else read_table(spark, f"{root}/{found.folder}", ordered=False).select(*DRAWS.names)


def commit(draws: DataFrame, root: str, base: Version | None) -> Version:
    """Writes `draws` as the version after `base`. Rows and days are counted by the write itself;
    `new` is what there is more of than in `base`."""
    spark = draws.sparkSession
    files, path = _files(spark, root)
    seen = Observation()
    folder = f"data/{uuid.uuid4().hex}"
    counted = clustered(draws.select(*DRAWS.names)).observe(seen, F.count(F.lit(1)).alias("rows"), F.min("draw_date").cast("string").alias("first_day"), F.max("draw_date").cast("string").alias("last_day"))
    save(counted, f"{root}/{folder}", "errorifexists")
    rows = seen.get["rows"]
    made = Version(base.number + 1 if base else 0, folder, rows, rows - (base.rows if base else 0), seen.get["first_day"], seen.get["last_day"])
    entry, draft = path(f"log/{made.number:020d}"), path(f"log/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(made)).encode()))
    out.close()
    if files.exists(entry) or not files.rename(draft, entry):
        files.delete(draft, False)
        files.delete(path(folder), True)
        raise Conflict(f"version {made.number} of {root} is another writer's")
    return made


def update(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], tries: int = 3) -> Version:
    """The newest version changed; where another writer was faster, the change
    is made again to what that one wrote."""
    for k in range(tries):
        base = version(spark, root)
        try:
            return commit(change(read(spark, root, None if base is None else base.number)), root, base)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries is 1 or more")


def forget(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest `keep` versions, entries first."""
    files, path = _files(spark, root)
    for number in versions(spark, root)[:-keep]:
        old = version(spark, root, number)
        files.delete(path(f"log/{number:020d}"), False)
        files.delete(path(old.folder), True)
