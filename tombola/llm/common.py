"""What several operators share: reading tables, cutting lineage, sizing joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the word patterns of this package take it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that
    setting is absent a session whose executors are threads of this process (as in
    tests) gets a temporary folder, which goes with the process; any other
    session is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return str(context.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there. Whether files whose
    frames are gone stay is up to spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """df dealt so that rows of equal keys are in one partition, and there in the
    order of `keys` and then `order`, for a function that takes whole partitions.
    The exchange is by a hash of the keys in a column of its own: a repartition by
    keys that a join below has dealt by already is dropped as needless, and the
    join's own shuffle may then be read piecewise, which tears keys apart."""
    dealt = df.withColumn("_dealt", F.xxhash64(*keys)).repartition(shuffle_partitions(df.sparkSession), "_dealt")
    return dealt.sortWithinPartitions(*keys, *(order or [])).drop("_dealt")


def copies(df: DataFrame, into: str = "copy", run: int = 1000) -> DataFrame:
    """df, each row with its number among the rows equal to it, from 0. Equal rows
    are counted before they are shuffled, and a row of which there are many is
    dealt out in runs, so no task meets them all."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count("*").alias("_rows"))
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_rows - 1) div {run}"))))
    runs = runs.repartition(shuffle_partitions(df.sparkSession), *columns, "_run")
    return runs.select(*columns, F.explode(F.sequence(F.col("_run") * run, F.least((F.col("_run") + 1) * run, F.col("_rows")) - 1)).alias(into))


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df in that order with `place`, the number of rows before each, and before_x
    for each x of sums, the sum over them. Two levels: ranges of the order are
    summed first, and there are no more of them than shuffle partitions."""
    ranges = cut(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
    each = ranges.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(x).alias(f"_{x}") for x in sums])
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    each = each.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n"), *[F.coalesce(F.sum(f"_{x}").over(ahead), F.lit(0)).alias(f"_{x}") for x in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranges.join(F.broadcast(each), F.col("_range") == F.col("_of"))
    place = (F.col("_n") + F.count(F.lit(1)).over(inside)).alias("place")
    return joined.select(*df.columns, place, *[(F.col(f"_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"before_{x}") for x in sums])


def lean_batches(spark: SparkSession) -> None:
    """Texts are long: Python workers get at most 1,000 rows or 16 MB at once, so
    that their memory stays small however long texts are (a batch always holds
    one row at least). These are settings of the session, so no operator makes
    them: the registered queries and the pipeline do, as an application would."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if a count shows at most `rows` rows; otherwise
    df as it is, so that the join shuffles and AQE splits what is skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
