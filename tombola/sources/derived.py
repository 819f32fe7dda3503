"""Draw records derived from the test tables, which hold none: each order is
a result, its priority the lottery and its status the draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Dims

SOURCES = ("feed://first/day", "feed://second", "feed://third", "feed://fourth", "sheet")
SHEET = "sheet"

DIMS = Dims(
    start="1997-01-01",
    ranks=(("feed://first", 0), ("feed://second", 1), ("feed://third", 2), ("feed://fourth", 3)),
    lotteries=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"),
    visible=(("1-URGENT", "F"), ("2-HIGH", "F"), ("3-MEDIUM", "F"), ("4-NOT SPECIFIED", "F"), ("5-LOW", "F"), ("1-URGENT", "O"), ("2-HIGH", "O"), ("3-MEDIUM", "O")),
    aliases=(("p", "O"),),
    labels=(("1-URGENT", "F", "Urgent early"), ("1-URGENT", "O", "Urgent late"), ("2-HIGH", "F", "High early"), ("2-HIGH", "O", "High late"), ("3-MEDIUM", "F", "Medium"), ("3-MEDIUM", "O", "Medium"), ("4-NOT SPECIFIED", "F", "Other")),
    delay_labels=(("1-URGENT", "F", "Urgent early"), ("1-URGENT", "O", "Urgent late"), ("2-HIGH", "F", "High"), ("2-HIGH", "O", "High"), ("3-MEDIUM", "F", "Medium")),
    slugs=(("example.org", "Org"), ("en", "English"), ("fr", "French"), ("page", "Page")),
)


def raw_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders; about one in six repeats a slot."""
    return _as_draws(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def arriving_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as a stream of the table's files. A table may be one file, which
    a stream takes by a pattern only."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    return _as_draws(spark.readStream.schema(schema).parquet(f"{sf_dir}/{{orders.parquet}}"))


def _as_draws(orders: DataFrame) -> DataFrame:
    mod = lambda c: (c % 100).cast("int")
    numbers = F.array(mod(F.col("o_orderkey") * 37), mod(F.col("o_custkey")), mod(F.floor("o_totalprice")))
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return orders.select(
        F.col("o_orderpriority").alias("lottery"), F.col("o_orderstatus").alias("draw"), F.col("o_orderdate").cast("date").alias("draw_date"),
        numbers.alias("numbers"), source.alias("source"), F.col("o_orderkey").alias("seq"),
    )
