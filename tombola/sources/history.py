"""History files and tables of draw records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pad2
from .schema import DRAWS
from .sinks import write_document

_FILE = "lottery string, draw string, draw_date date, numbers array<int>, source string"


def available(spark: SparkSession, path: str | None) -> bool:
    """Whether a path is given and something is there."""
    if not path:
        return False
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a spreadsheet, landed as CSV without a header: c0 to c5."""
    return spark.read.csv(path, schema=", ".join(f"c{k} string" for k in range(6)), multiLine=True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, or an empty history if there is no such file.
    Lottery, date and numbers are required; draw and source have defaults."""
    if not available(spark, path):
        return spark.createDataFrame([], DRAWS)
    rows = spark.read.schema(_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a record has no {c}"))).otherwise(F.col(c)).alias(c)
    return rows.select(
        need("lottery"), F.coalesce(F.nullif("draw", F.lit("")), F.lit("General")).alias("draw"), need("draw_date"), need("numbers"),
        F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), F.monotonically_increasing_id().alias("seq"),
    )


def newest_first(draws: DataFrame) -> DataFrame:
    return draws.orderBy(F.desc("draw_date"), F.desc("lottery"), F.desc("draw"))


def oldest_first(draws: DataFrame) -> DataFrame:
    return draws.orderBy("draw_date", "lottery", "draw")


def rows(draws: DataFrame) -> DataFrame:
    """Records as they are published: ISO dates."""
    return draws.select("lottery", "draw", F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), "numbers", "source")


def export_json(draws: DataFrame, path: str) -> None:
    """One JSON array, newest first, put in place of the old one as a whole."""
    write_document(rows(newest_first(draws)).select(F.to_json(F.struct("*")).alias("value")), path)


#: How rows lie in a table, within years: what the columns of an index would be.
LAYOUT = ["year", "lottery", "draw", "draw_date"]
#: Row groups are small enough that one holds few lotteries. (Bytes.)
ROW_GROUP = 16 << 20


def clustered(draws: DataFrame) -> DataFrame:
    """With year, in ranges of LAYOUT, so that files and row groups hold few
    lotteries and draws. A frequent lottery's rows are split by draw and date."""
    return draws.withColumn("year", F.year("draw_date")).repartitionByRange(*LAYOUT).sortWithinPartitions(*LAYOUT)


def save(laid: DataFrame, path: str, mode: str) -> None:
    """Writes what `clustered` has laid out: by year, so that dates prune folders, with
    statistics of sorted row groups for ranges, and Bloom filters where a lottery
    or draw is between others."""
    out = laid.write.mode(mode).partitionBy("year").option("parquet.block.size", str(ROW_GROUP))
    for column in ("lottery", "draw"):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "1000")
    out.parquet(path)


def write_table(draws: DataFrame, path: str, mode: str = "append") -> None:
    """The canonical store. mode="overwrite" with an empty frame truncates it."""
    save(clustered(draws), path, mode)


def read_table(spark: SparkSession, path: str, *, lottery: str | None = None, draw: str | None = None, start: str | None = None, end: str | None = None, ordered: bool = True) -> DataFrame:
    """Rows of a lottery, a draw and days from start to end, where given: years
    that aren't asked for aren't listed, row groups without the lottery or draw not read.
    Ordered by date, newest first, then lottery and draw."""
    found = spark.read.parquet(path)
    for column, value in (("lottery", lottery), ("draw", draw)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if start is not None:
        found = found.where((F.col("year") >= int(start[:4])) & (F.col("draw_date") >= F.lit(start).cast("date")))
    if end is not None:
        found = found.where((F.col("year") <= int(end[:4])) & (F.col("draw_date") <= F.lit(end).cast("date")))
    found = found.drop("year")
    return found.orderBy(F.desc("draw_date"), "lottery", "draw") if ordered else found


def insert(draws: DataFrame, path: str) -> DataFrame:
    """The rows of `draws` to append: one for each full key that the stored table
    lacks. Only the years that `draws` has are read."""
    spark = draws.sparkSession
    if not available(spark, path):
        years, there = [], spark.createDataFrame([], DRAWS)
    else:
        years = [r[0] for r in draws.select(F.year("draw_date")).distinct().collect()]  # a row a year
        there = spark.read.parquet(path).where(F.col("year").isin(years))
    fresh = with_key(draws).groupBy("result_key").agg(F.min_by(F.struct(*draws.columns), "seq").alias("row"))
    return fresh.join(with_key(there).select("result_key"), "result_key", "left_anti").select("row.*")


def with_key(draws: DataFrame) -> DataFrame:
    """Adds result_key: date, lottery, draw and two-digit numbers."""
    numbers = F.array_join(F.transform("numbers", pad2), "-")
    return draws.withColumn("result_key", F.concat_ws("|", F.date_format("draw_date", "yyyy-MM-dd"), "lottery", "draw", numbers))


def from_feed(feed: DataFrame, source: str) -> DataFrame:
    """Rows of a REST feed (loteria, juego, turno, fecha, numeros as strings) as
    draws: numbers made of digits only, two at least; a date is required."""
    numbers = F.transform(F.filter("numeros", lambda n: n.rlike(r"^\d+$")), lambda n: n.cast("int"))
    return (
        feed.select(
            F.coalesce(F.nullif("loteria", F.lit("")), F.lit("Sin nombre")).alias("lottery"),
            F.coalesce(F.nullif("juego", F.lit("")), F.nullif("turno", F.lit("")), F.lit("General")).alias("draw"),
            F.to_date(F.nullif("fecha", F.lit("")), "yyyy-MM-dd").alias("draw_date"),
            numbers.alias("numbers"), F.lit(source).alias("source"), F.monotonically_increasing_id().alias("seq"),
        )
        .where((F.size("numbers") >= 2) & F.col("draw_date").isNotNull())
    )


def quarantine(draws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose numbers all are 0 to 99, and the others."""
    good = F.forall("numbers", lambda n: n.between(0, 99))
    return draws.where(good), draws.where(~good)
