"""Incremental ingestion: an extension, the reports don't need it.

Landed files of draw records are read as a stream; each micro-batch is merged
into the history, whose versions are whole tables beside one another, so that a
batch that is run again after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.reconcile import dedupe, merge_history
from ..sources.schema import DRAWS


def version_path(root: str, batch: int) -> str:
    return f"{root}/version={batch:010d}"


def history(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """The history after a batch; empty before the first."""
    return spark.read.schema(DRAWS).parquet(version_path(root, batch)) if batch >= 0 else spark.createDataFrame([], DRAWS)


def ingest(spark: SparkSession, landed: str, root: str, checkpoint: str, ranks: tuple[tuple[str, int], ...]) -> StreamingQuery:
    """Merges all files landed since the last call, then stops."""

    def merge(batch: DataFrame, number: int) -> None:
        old = history(batch.sparkSession, root, number - 1)
        merge_history(old, dedupe(batch, ranks), ranks).select(*DRAWS.names).write.mode("overwrite").parquet(version_path(root, number))

    stream = spark.readStream.schema(DRAWS).parquet(landed)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
