"""The record that stands for each slot, kept by a stream: an extension.

The state is keyed by slot and holds one record, its best so far by source, of equals
the first to arrive. It is a plain streaming aggregate, so it stays in the JVM
and grows with the slots, not with what arrives. Per micro-batch come out the slots
that the batch has added or corrected, and nothing of those it left as they
were; `keep` writes these changes, so a batch costs what it changes and not what
is known already. `standing` reads them back: of each slot the newest change.

A batch that is run again after a failure has the same number and the same time (both
are in the query's checkpoint) and replaces its own folder. State larger than
memory wants the session's spark.sql.streaming.stateStore.providerClass to be
the RocksDB one. Nothing is dropped by age: corrections come at any time.

Records that another date republishes are told by a join over slots
(`reconcile.remove_future_republished`), which is no part of the state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.reconcile import source_rank
from ..sources.schema import DRAWS, SLOT

#: What is kept of a change. kind: new or corrected.
CHANGE = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in DRAWS.fields)}, kind string, batch long"


def changes(arriving: DataFrame, ranks: tuple[tuple[str, int], ...]) -> DataFrame:
    """The records that a micro-batch puts in place, with their kind; output mode
    update. `arriving` is a stream of records."""
    # The time of the micro-batch: the same wherever the plan names it.
    rows = arriving.select(*DRAWS.names).withColumn("_arrived", F.current_timestamp())
    order = F.struct(source_rank(F.col("source"), ranks), F.col("_arrived"), F.col("seq"))
    best = F.min_by(F.struct(*DRAWS.names, "_arrived"), order).alias("best")
    kept = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in SLOT]).agg(best, F.min("_arrived").alias("_first"))
    changed = kept.where(F.col("best._arrived") == F.current_timestamp())
    kind = F.when(F.col("_first") == F.col("best._arrived"), "new").otherwise("corrected")
    return changed.select(*[F.col(f"best.{c}").alias(c) for c in DRAWS.names], kind.alias("kind"))


def keep(arriving: DataFrame, root: str, checkpoint: str, ranks: tuple[tuple[str, int], ...]) -> StreamingQuery:
    """Takes in all that has arrived since the last call, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return changes(arriving, ranks).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, root: str) -> DataFrame:
    """All changes with the number of their batch; none before the first."""
    try:
        return spark.read.schema(CHANGE).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHANGE)


def standing(spark: SparkSession, root: str) -> DataFrame:
    """The record of each slot after all batches."""
    newest = F.max_by(F.struct(*DRAWS.names), "batch").alias("best")
    return kept(spark, root).groupBy(*[F.col(c).alias(f"_{c}") for c in SLOT]).agg(newest).select("best.*")
