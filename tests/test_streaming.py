"""Streams against the batch operators that they stand for."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tombola.operators import reconcile
from tombola.sources.schema import DRAWS
from tombola.streaming import standing

RANKS = (("a", 0), ("b", 1), ("c", 2))


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select(*DRAWS.names).collect())


def land(spark, landed, rows):
    spark.createDataFrame(rows, DRAWS).coalesce(1).write.mode("append").parquet(landed)


def stream(spark, landed):
    return spark.readStream.schema(DRAWS).parquet(landed)


def test_standing_records_equal_the_batch_merge_after_restarts(spark, tmp_path):
    """Five landings, each by a query that starts anew: repeats within a landing,
    corrections by better sources, records that change nothing."""
    landed, root, check = (str(tmp_path / x) for x in ("landed", "root", "check"))
    dice, rows = random.Random(7), []
    for turn in range(5):
        new = [(f"L{dice.randrange(3)}", "E", day(dice.randrange(12)), [dice.randrange(100), turn], dice.choice("abcd"), 100 * turn + k) for k in range(25)]
        land(spark, landed, new)
        rows += new
        standing.keep(stream(spark, landed), root, check, RANKS).awaitTermination()
        assert rows_of(standing.standing(spark, root)) == rows_of(reconcile.dedupe(spark.createDataFrame(rows, DRAWS), RANKS))
    log = standing.kept(spark, root)
    assert log.where("kind = 'new'").groupBy("lottery", "draw", "draw_date").count().where("count > 1").isEmpty()
    assert log.where("kind = 'new'").count() == standing.standing(spark, root).count()
    assert not log.where("kind = 'corrected'").isEmpty()


def test_only_changes_come_out(spark, tmp_path):
    landed, root, check = (str(tmp_path / x) for x in ("landed", "root", "check"))
    assert standing.standing(spark, root).isEmpty()
    land(spark, landed, [("L1", "E", day(0), [1], "b", 0), ("L1", "E", day(1), [2], "a", 1)])
    standing.keep(stream(spark, landed), root, check, RANKS).awaitTermination()
    # A better source for one slot, an equal one for the other, and a new slot.
    land(spark, landed, [("L1", "E", day(0), [3], "a", 2), ("L1", "E", day(1), [4], "a", 0), ("L1", "E", day(2), [5], "d", 3)])
    standing.keep(stream(spark, landed), root, check, RANKS).awaitTermination()
    second = standing.kept(spark, root).where("batch = 1")
    assert {(r["draw_date"], r["numbers"][0], r["kind"]) for r in second.collect()} == {(day(0), 3, "corrected"), (day(2), 5, "new")}


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    """Its folder is written, but the query dies before the batch is done."""
    landed, root, check = (str(tmp_path / x) for x in ("landed", "root", "check"))
    first = [("L1", "E", day(0), [1], "b", 0)]
    land(spark, landed, first)
    standing.keep(stream(spark, landed), root, check, RANKS).awaitTermination()
    second = [("L1", "E", day(0), [2], "a", 1), ("L1", "E", day(1), [3], "c", 2)]
    land(spark, landed, second)

    def dies(batch, number):
        batch.limit(1).write.mode("overwrite").parquet(f"{root}/batch={number}")
        raise OSError("lost")

    broken = standing.changes(stream(spark, landed), RANKS).writeStream.outputMode("update").foreachBatch(dies)
    with pytest.raises(Exception, match="lost"):
        broken.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    standing.keep(stream(spark, landed), root, check, RANKS).awaitTermination()
    assert rows_of(standing.standing(spark, root)) == rows_of(reconcile.dedupe(spark.createDataFrame(first + second, DRAWS), RANKS))
    assert standing.kept(spark, root).agg(F.max("batch")).head()[0] == 1
