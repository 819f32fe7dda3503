"""The stored table's layout, published documents, and versions of a history."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tombola.operators import reconcile
from tombola.plans import jobs, publish
from tombola.plans.queries import reconciled
from tombola.sources import history, sinks, versions
from tombola.sources.derived import raw_draws
from tombola.sources.schema import DRAWS, Dims

DATA = "/root/testdata/sf0.01"


def scanned(df):
    """Rows that the scan of a run plan gave, before any filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    leaf = leaves.head()
    while "Scan" not in leaf.nodeName():
        leaf = leaf.plan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value(), leaf.metrics().apply("numFiles").value()


def test_a_filter_on_lottery_or_date_reads_little_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "ROW_GROUP", 1 << 12)
    rows = raw_draws(spark, DATA)
    history.write_table(rows, str(tmp_path / "t"))
    total, files = scanned(history.read_table(spark, str(tmp_path / "t"), ordered=False))
    assert total == rows.count() == 15_000
    one = history.read_table(spark, str(tmp_path / "t"), lottery="3-MEDIUM", ordered=False)
    read, _ = scanned(one)
    assert one.count() == rows.where("lottery = '3-MEDIUM'").count() and read < total / 3
    none = history.read_table(spark, str(tmp_path / "t"), lottery="3-MEDIUN", ordered=False)  # within the bounds, so a Bloom filter says it
    assert scanned(none)[0] < total / 3 and none.count() == 0
    days = history.read_table(spark, str(tmp_path / "t"), start="1998-03-01", end="1998-04-30", ordered=False)
    assert days.count() == rows.where("draw_date BETWEEN '1998-03-01' AND '1998-04-30'").count() and scanned(days)[1] < files / 3


def test_insert_reads_the_years_it_needs(spark, tmp_path):
    rows, path = raw_draws(spark, DATA), str(tmp_path / "t")
    assert history.insert(rows.limit(0), path).count() == 0
    history.write_table(rows.where("seq % 2 = 0"), path)
    new = history.insert(rows, path)
    want = reconcile.insert_if_absent(rows.where("seq % 2 = 0"), rows).drop("result_key")
    assert sorted(r["seq"] for r in new.collect()) == sorted(r["seq"] for r in want.collect())
    late = history.insert(rows.where("year(draw_date) = 1999"), path)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "= 1999)" in plan.split("PartitionFilters: [")[-1].split("]")[0]


def test_a_failed_task_leaves_the_old_document(spark, tmp_path):
    path = str(tmp_path / "out.json")
    rows = raw_draws(spark, DATA).where("seq < 4000")
    history.export_json(rows, path)
    found = json.load(open(path))
    assert len(found) == rows.count() and [r["draw_date"] for r in found] == sorted((r["draw_date"] for r in found), reverse=True)
    assert found[0].keys() == {"lottery", "draw", "draw_date", "numbers", "source"}
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.to_json(F.struct("id"))).otherwise(F.raise_error(F.lit("broken"))).alias("value"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_document(bad, path)
    assert json.load(open(path)) == found and not [f for f in os.listdir(tmp_path) if ".new-" in f]
    sinks.write_document(bad.where("false"), path)
    assert json.load(open(path)) == []
    sinks.write_document(spark.range(0, 1000, 1, 7).select(F.to_json(F.struct("id")).alias("value")), path)
    assert [r["id"] for r in json.load(open(path))] == list(range(1000))
    publish.save(spark, '{"a": 1}', path)
    assert publish.previous_document(spark, path) == {"a": 1}
    with pytest.raises(Exception, match="one string column"):
        sinks.write_document(spark.range(3), path)


def row(day, number, source="a", seq=0):
    return ("A", "d", date(2020, 1, day), [number, number], source, seq)


def test_of_two_writers_one_wins_and_the_other_may_try_again(spark, tmp_path):
    root = f"file://{tmp_path}/h"
    frame = lambda *r: spark.createDataFrame(list(r), DRAWS)
    assert versions.version(spark, root) is None and versions.read(spark, root).count() == 0
    first = versions.commit(frame(row(1, 1)), root, None)
    assert (first.number, first.rows, first.new, first.first_day) == (0, 1, 1, "2020-01-01")
    old = versions.read(spark, root)
    second = versions.commit(frame(row(1, 1), row(2, 2)), root, first)
    with pytest.raises(versions.Conflict):
        versions.commit(frame(row(9, 9)), root, first)
    assert versions.version(spark, root) == second and second.new == 1 and len(os.listdir(tmp_path / "h" / "data")) == 2
    assert old.count() == 1 and versions.read(spark, root).count() == 2 and versions.read(spark, root, 0).count() == 1
    raced = []

    def change(there):
        if not raced:  # another writer comes between reading and committing
            raced.append(versions.commit(there.unionByName(frame(row(3, 3))), root, second))
        return there.unionByName(frame(row(4, 4)))

    made = versions.update(spark, root, change)
    assert made.number == 3 and sorted(r["numbers"][0] for r in versions.read(spark, root).collect()) == [1, 2, 3, 4]
    with pytest.raises(RuntimeError, match="stop"):  # a writer that fails on its way changes nothing
        versions.update(spark, root, lambda there: (_ for _ in ()).throw(RuntimeError("stop")))
    versions.forget(spark, root, 1)
    assert versions.versions(spark, root) == [3] and versions.read(spark, root).count() == 4


def test_jobs_keep_versions_with_their_counters(spark, tmp_path):
    root = f"file://{tmp_path}/h"
    (tmp_path / "h.json").write_text('[{"lottery": "A", "draw": "d", "draw_date": "2020-01-01", "numbers": [1, 2]}, {"lottery": "A", "draw": "d", "draw_date": "2020-01-01", "numbers": [1, 2]}]')
    assert [jobs.keep_migrated(spark, root, str(tmp_path / "h.json")).new for _ in range(2)] == [1, 0]
    sheet = spark.createDataFrame([row(1, 5, "sheet"), row(2, 6, "sheet", 1)], DRAWS)
    made, counters = jobs.keep_import(spark, root, sheet, "sheet")
    assert (made.rows, made.new, made.last_day) == (2, 1, "2020-01-02") and counters.head()["conflicts"] == 1
    html = '<div class="game-block x"><a class="game-title" href="/q">d</a><span class="score">7</span><span class="score">8</span></div>'
    pages = spark.createDataFrame([(html, date(2020, 1, 3))], "html string, page_date date")
    made = jobs.keep_daily(spark, root, pages, Dims(start="2010-01-01", slugs=(("q", "A"),)))
    assert made.number == 3 and made.new == 1 and versions.read(spark, root).where("draw_date = '2020-01-03'").head()["numbers"] == [7, 8]


def test_a_whole_history_as_a_version(spark, tmp_path):
    rows = reconciled(spark, DATA)
    made = versions.commit(rows, f"file://{tmp_path}/h", None)
    assert made.rows == rows.count() == versions.read(spark, f"file://{tmp_path}/h").count()
    assert versions.read(spark, f"file://{tmp_path}/h").exceptAll(rows.select(*DRAWS.names)).isEmpty()
