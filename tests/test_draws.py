"""Behaviour of the draw operators on small literals."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tombola.operators import backtest, base, board, compare, frequency, parse, reconcile
from tombola.sources import history
from tombola.sources.schema import DRAWS, Dims

RANKS = (("a", 0), ("b", 1), ("c", 2))
DIMS = Dims(
    start="2010-08-01", ranks=RANKS, lotteries=("L1", "L2", "L3"), visible=(("L1", "Early"), ("L2", "Late Draw"), ("L3", "Late Draw")), aliases=(("second", "Late Draw"),),
    labels=(("L1", "Early", "one"), ("L2", "Late Draw", "two")), delay_labels=(("L1", "Early", "one"),),
)


def make(spark, rows):
    return spark.createDataFrame([(lo, d, day, list(n), s, k) for k, (lo, d, day, n, s) in enumerate(rows)], DRAWS)


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def test_dedupe_takes_the_best_source_and_the_first_of_equals(spark):
    rows = make(spark, [("L1", "Early", day(0), [1], "zzz"), ("L1", "Early", day(0), [2], "b/x"), ("L1", "Early", day(0), [3], "b/y"), ("L1", "Late", day(0), [4], "zzz")])
    out = {r["draw"]: r["numbers"] for r in reconcile.dedupe(rows, RANKS).collect()}
    assert out == {"Early": [2], "Late": [4]}
    again = reconcile.dedupe(reconcile.dedupe(rows, RANKS), RANKS)
    assert again.count() == 2


def test_last_per_slot(spark):
    rows = make(spark, [("L1", "E", day(0), [1], "a"), ("L1", "E", day(0), [2], "z")])
    assert reconcile.last_per_slot(rows).head()["numbers"] == [2]


@pytest.mark.parametrize(
    "old, new, left",
    [
        ((day(0), [1, 2, 3]), (day(1), [1, 2, 3]), {day(0), day(1)}),  # repeated later: both stay
        ((day(0), [1, 2, 3]), (day(1), [4, 5, 6]), {day(0), day(1)}),
        ((day(1), [1, 2, 3]), (day(0), [1, 2, 3]), {day(0)}),  # a future copy goes
    ],
)
def test_merge_history(spark, old, new, left):
    merged = reconcile.merge_history(make(spark, [("L1", "E", *old, "a")]), make(spark, [("L1", "E", *new, "a")]), RANKS)
    assert {r["draw_date"] for r in merged.collect()} == left


def test_merge_keeps_the_existing_row_of_an_equal_source_and_unrelated_future_rows(spark):
    there = make(spark, [("L1", "E", day(0), [1, 1, 1], "a"), ("L1", "E", day(5), [7, 8, 9], "a"), ("L2", "E", day(5), [2, 2, 2], "a")])
    comes = make(spark, [("L1", "E", day(0), [9, 9, 9], "a"), ("L1", "E", day(4), [7, 8, 9], "a")])
    out = {(r["lottery"], r["draw_date"]): r["numbers"] for r in reconcile.merge_history(there, comes, RANKS).collect()}
    assert out == {("L1", day(0)): [1, 1, 1], ("L1", day(4)): [7, 8, 9], ("L2", day(5)): [2, 2, 2]}


def test_insert_if_absent(spark):
    there = make(spark, [("L1", "E", day(0), [1, 20], "a")])
    comes = make(spark, [("L1", "E", day(0), [1, 20], "b"), ("L1", "E", day(0), [1, 21], "b"), ("L1", "E", day(0), [1, 21], "c")])
    out = reconcile.insert_if_absent(there, comes).collect()
    assert [(r["result_key"], r["source"]) for r in out] == [("2020-01-01|L1|E|01-21", "b")]


def test_import_merge_and_counters(spark):
    there = make(spark, [("L1", "E", day(0), [1], "a"), ("L1", "E", day(1), [2], "sheet")])
    sheet = make(spark, [("L1", "E", day(0), [5], "sheet"), ("L1", "E", day(1), [6], "sheet"), ("L1", "E", day(2), [7], "sheet"), ("L1", "E", day(2), [8], "sheet")])
    out = {r["draw_date"]: r["numbers"] for r in reconcile.import_merge(there, sheet, "sheet").collect()}
    assert out == {day(0): [1], day(1): [6], day(2): [8]}
    row = reconcile.import_counters(there, sheet, "sheet").head()
    assert (row["added"], row["conflicts"], row["total"]) == (1, 1, 3)


def test_date_gaps(spark):
    rows = make(spark, [("L1", "E", day(0), [1], "a"), ("L9", "E", day(1), [1], "a"), ("L2", "E", day(2), [1], "a")])
    assert [r[0] for r in reconcile.date_gaps(rows, "2020-01-01", "2020-01-04", ("L1", "L2")).orderBy("draw_date").collect()] == [day(1), day(3)]


def test_suggestions_rank_frequent_and_recent_numbers_first(spark):
    rows = make(spark, [("L1", "E", day(0), [7, 1, 2], "a"), ("L1", "E", day(1), [7, 3, 4], "a"), ("L1", "E", day(2), [7, 5, 6], "a")])
    out = frequency.suggest(rows, ["lottery"], F.lit(day(3)), 3).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2, 3] and out[0]["number"] == 7
    assert out[0]["score"] == pytest.approx(3 * 1.0 + 3 * 1.8 + 3.0 / 365)
    assert frequency.suggest(rows.where("false"), ["lottery"], F.lit(day(3))).count() == 0


def test_a_delay_of_zero_counts_as_the_longest_and_unseen_numbers_are_constant(spark):
    rows = make(spark, [("L1", "E", day(0), [1, 2, 3, 44], "a")])
    out = {r["number"]: r for r in frequency.suggest(rows, ["lottery"], F.lit(day(0)), 100).collect()}
    assert out[1]["score"] == pytest.approx(2.8 + 3.0) and out[1]["delay_days"] == 0
    assert out[44]["frequency"] == 1  # all numbers of a row count
    assert out[99]["score"] == pytest.approx(0.75) and out[99]["delay_days"] is None


def test_backtest(spark):
    rows = [("L1", "E", day(k), [10, 20, k % 7], "a") for k in range(31)] + [("L1", "E", day(31), [10, 20, 5], "a"), ("L1", "E", day(32), [10, 20, 6], "a")]
    row = backtest.report(make(spark, rows), 5, 10, 30).head()
    assert row["status"] == "ok" and row["tested_draws"] == 3 and row["top5_any_hit_rate"] == 1.0 and row["confidence_label"] == "Muestra baja"
    few = backtest.report(make(spark, rows[:30])).head()
    assert few["status"] == "insufficient" and few["tested_draws"] == 0
    assert backtest.recent_evaluations(make(spark, rows), 2, limit=5, window_days=10).count() == 2


def test_a_fold_with_days_added_equals_the_whole_history(spark, tmp_path):
    rng = random.Random(3)
    rows = [(lottery, "E", day(k), [rng.randrange(100) for _ in range(3)], "a") for k in range(110) for lottery in ("L1", "L2") for _ in range(rng.choice((0, 1, 1, 2)))]
    rows += [("L3", "E", day(k), [7, 8, 9], "a") for k in (0, 1, 104)]  # too few rows
    late = make(spark, [*rows, ("L1", "E", day(4), [1, 1, 2], "a"), ("L1", "E", day(44), [3, 4, 5], "a"), ("L2", "E", day(99), [6, 6, 6], "a"), ("L9", "E", day(103), [1, 2, 3], "a")]).persist()
    n = len(rows)
    whole = late.where(F.col("draw_date") < F.lit(day(100))).where(F.col("seq") < n)
    backtest.write(backtest.fold(whole, 20), f"{tmp_path}/0")
    for k in range(10):
        new = late.where((F.col("draw_date") == F.lit(day(100 + k))) & (F.col("seq") < n))
        if k == 3:  # a new draw, and old days that come late: folded, of the tail, of the window
            new = new.unionByName(late.where(F.col("seq") >= n))
        backtest.write(backtest.add(backtest.read(spark, f"{tmp_path}/{k}", 20), new), f"{tmp_path}/{k + 1}")
    kept = backtest.read(spark, f"{tmp_path}/10", 20)
    assert kept.near.count() < late.count() / 2
    for f in (backtest.predictions, backtest.hits, backtest.report):
        want, got = (sorted(map(str, f(x, 5, 20).collect())) for x in (late, kept))
        assert got == want and want


def test_a_fold_serves_only_what_it_was_made_for(spark):
    state = backtest.fold(make(spark, [("L1", "E", day(0), [1, 2, 3], "a")]), 20)
    with pytest.raises(ValueError):
        backtest.report(state)
    with pytest.raises(ValueError):
        backtest.hits(state, 5, 20, 31)


def test_four_conditions_with_a_measured_delay(spark):
    old = [("L1", "Early", date(2012, 1, 1) + timedelta(days=10 * k), [11, k, k + 30], "a") for k in range(24)]
    new = [("L1", "Early", day(0), [77, 1, 2], "a"), ("L2", "Late Draw", day(4), [77, 3, 4], "a"), ("L3", "Late Draw", day(9), [5, 6, 8], "a")]
    rows = base.eligible(make(spark, old + new), DIMS)
    known, measured = (base.four_conditions(rows, DIMS, fix_delay=fix).orderBy("place").collect() for fix in (False, True))
    assert len(known) == len(measured) == 3 and not any(r["delayed"] for r in known)
    assert {r["number"]: (r["delayed"], r["met"]) for r in measured}[77] == (True, 2)
    assert base.four_conditions(rows.where("false"), DIMS).count() == 0


def test_carry_over_crosses_the_edges_of_blocks(spark):
    rng = random.Random(5)
    rows = [("L1", "Early", day(k), rng.sample(range(6), 3), "a") for k in range(60) if rng.random() < 0.8]
    rows += [("L2", "Late Draw", r[2], rng.sample(range(6), 3), "a") for r in rows if rng.random() < 0.5]
    rows.sort(key=lambda r: (r[2], r[0]))
    want: dict[int, int] = {}
    for before, now in zip(rows, rows[1:]):
        for n in set(before[3]) & set(now[3]) if (now[2] - before[2]).days <= 1 else ():
            want[n] = want.get(n, 0) + 1
    assert {r["number"]: r["cnt"] for r in base.drags(base.eligible(make(spark, rows), DIMS), DIMS).collect()} == want


def test_base_filter_and_window(spark):
    rows = make(spark, [("L1", "early", day(0), [1, 2, 3], "a"), ("L2", "SECOND", day(3), [1, 2, 3], "a"), ("L1", "Hidden", day(9), [9, 9, 9], "a"), ("L1", "Early", day(9), [1, 2], "a"), ("L4", "Early", day(9), [1, 2, 3], "a")])
    kept = base.eligible(rows, DIMS)
    assert {(r["lottery"], r["draw"]) for r in kept.collect()} == {("L1", "early"), ("L2", "SECOND")}
    w = base.window(kept, DIMS).head()
    assert (w["from_date"], w["to_date"], w["results"]) == (date(2010, 8, 1), day(3), 2)
    assert base.window(kept.where("false"), DIMS).head()["to_date"] == date(2010, 8, 1)


def test_base_momentum(spark):
    old = [("L1", "Early", date(2012, 1, 1) + timedelta(days=10 * k), [11, k, k + 30], "a") for k in range(24)]
    new = [("L1", "Early", day(0), [77, 1, 2], "a"), ("L2", "Late Draw", day(1), [77, 3, 4], "a"), ("L3", "Late Draw", day(2), [77, 5, 6], "a")]
    rows = base.eligible(make(spark, old + new), DIMS)
    assert base.elite(base.strength(rows, DIMS)).orderBy("rank").head()["number"] == 77
    assert base.top_repeated(base.exploded(rows, DIMS), True).orderBy("rank").head()["number"] == 77


def test_drags_need_a_gap_of_a_day_at_most(spark):
    rows = make(spark, [("L1", "Early", day(0), [1, 2, 3], "a"), ("L2", "Late Draw", day(0), [3, 4, 5], "a"), ("L1", "Early", day(1), [5, 4, 9], "a"), ("L1", "Early", day(3), [5, 8, 9], "a")])
    out = {r["number"]: r["cnt"] for r in base.drags(rows, DIMS).collect()}
    assert out == {3: 1, 4: 1, 5: 1}


def test_coincidences_moves_pairs_and_mirrors(spark):
    rows = make(spark, [("L1", "Early", day(0), [12, 12, 21], "a"), ("L2", "Late Draw", day(0), [12, 5, 5], "a"), ("L1", "Early", day(15), [50, 1, 2], "a")])
    each = base.exploded(rows, DIMS)
    assert {r["number"]: r["cnt"] for r in base.coincidences(each).collect()} == {12: 2}
    assert {r["number"]: r["cnt"] for r in base.moves(each).collect() if r["cnt"]} == {12: 2}
    assert {(r["a"], r["b"]): r["cnt"] for r in base.pair_counts(rows, DIMS).collect()} == {(12, 21): 1, (5, 12): 1, (1, 50): 1, (2, 50): 1, (1, 2): 1}
    mirrors = {r["number"]: (r["cnt"], r["recent_30"]) for r in base.mirror_counts(each).collect()}
    assert mirrors == {12: (4, 4), 21: (4, 4), 5: (3, 3), 50: (3, 3)}
    assert base.active_mirrors(each).count() == 0  # seen 15 days ago
    assert base.active_mirrors(each, days=15).count() == 2


def test_first_encounter_breaks_ties(spark):
    rows = make(spark, [("L1", "Early", day(0), [9, 8, 7], "a"), ("L1", "Early", day(1), [1, 7, 9], "a")])
    out = base.top_repeated(base.exploded(rows, DIMS), False).orderBy("rank").collect()
    assert [r["number"] for r in out] == [9, 7, 8, 1]


def test_compare_filters(spark):
    rows = make(spark, [("L1", "x", date(2024, 6, 5), [1, 2, 3], "a"), ("L1", "x", date(2024, 6, 6), [1, 4, 5], "a"), ("L1", "x", date(2024, 7, 10), [6], "a")])
    june = compare.by_calendar(rows, month=6, week_day=3)
    assert {(r["pos"], r["number"]) for r in june.collect()} == {(0, 1), (0, 2), (0, 3), (1, 1), (2, 2), (3, 3)}
    whole = compare.by_months(compare.month_rollup(rows), "2024-06-30", None)
    assert {r["number"]: r["cnt"] for r in whole.where("pos = 0").collect()}[1] == 2
    with pytest.raises(ValueError):
        compare.by_calendar(rows)
    with pytest.raises(ValueError):
        compare.by_months(compare.month_rollup(rows), None, None)


def test_draw_items_skip_repeated_draws_and_numbers(spark):
    rows = make(spark, [("L2", "Late Draw", day(3), [1, 2, 3], "a"), ("L2", "second", day(2), [4, 5, 6], "a"), ("L1", "Early", day(1), [7, 8, 9], "a")])
    out = board.draw_items(rows, DIMS).collect()
    assert [(r["lottery"], r["draw"]) for r in out] == [("L2", "Late Draw"), ("L1", "Early")]


def test_history_files(spark, tmp_path):
    assert history.read_json(spark, str(tmp_path / "none.json")).count() == 0
    path = tmp_path / "h.json"
    path.write_text('[{"lottery": "L1", "draw_date": "2020-01-01", "numbers": [1, 2]}, {"lottery": "L0", "draw": "x", "draw_date": "2020-01-03", "numbers": [3], "source": "a"}]')
    rows = history.read_json(spark, str(path))
    assert {(r["draw"], r["source"]) for r in rows.collect()} == {("General", "unknown"), ("x", "a")}
    history.export_json(rows, str(tmp_path / "out.json"))
    assert [r["lottery"] for r in history.read_json(spark, str(tmp_path / "out.json")).orderBy("seq").collect()] == ["L0", "L1"]
    history.write_table(rows, str(tmp_path / "t"))
    assert [r["lottery"] for r in history.read_table(spark, str(tmp_path / "t")).collect()] == ["L0", "L1"]
    good, bad = history.quarantine(make(spark, [("L1", "E", day(0), [1, 100], "a"), ("L1", "E", day(1), [1, 99], "a")]))
    assert (good.count(), bad.count()) == (1, 1)
    path.write_text('[{"lottery": "L1", "numbers": [1]}]')
    with pytest.raises(Exception, match="draw_date"):
        history.read_json(spark, str(path)).collect()


def test_feed_rows(spark):
    feed = spark.createDataFrame([("A", "", "Noche", "2020-01-01", ["1", "x", "02"]), ("A", None, None, "2020-01-02", ["1", "2"]), ("A", "J", "", None, ["1", "2"]), ("", "J", "", "2020-01-03", ["1", "-2"])], "loteria string, juego string, turno string, fecha string, numeros array<string>")
    assert {(r["draw"], tuple(r["numbers"])) for r in history.from_feed(feed, "s").collect()} == {("Noche", (1, 2)), ("General", (1, 2))}


def test_streamed_files_are_merged(spark, tmp_path):
    from tombola.streaming.ingest import history as at
    from tombola.streaming.ingest import ingest

    landed, root, check = (str(tmp_path / x) for x in ("landed", "root", "check"))
    make(spark, [("L1", "E", day(0), [1, 2], "b")]).write.mode("append").parquet(landed)
    ingest(spark, landed, root, check, RANKS).awaitTermination()
    make(spark, [("L1", "E", day(0), [3, 4], "a"), ("L1", "E", day(1), [5, 6], "a")]).write.mode("append").parquet(landed)
    ingest(spark, landed, root, check, RANKS).awaitTermination()
    assert {(r["draw_date"], tuple(r["numbers"])) for r in at(spark, root, 1).collect()} == {(day(0), (3, 4)), (day(1), (5, 6))}


def test_fallback_counters_and_orders(spark, tmp_path):
    one, two = make(spark, [("A", "x", day(1), [1, 2, 3], "api")]), make(spark, [("A", "x", day(2), [4, 5, 6], "page"), ("B", "x", day(1), [7, 8, 9], "page")])
    both = reconcile.with_fallback(one, two, ["lottery"])
    assert sorted((r["lottery"], r["source"]) for r in both.collect()) == [("A", "api"), ("B", "page")]
    assert reconcile.added(one, both).head()[:] == (1, 2)
    assert [r["lottery"] for r in history.oldest_first(both).collect()] == ["A", "B"]
    assert not history.available(spark, None) and not history.available(spark, str(tmp_path / "none"))
    (tmp_path / "sheet.csv").write_text(",2020-01-01,1,2,3,GANA\n")
    assert history.available(spark, str(tmp_path / "sheet.csv"))
    cells = history.read_cells(spark, str(tmp_path / "sheet.csv"))
    assert parse.from_spreadsheet(cells, (("GANA", "L", "Gana"),), today=F.lit("2025-01-01").cast("date"), source="s").head()["numbers"] == [1, 2, 3]
    history.write_table(both, str(tmp_path / "t"))
    history.write_table(both.where("false"), str(tmp_path / "t"), "overwrite")
    assert spark.read.schema(both.schema).parquet(str(tmp_path / "t")).count() == 0
