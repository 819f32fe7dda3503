"""One query an operator or report, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import backtest, base, board, compare, frequency, reconcile
from ..sources.derived import DIMS, SHEET, arriving_draws, raw_draws
from ..sources.history import rows, with_key
from ..sources.shared import cut, new_folder
from ..streaming import standing
from . import jobs, landed, publish

Query = Callable[[SparkSession, str], DataFrame]
A, B = "1-URGENT", "2-HIGH"


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dedupe(raw_draws(spark, sf_dir), DIMS.ranks)


def _flat(rows: DataFrame) -> DataFrame:
    """numbers as n1, n2, n3."""
    return rows.select(*[c for c in rows.columns if c != "numbers"], *[F.get("numbers", F.lit(k)).alias(f"n{k + 1}") for k in range(3)])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd orders: what is there and what comes."""
    rows = raw_draws(spark, sf_dir)
    return rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")


def _on_raw(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(raw_draws(spark, sf_dir))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than the session has cores, dealt over all of
    them: parsing is bound by the processor. Larger tables are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _on_pages(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(_spread(raw_draws(spark, sf_dir)))


def _on_history(f: Callable[[DataFrame], DataFrame]) -> Query:
    """A report that names the history several times reads the tables once all the
    same: the later uses read the shuffle of the first. Nothing is kept."""
    return lambda spark, sf_dir: f(reconciled(spark, sf_dir))


def _on_cut_history(f: Callable[[DataFrame], DataFrame]) -> Query:
    """For reports whose plan names the history so often that the sorts by slot of
    all uses, which meet in one task, would outgrow it: the records are written
    once under spark.checkpoint.dir, one a slot, and read from there."""
    return lambda spark, sf_dir: f(cut(reconciled(spark, sf_dir)))


def _on_base(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(base.eligible(reconciled(spark, sf_dir), DIMS))


def _on_each(f: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_base(lambda rows: f(base.exploded(rows, DIMS)))


def _suggest(rows: DataFrame, by: list[str]) -> DataFrame:
    return frequency.suggest(rows, by, rows.agg(F.max("draw_date")).scalar(), 10).select(*by, "rank", "number", "score", "frequency", "recent_frequency", "delay_days")


def _import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    there, comes = _halves(spark, sf_dir)
    return there, comes.withColumn("source", F.lit(SHEET))


def _text(column: str, table: str, key: str, f: Callable[[F.Column], F.Column], into: str) -> Query:
    return lambda spark, sf_dir: _spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")).select(key, f(F.col(column)).alias(into))


def _kept_backtest(rows: DataFrame) -> DataFrame:
    """The backtest of a fold made without each draw's last ten days, which are
    then added. Days are added to a fold that was written and is read again, here too:
    an addition to a fold in one plan multiplies what made it."""
    rows = rows.join(rows.groupBy("lottery", "draw").agg(F.max("draw_date").alias("_last")), ["lottery", "draw"])
    old = F.datediff("_last", "draw_date") >= 10
    before, after = (rows.where(c).drop("_last") for c in (old, ~old))
    kept = backtest.fold(before)
    kept = replace(kept, near=cut(kept.near), older=cut(kept.older))
    return backtest.predictions(backtest.add(kept, after), 5)


def _preserved(rows: DataFrame, by: list[str]) -> DataFrame:
    """Yesterday's ten suggestions of what is shown, today's of all others."""
    last = rows.agg(F.max("draw_date")).scalar()
    listed = F.array_sort(F.collect_list(F.struct("rank", "number"))).alias("suggestions")  # ten entries
    best = lambda r, ref: frequency.suggest(r, by, ref, 10).groupBy(*by).agg(listed)
    before = best(rows.where(F.col("draw_date") < last), F.date_sub(last, 1))
    return publish.preserve(best(rows, last), publish.public(before, DIMS), by).select(*by, F.inline("suggestions"))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream runs when the query is called; what it wrote is returned."""
    folder = new_folder(spark, "standing")
    standing.keep(arriving_draws(spark, sf_dir), f"{folder}/changes", f"{folder}/checkpoint", DIMS.ranks).awaitTermination()
    return _flat(standing.standing(spark, f"{folder}/changes"))


def _range(rows: DataFrame) -> DataFrame:
    return compare.by_months(compare.month_rollup(rows.where(F.col("lottery").isin(A, B))), "1998-03-15", "1999-06-20")


QUERIES: dict[str, Query] = {
    "dedupe_by_source_priority": _on_history(_flat),
    "streamed_records": _streamed,
    "merge_history": lambda s, d: _flat(reconcile.merge_history(*_halves(s, d), DIMS.ranks)),
    "remove_future_republished": lambda s, d: _flat(reconcile.remove_future_republished(*_halves(s, d))),
    "insert_if_absent": lambda s, d: reconcile.insert_if_absent(*_halves(s, d)).select("result_key", "source", "seq"),
    "result_key": lambda s, d: with_key(raw_draws(s, d)).select("seq", "result_key"),
    "coverage": _on_history(frequency.coverage),
    "group_totals": _on_history(lambda r: frequency.group_totals(r, ["lottery", "draw"])),
    "last_seen": _on_history(lambda r: frequency.number_counts(r, ["lottery"]).select("lottery", "number", "last_seen")),
    "number_frequency": _on_history(lambda r: frequency.number_counts(r, ["lottery", "draw"])),
    "recent_frequency": _on_history(lambda r: frequency.recent_counts(r, ["lottery"])),
    "suggest_by_lottery": _on_history(lambda r: _suggest(r, ["lottery"])),
    "suggest_by_draw": _on_history(lambda r: _suggest(r, ["lottery", "draw"])),
    "last_results": _on_history(lambda r: _flat(board.last_results(r, ["lottery", "draw"]))),
    "backtest_predictions": _on_cut_history(lambda r: backtest.predictions(r, 5)),
    "backtest_kept": _on_cut_history(_kept_backtest),
    "backtest_hits": _on_cut_history(lambda r: backtest.hits(r).select("lottery", "draw", "draw_date", "top3_any", "top5_any", "first_position", "hits_top5")),
    "backtest_report": _on_cut_history(lambda r: backtest.report(r)),
    "backtest_recent_evals": _on_cut_history(lambda r: backtest.recent_evaluations(r).select("lottery", "draw", "draw_date", "place", F.array_join("predicted", " ").alias("predicted"), F.array_join("actual", " ").alias("actual"), F.array_join("hits", " ").alias("hits"))),
    "base_window": _on_base(lambda r: base.window(r, DIMS)),
    "base_counts": _on_each(base.counts),
    "base_top_recent": _on_each(lambda r: base.top_repeated(r, True)),
    "base_top_historical": _on_each(lambda r: base.top_repeated(r, False)),
    "base_position_counts": _on_each(base.position_counts),
    "delayed_by_position": _on_each(base.delayed_by_position),
    "delayed_by_label": _on_each(lambda r: base.delayed_by_label(r, DIMS)),
    "pair_counts": _on_base(lambda r: base.pair_counts(r, DIMS).drop("met", "met_recent")),
    "frequent_pairs": _on_base(lambda r: base.frequent_pairs(base.pair_counts(r, DIMS))),
    "bullet_pair": _on_base(lambda r: base.bullet_pair(base.pair_counts(r, DIMS))),
    "latest80_counts": _on_base(lambda r: base.latest_counts(r, DIMS)),
    "coincidences": _on_each(lambda r: base.coincidences(r).drop("met")),
    "drags": _on_base(lambda r: base.drags(r, DIMS).drop("met")),
    "moves": _on_each(base.moves),
    "coincidences_top": _on_each(base.top_coincidences),
    "drags_top": _on_base(lambda r: base.top_drags(r, DIMS)),
    "moves_top": _on_each(base.top_moves),
    "leader": _on_base(lambda r: base.leader(base.strength(r, DIMS)).select("number", "score")),
    "mirror_counts": _on_each(base.mirror_counts),
    "active_mirrors": _on_each(base.active_mirrors),
    "strength_ranking": _on_base(lambda r: base.strength(r, DIMS).select("rank", "number", "mirror", "score", *[c for c, _ in base.WEIGHTS])),
    "elite_group": _on_base(lambda r: base.elite(base.strength(r, DIMS)).select("rank", "number", "score")),
    "four_conditions_static": _on_base(lambda r: base.four_conditions(r, DIMS)),
    "daily_series": _on_history(compare.daily_series),
    "month_rollup": _on_history(compare.month_rollup),
    "compare_date_range": _on_history(_range),
    "compare_calendar": _on_history(lambda r: compare.by_calendar(r, month=6, week_day=3)),
    "compare_matching_draws": _on_history(lambda r: compare.matching_draws(compare.by_calendar(r, month=6, week_day=3))),
    "compare_current": _on_history(lambda r: compare.top(compare.current(_suggest(r, ["lottery"])), 10)),
    "compare_top_shared": _on_history(lambda r: compare.shared(_range(r), A, B, 25)),
    "compare_delayed": _on_history(lambda r: compare.delayed(_range(r))),
    "compare_four_conditions": _on_history(lambda r: compare.four_conditions(_range(r), A, B)),
    "today_board": _on_history(lambda r: board.today(r, _suggest(r, ["lottery", "draw"]), DIMS)),
    "draw_items": _on_history(lambda r: board.draw_items(r, DIMS)),
    "date_gaps": _on_history(lambda r: reconcile.date_gaps(r, "1995-01-01", "2001-12-31", (A, B))),
    "import_merge": lambda s, d: _flat(reconcile.import_merge(*_import(s, d), SHEET)),
    "import_counters": lambda s, d: reconcile.import_counters(*_import(s, d), SHEET),
    "import_rows_by_draw": lambda s, d: reconcile.import_rows_by_draw(reconcile.import_merge(*_import(s, d), SHEET), SHEET),
    "visible_draw_filter": _on_history(lambda r: base.visible(r, DIMS).select("lottery", "draw", "draw_date", "seq")),
    "canonical_label": _on_history(lambda r: base.canonical_label(r, DIMS).select("seq", "canonical")),
    "display_label": _on_history(lambda r: base.display_label(r, DIMS).select("seq", "label")),
    "preserve_suggestions": _on_history(lambda r: _preserved(r, ["lottery", "draw"])),
    "preserve_by_lottery": _on_history(lambda r: _preserved(r, ["lottery"])),
    "normalize_text": _text("text", "documents", "doc_id", T.normalized, "normal"),
    "strip_tags": _text("html", "pages", "page_id", lambda c: T.one_spaced(T.without_tags(c)), "bare"),
    "extract_numbers": _text("text", "documents", "doc_id", lambda c: F.array_join(T.numbers_in(c), " "), "numbers"),
    "find_date": _on_pages(landed.dates),
    "repair_text": _on_pages(landed.repairs),
    "small_functions": _on_pages(landed.small_functions),
    "parse_block_page": _on_pages(landed.blocks),
    "parse_list_page": _on_pages(landed.lists),
    "parse_attribute_page": _on_pages(landed.attributes),
    "parse_table_page": _on_pages(landed.tables),
    "parse_text": _on_pages(landed.texts),
    "parse_spreadsheet": _on_raw(landed.sheets),
    "parse_sheet_files": _on_pages(landed.sheet_files),
    "parse_feed": _on_raw(landed.feed),
    "wanted_draws": _on_raw(landed.wanted),
    "daily_job": lambda s, d: landed.daily_job(*_halves(s, d), jobs.daily, DIMS),
    "backfill_job": lambda s, d: landed.backfill_job(*_halves(s, d), jobs.backfill, DIMS),
    "gap_fill_job": lambda s, d: landed.gap_fill_job(*_halves(s, d), jobs.gap_fill, DIMS),
    "ingest_counters": lambda s, d: reconcile.added(_halves(s, d)[0], reconcile.merge_history(*_halves(s, d), DIMS.ranks)),
    "groups_in_order": _on_raw(lambda r: frequency.groups_in_order(r, ["lottery", "draw"])),
    "published_records": _on_history(lambda r: rows(r).withColumn("numbers", F.array_join("numbers", " "))),
    "initials": _on_raw(landed.initials),
    "percent_text": _on_history(lambda r: backtest.report(r).select("lottery", "draw", T.percent(F.col("top5_any_hit_rate")).alias("shown"))),
    "slug_lookup": _text("url", "pages", "page_id", lambda c: T.lottery_of_path(c, DIMS.slugs), "lottery"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["suggest_by_draw"](spark, sf_dir)
