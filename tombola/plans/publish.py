"""The published document, and keeping parts of the previous one."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pad2
from ..operators import backtest, base, board, compare, frequency
from ..sources.schema import Dims
from ..sources.sinks import write_document

#: Fixed value: a sentence of the document.
DISCLAIMER = "Estas sugerencias son estadísticas y no garantizan resultados."


def suggestions(rows: DataFrame, by: list[str]) -> DataFrame:
    """A group's suggestions as one array, best first (at most the limit)."""
    item = F.struct("rank", pad2(F.col("number")).alias("number"), F.round("score", 2).alias("score"), "frequency", "delay_days", "recent_frequency")
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.dropFields("rank")).alias("suggestions"))


def _last(draws: DataFrame, by: list[str]) -> DataFrame:
    item = F.struct("place", F.date_format("draw_date", "yyyy-MM-dd").alias("draw_date"), "lottery", "draw", "numbers", "source")
    return board.last_results(draws, by).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.dropFields("place")).alias("last_results"))


def predictions(draws: DataFrame, dims: Dims, reference: Column, limit: int = 10) -> DataFrame:
    """One row a (lottery, draw): its suggestions, last rows, total and backtest."""
    by = ["lottery", "draw"]
    parts = [suggestions(frequency.suggest(draws, by, reference, limit), by), _last(draws, by), frequency.group_totals(draws, by).withColumnRenamed("total", "total_results")]
    report = backtest.report(draws, limit)
    parts.append(report.select(*by, F.struct(*[c for c in report.columns if c not in by]).alias("backtest")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by, "left")
    return out


def by_lottery(draws: DataFrame, reference: Column, limit: int = 10) -> DataFrame:
    """One row a lottery: its suggestions, last rows, total, and the compact
    series of all its days."""
    out = suggestions(frequency.suggest(draws, ["lottery"], reference, limit), ["lottery"])
    series = compare.daily_series(draws).groupBy("lottery").agg(F.array_sort(F.collect_list(F.struct("ymd", "n1", "n2", "n3"))).alias("daily"))
    return out.join(series, "lottery", "left").join(_last(draws, ["lottery"]), "lottery", "left").join(frequency.group_totals(draws, ["lottery"]).withColumnRenamed("total", "total_results"), "lottery")


def public(rows: DataFrame, dims: Dims) -> DataFrame:
    """Only shown lotteries, and of those that have one the visible draws."""
    rows = rows.where(F.col("lottery").isin(*dims.lotteries))
    return base.visible(rows, dims) if "draw" in rows.columns else rows


def preserve(current: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """Current rows with the previous suggestions, where the previous document
    has the same key; keys it alone has are ignored."""
    old = previous.select(*by, F.col("suggestions").alias("_old"))
    return current.join(old, by, "left").withColumn("suggestions", F.coalesce("_old", "suggestions")).drop("_old")


def base_report(draws: DataFrame, dims: Dims) -> dict[str, DataFrame]:
    """The base report's tables by name."""
    return _base_tables(base.eligible(draws, dims), dims)


def _base_tables(rows: DataFrame, dims: Dims) -> dict[str, DataFrame]:
    each, ranked, pairs = base.exploded(rows, dims), base.strength(rows, dims), base.pair_counts(rows, dims)
    return {
        "window": base.window(rows, dims), "top_10_repeated": base.top_repeated(each, True), "top_10_historical": base.top_repeated(each, False),
        "delayed_by_position": base.delayed_by_position(each), "delayed_by_lottery": base.delayed_by_label(each, dims),
        "active_mirrors": base.active_mirrors(each), "frequent_pairs": base.frequent_pairs(pairs), "strength_ranking": ranked.where("rank <= 10"),
        "elite_group": base.elite(ranked), "bullet_pair": base.bullet_pair(pairs), "leader": base.leader(ranked),
        "coincidences": base.top_coincidences(each), "drags": base.top_drags(rows, dims), "moving_numbers": base.top_moves(each),
    }


def document(draws: DataFrame, dims: Dims, reference: Column, limit: int = 10, *, generated_at: datetime | None = None, requested_from: str | None = None) -> str:
    """The whole report as JSON, put together on the driver as it is published: a
    row a lottery and draw (with the lottery's whole series, which the page reads),
    and tables of a few rows. generated_at is in its own zone."""
    rows = lambda df: [json.loads(r) for r in df.toJSON().collect()]
    lotteries = {r.pop("lottery"): {**r, "draws": {}} for r in rows(by_lottery(draws, reference, limit))}
    for r in rows(predictions(draws, dims, reference, limit)):
        lotteries[r.pop("lottery")]["draws"][r.pop("draw")] = r
    span = rows(frequency.coverage(draws))[0]
    kept = base.eligible(draws, dims).persist()
    try:
        tables = {name: rows(df) for name, df in _base_tables(kept, dims).items()}
    finally:
        kept.unpersist()
    return json.dumps({
        "generated_at": generated_at and generated_at.isoformat(timespec="seconds"), "generated_at_display": generated_at and generated_at.strftime("%d/%m/%Y %H:%M"),
        "generated_timezone": generated_at and str(generated_at.tzinfo), "requested_from_date": requested_from,
        "actual_from_date": span.get("from_date"), "actual_to_date": span.get("to_date"), "disclaimer": DISCLAIMER,
        "base_10": tables, "lotteries": lotteries,
    }, ensure_ascii=False, sort_keys=True)


def save(spark: SparkSession, text: str, path: str) -> None:
    """Puts a document in place of the one at `path`, as a whole or not at all."""
    write_document(spark.createDataFrame([(text,)], "value string"), path, array=False)


def previous_document(spark: SparkSession, path: str) -> dict | None:
    """The document at `path`, or None if it is missing or isn't JSON."""
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except Exception as e:  # noqa: BLE001  any unreadable document counts as none
        if type(e).__name__ not in ("AnalysisException", "JSONDecodeError"):
            raise
        return None
    return found if isinstance(found, dict) else None


def with_previous(document_: dict, previous: dict | None, base_only: bool = False) -> bool:
    """Puts the previous base report, and unless base_only the suggestions of
    keys in both, into a document; False if there is nothing to take over."""
    if previous is None or base_only and not isinstance(previous.get("base_10"), dict):
        return False
    if isinstance(previous.get("base_10"), dict):
        document_["base_10"] = previous["base_10"]
    if base_only:
        return True
    for name, old in (previous.get("lotteries") or {}).items():
        now = document_.get("lotteries", {}).get(name)
        if now is None or not isinstance(old, dict):
            continue
        pairs = [(now, old), *((now.get("draws", {}).get(d), o) for d, o in (old.get("draws") or {}).items())]
        for target, kept in pairs:
            if target is not None and isinstance(kept, dict) and "suggestions" in kept:
                target["suggestions"] = kept["suggestions"]
    return True
