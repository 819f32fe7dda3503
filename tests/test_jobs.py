"""Whole jobs and the published document."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tombola.plans import jobs, publish
from tombola.plans.queries import reconciled
from tombola.sources.derived import DIMS, raw_draws
from tombola.sources.schema import DRAWS, Dims

SLUGS = Dims(start="2010-01-01", ranks=(("blocks", 0), ("table", 1)), slugs=(("nacional", "Nacional"),))


def block(numbers):
    spans = " ".join(f'<span class="score">{n}</span>' for n in numbers)
    return f'<div class="game-block x"><div><a class="game-title" href="/nacional/q">Gana</a></div><div>{spans}</div> </div> </div>'


def made(spark, *rows):
    return spark.createDataFrame([("Nacional", d, day, n, s, k) for k, (d, day, n, s) in enumerate(rows)], DRAWS)


def content(df):
    return {(r["lottery"], r["draw"], r["draw_date"], tuple(r["numbers"])) for r in df.collect()}


def test_daily_backfill_and_gap_fill(spark):
    one, two, three = date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3)
    there = made(spark, ("Gana", one, [1, 2, 3], "old"), ("Other", one, [5, 5, 5], "old"))
    pages = spark.createDataFrame([(block([7, 8, 9]), one), (block([4, 5, 6]), two)], "html string, page_date date")
    assert content(jobs.daily(there, pages, SLUGS)) == {("Nacional", "Gana", one, (7, 8, 9)), ("Nacional", "Gana", two, (4, 5, 6)), ("Nacional", "Other", one, (5, 5, 5))}
    tables = spark.createDataFrame([("<tr><td>02/01/2020</td><td>Gana</td><td>1 1 1</td></tr><tr><td>03/01/2020</td><td>Gana</td><td>2 2 2</td></tr>", "Nacional")], "html string, lottery string")
    out = content(jobs.backfill(there, pages, tables, SLUGS, ()))
    assert ("Nacional", "Gana", two, (4, 5, 6)) in out and ("Nacional", "Gana", three, (2, 2, 2)) in out and len(out) == 4
    filled = jobs.gap_fill(there, pages, "2020-01-01", "2020-01-03", ("N",), (("nacional", "gana", "N", "G"),), SLUGS)
    assert content(filled) == {("N", "G", one, (1, 2, 3)), ("N", "G", two, (4, 5, 6))}


def test_import_and_migration(spark, tmp_path):
    there = made(spark, ("Gana", date(2020, 1, 1), [1], "a"))
    sheet = made(spark, ("Gana", date(2020, 1, 1), [2], "sheet"), ("Gana", date(2020, 1, 2), [3], "sheet"))
    merged, counters = jobs.spreadsheet_import(there, sheet, "sheet", str(tmp_path / "t"))
    assert merged.count() == spark.read.parquet(str(tmp_path / "t")).count() == 2 and counters.head()["conflicts"] == 1
    again = spark.read.parquet(str(tmp_path / "t")).drop("year")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # the table that is read
        jobs.spreadsheet_import(again, sheet, "sheet", str(tmp_path / "t"))
    merged, counters = jobs.spreadsheet_import(again, made(spark, ("Gana", date(2020, 1, 3), [4], "sheet")), "sheet", str(tmp_path / "t2"))
    assert merged.count() == 3 and counters.head()["added"] == 1
    (tmp_path / "h.json").write_text('[{"lottery": "A", "draw_date": "2020-01-01", "numbers": [1, 2]}]')
    assert [jobs.migrate(spark, str(tmp_path / "h.json"), str(tmp_path / "m")) for _ in range(2)] == [1, 0]


def test_document(spark):
    rows = reconciled(spark, "/root/testdata/sf0.001").where("lottery IN ('1-URGENT', '5-LOW')").cache()
    found = json.loads(publish.document(rows, DIMS, F.lit(date(2001, 8, 1)), 3))
    assert set(found["lotteries"]) == {"1-URGENT", "5-LOW"} and set(found["lotteries"]["1-URGENT"]["draws"]) == {"F", "O", "P"}
    draw = found["lotteries"]["1-URGENT"]["draws"]["F"]
    assert len(draw["suggestions"]) == 3 and len(draw["last_results"]) == 8 and draw["backtest"]["status"] in ("ok", "insufficient")
    assert len(found["base_10"]["elite_group"]) == 5 and len(found["base_10"]["leader"]) == 1
    assert set(found["base_10"]) >= {"coincidences", "drags", "moving_numbers"} and found["lotteries"]["1-URGENT"]["daily"][0]["ymd"] < "1996"
    assert found["requested_from_date"] is None and found["disclaimer"] == publish.DISCLAIMER
    assert raw_draws(spark, "/root/testdata/sf0.001").count() == 1500
