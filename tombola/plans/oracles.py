"""The queries in SQL for DuckDB, written independently of the DataFrame code:
plain joins and global windows instead of its rewrites."""

from __future__ import annotations

_RAW = """
raw AS (
  SELECT o_orderpriority AS lottery, o_orderstatus AS draw, CAST(o_orderdate AS DATE) AS draw_date,
         [CAST((o_orderkey * 37) % 100 AS INTEGER), CAST(o_custkey % 100 AS INTEGER), CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS INTEGER)] AS numbers,
         ['feed://first/day', 'feed://second', 'feed://third', 'feed://fourth', 'sheet'][CAST(o_custkey % 5 AS INTEGER) + 1] AS source,
         [0, 1, 2, 3, 99][CAST(o_custkey % 5 AS INTEGER) + 1] AS srank,
         o_orderkey AS seq
  FROM orders)"""
_DRAWS = f"""{_RAW},
draws AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, seq) AS k FROM raw) WHERE k = 1)"""
_VISIBLE = """
shown(lottery, draw) AS (VALUES ('1-URGENT', 'F'), ('2-HIGH', 'F'), ('3-MEDIUM', 'F'), ('4-NOT SPECIFIED', 'F'), ('5-LOW', 'F'),
  ('1-URGENT', 'O'), ('2-HIGH', 'O'), ('3-MEDIUM', 'O'), ('1-URGENT', 'P'), ('2-HIGH', 'P'), ('3-MEDIUM', 'P')),
visible AS (SELECT d.* FROM draws d SEMI JOIN shown s ON d.lottery = s.lottery AND d.draw = s.draw)"""
_LABELS = """
labels(lottery, draw, label) AS (VALUES ('1-URGENT', 'F', 'Urgent early'), ('1-URGENT', 'O', 'Urgent late'), ('1-URGENT', 'P', 'Urgent late'),
  ('2-HIGH', 'F', 'High early'), ('2-HIGH', 'O', 'High late'), ('2-HIGH', 'P', 'High late'), ('3-MEDIUM', 'F', 'Medium'),
  ('3-MEDIUM', 'O', 'Medium'), ('3-MEDIUM', 'P', 'Medium'), ('4-NOT SPECIFIED', 'F', 'Other'))"""
_BASE = f"""{_DRAWS},{_VISIBLE},
base AS (
  SELECT * FROM visible WHERE lottery IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AND draw_date >= DATE '1997-01-01' AND len(numbers) >= 3),
last AS (SELECT coalesce(max(draw_date), DATE '1997-01-01') AS d FROM base),
each AS (
  SELECT draw_date, lottery, draw, pos, number, row_number() OVER (ORDER BY draw_date, lottery, draw, pos) AS met,
         draw_date >= CAST((SELECT d FROM last) - INTERVAL 6 DAY AS DATE) AS recent_7,
         draw_date >= CAST((SELECT d FROM last) - INTERVAL 29 DAY AS DATE) AS recent_30
  FROM (SELECT draw_date, lottery, draw, unnest(numbers) AS number, generate_subscripts(numbers, 1) AS pos FROM base) WHERE pos <= 3)"""
_FLAT = "lottery, draw, draw_date, source, seq, numbers[1] AS n1, numbers[2] AS n2, numbers[3] AS n3"
_SCORE = """(CASE WHEN frequency = 0 AND recent_frequency = 0 THEN 0.25e0 ELSE 1e0 END) *
  (frequency * 1e0 + recent_frequency * 1.8e0 + (CASE WHEN delay_days IS NULL OR delay_days = 0 THEN 365 ELSE least(delay_days, 365) END) / 365e0 * 3e0)"""


def _suggest(by: str, rows: str = "draws", day: str = "(SELECT max(draw_date) FROM draws)", limit: int = 10, name: str = "best") -> str:
    on = " AND ".join(f"g.{c} = c.{c}" for c in [*by.split(", "), "number"])
    on_r = on.replace("c.", "r.")
    g = ", ".join(f"g.{c}" for c in by.split(", "))
    return f"""
{name}_all AS (SELECT {by}, number, count(*) AS frequency, max(draw_date) AS last_seen FROM (SELECT {by}, draw_date, unnest(numbers) AS number FROM {rows}) GROUP BY ALL),
{name}_recent AS (
  SELECT {by}, number, count(*) AS recent_frequency FROM (
    SELECT {by}, unnest(numbers) AS number FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY draw_date DESC, lottery DESC, draw DESC) AS k FROM {rows}) WHERE k <= 30) GROUP BY ALL),
{name}_grid AS (SELECT * FROM (SELECT DISTINCT {by} FROM {rows}), (SELECT CAST(range AS INTEGER) AS number FROM range(100))),
{name}_counts AS (
  SELECT {g}, g.number, CAST(coalesce(frequency, 0) AS BIGINT) AS frequency, CAST(coalesce(recent_frequency, 0) AS BIGINT) AS recent_frequency,
         CAST({day} - last_seen AS INTEGER) AS delay_days
  FROM {name}_grid g LEFT JOIN {name}_all c ON {on} LEFT JOIN {name}_recent r ON {on_r}),
{name} AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, frequency DESC, recent_frequency DESC, number) AS INTEGER) AS rank
    FROM (SELECT *, {_SCORE} AS score FROM {name}_counts)) WHERE rank <= {limit})"""


def _backtest(limit: int) -> str:
    return f"""{_DRAWS},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lottery, draw ORDER BY draw_date, seq) AS place, count(*) OVER (PARTITION BY lottery, draw) AS n,
         max(draw_date) OVER (PARTITION BY lottery, draw) AS last_date FROM draws),
target AS (
  SELECT p.*, (SELECT count(*) FROM placed q WHERE q.lottery = p.lottery AND q.draw = p.draw AND q.draw_date < p.draw_date) AS before
  FROM placed p WHERE n > 30 AND draw_date >= CAST(last_date - INTERVAL 60 DAY AS DATE)),
tested AS (SELECT * FROM target WHERE before >= 30),
prior AS (
  SELECT t.lottery, t.draw, t.draw_date AS target_date, p.draw_date, unnest(p.numbers) AS number, p.place > t.before - 30 AS lately
  FROM (SELECT DISTINCT lottery, draw, draw_date, before FROM tested) t JOIN placed p ON p.lottery = t.lottery AND p.draw = t.draw AND p.draw_date < t.draw_date),
bt_counts AS (
  SELECT g.lottery, g.draw, g.target_date, g.number, CAST(count(p.number) AS BIGINT) AS frequency, CAST(count(*) FILTER (WHERE p.lately) AS BIGINT) AS recent_frequency,
         CAST(g.target_date - max(p.draw_date) AS INTEGER) AS delay_days
  FROM (SELECT * FROM (SELECT DISTINCT lottery, draw, draw_date AS target_date FROM tested), (SELECT CAST(range AS INTEGER) AS number FROM range(100))) g
  LEFT JOIN prior p ON p.lottery = g.lottery AND p.draw = g.draw AND p.target_date = g.target_date AND p.number = g.number
  GROUP BY g.lottery, g.draw, g.target_date, g.number),
predicted AS (
  SELECT * EXCLUDE (delay_days) FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lottery, draw, target_date ORDER BY score DESC, frequency DESC, recent_frequency DESC, number) AS INTEGER) AS rank
    FROM (SELECT *, {_SCORE} AS score FROM bt_counts)) WHERE rank <= {limit}),
five AS (SELECT lottery, draw, target_date, list(number ORDER BY rank) FILTER (WHERE rank <= 5) AS predicted FROM predicted GROUP BY ALL),
hits AS (
  SELECT t.lottery, t.draw, t.draw_date, t.seq, t.numbers[1:3] AS actual, f.predicted, list_sort(list_intersect(list_distinct(t.numbers[1:3]), f.predicted)) AS hits,
         len(list_intersect(t.numbers[1:3], f.predicted[1:3])) > 0 AS top3_any, list_contains(f.predicted, t.numbers[1]) AS first_position
  FROM tested t JOIN five f ON f.lottery = t.lottery AND f.draw = t.draw AND f.target_date = t.draw_date)"""


_COINC = """
coinc AS (
  SELECT number, CAST(sum(n) AS BIGINT) AS cnt, CAST(coalesce(sum(n) FILTER (WHERE recent_30), 0) AS BIGINT) AS recent_30, min(met) AS met FROM (
    SELECT draw_date, number, count(DISTINCT lottery) AS n, min(met) AS met, bool_or(recent_30) AS recent_30 FROM each GROUP BY draw_date, number) WHERE n > 1 GROUP BY number)"""
_DRAGS = """
ordered AS (
  SELECT draw_date, lottery, draw, list_distinct(numbers[1:3]) AS cur, lag(numbers[1:3]) OVER w AS prev, lag(draw_date) OVER w AS prev_date, row_number() OVER w AS met
  FROM base WINDOW w AS (ORDER BY draw_date, lottery, draw)),
drag AS (
  SELECT number, count(*) AS cnt, count(*) FILTER (WHERE draw_date >= CAST((SELECT d FROM last) - INTERVAL 29 DAY AS DATE)) AS recent_30, min(met) AS met
  FROM (SELECT draw_date, met, unnest(list_intersect(cur, prev)) AS number FROM ordered WHERE draw_date - prev_date <= 1) GROUP BY number)"""
_MOVES = """
move AS (
  SELECT number, CASE WHEN count(DISTINCT lottery) > 1 THEN count(DISTINCT lottery) ELSE 0 END AS cnt,
         CASE WHEN count(DISTINCT lottery) FILTER (WHERE recent_30) > 1 THEN count(DISTINCT lottery) FILTER (WHERE recent_30) ELSE 0 END AS recent_30
  FROM each GROUP BY number)"""
_COUNTS = """
counts AS (SELECT number, count(*) AS frequency, count(*) FILTER (WHERE recent_7) AS recent_7, count(*) FILTER (WHERE recent_30) AS recent_30 FROM each GROUP BY number)"""
_MIRRORS = f"""{_COUNTS},
mir AS (
  SELECT a.number, b.number AS mirror, a.frequency + b.frequency AS cnt, CASE WHEN b.recent_30 > 0 THEN a.recent_30 + b.recent_30 ELSE 0 END AS recent_30
  FROM counts a JOIN counts b ON b.number = (a.number % 10) * 10 + a.number // 10 AND a.number <> b.number)"""
_LATEST = """
latest AS (
  SELECT number, count(*) AS cnt FROM (
    SELECT unnest(numbers[1:3]) AS number FROM (SELECT * FROM base ORDER BY draw_date DESC, lottery DESC, draw DESC LIMIT 80)
    WHERE draw_date >= CAST((SELECT d FROM last) - INTERVAL 29 DAY AS DATE)) GROUP BY number)"""
_PAIRS = """
pairs AS (
  SELECT a, b, count(*) AS cnt, count(*) FILTER (WHERE r) AS recent_30, min(met) AS met, min(met) FILTER (WHERE r) AS met_recent FROM (
    SELECT DISTINCT x.met AS met, x.r, least(x.n, y.n) AS a, greatest(x.n, y.n) AS b
    FROM (SELECT met, r, unnest(ns) AS n FROM rows) x JOIN (SELECT met, unnest(ns) AS n FROM rows) y ON x.met = y.met AND x.n < y.n) GROUP BY a, b)"""
_PAIR_ROWS = """
rows AS (
  SELECT numbers[1:3] AS ns, row_number() OVER (ORDER BY draw_date, lottery, draw) AS met,
         draw_date >= CAST((SELECT d FROM last) - INTERVAL 29 DAY AS DATE) AS r FROM base)"""
_STRENGTH = f"""{_BASE},{_COINC},{_DRAGS},{_MOVES},{_MIRRORS},{_LATEST},
summed AS (
  SELECT c.number, (c.number % 10) * 10 + c.number // 10 AS mirror, c.frequency, coalesce(l.cnt, 0) AS recent, c.recent_30, c.recent_7,
         coalesce(co.recent_30, 0) AS recent_coincidences, coalesce(dr.recent_30, 0) AS recent_drags, coalesce(mi.recent_30, 0) AS recent_mirrors, coalesce(mo.recent_30, 0) AS recent_moves,
         coalesce(co.cnt, 0) AS coincidences, coalesce(dr.cnt, 0) AS drags, coalesce(mi.cnt, 0) AS mirrors, coalesce(mo.cnt, 0) AS moves
  FROM counts c LEFT JOIN latest l USING (number) LEFT JOIN coinc co USING (number) LEFT JOIN drag dr USING (number) LEFT JOIN mir mi USING (number) LEFT JOIN move mo USING (number)),
strength AS (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, recent_7 DESC, recent_30 DESC, frequency DESC, number) AS INTEGER) AS rank FROM (
    SELECT *, round(frequency * 0.08e0 + recent * 3e0 + recent_30 * 7e0 + recent_7 * 10e0 + recent_coincidences * 4e0 + recent_drags * 3.5e0 + recent_mirrors * 1e0
           + recent_moves * 4e0 + coincidences * 0.15e0 + drags * 0.15e0 + mirrors * 0.03e0 + moves * 0.5e0, 2) AS score FROM summed))"""
_ROLLUP = f"""{_DRAWS},
nums AS (SELECT lottery, draw_date, strftime(draw_date, '%Y-%m') AS month, unnest(numbers[1:3]) AS number, generate_subscripts(numbers[1:3], 1) AS p FROM draws),
both_pos AS (SELECT lottery, draw_date, month, number, CAST(p AS INTEGER) AS pos FROM nums UNION ALL SELECT lottery, draw_date, month, number, 0 FROM nums)"""
_RANGE = f"""{_ROLLUP},
stats AS (SELECT lottery, pos, number, count(*) AS cnt FROM both_pos WHERE lottery IN ('1-URGENT', '2-HIGH') AND month BETWEEN '1998-03' AND '1999-06' GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lottery ORDER BY cnt DESC, number) AS INTEGER) AS rank FROM stats WHERE pos = 0)"""
_CALENDAR = f"""{_ROLLUP},
stats AS (SELECT lottery, pos, number, count(*) AS cnt FROM both_pos WHERE month(draw_date) = 6 AND dayofweek(draw_date) = 3 GROUP BY ALL)"""
_HALVES = f"""{_RAW},
existing AS (SELECT * FROM raw WHERE seq % 2 = 0), incoming AS (SELECT * FROM raw WHERE seq % 2 = 1)"""
_KEPT = """
newest AS (SELECT lottery, draw, numbers, max(draw_date) AS d FROM incoming GROUP BY ALL),
kept AS (SELECT e.* FROM existing e LEFT JOIN newest n ON e.lottery = n.lottery AND e.draw = n.draw AND e.numbers = n.numbers WHERE n.d IS NULL OR e.draw_date <= n.d)"""
_KEY = "strftime(draw_date, '%Y-%m-%d') || '|' || lottery || '|' || draw || '|' || array_to_string(list_transform(numbers, lambda n: lpad(CAST(n AS VARCHAR), 2, '0')), '-')"
_IMPORT = f"""{_RAW},
there AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY seq DESC) AS k FROM raw WHERE seq % 2 = 0) WHERE k = 1),
comes_all AS (SELECT lottery, draw, draw_date, numbers, 'sheet' AS source, srank, seq FROM raw WHERE seq % 2 = 1),
comes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY seq DESC) AS k FROM comes_all) WHERE k = 1),
merged AS (
  SELECT coalesce(t.lottery, c.lottery) AS lottery, coalesce(t.draw, c.draw) AS draw, coalesce(t.draw_date, c.draw_date) AS draw_date,
         CASE WHEN t.seq IS NULL OR (t.source = 'sheet' AND c.seq IS NOT NULL) THEN c.numbers ELSE t.numbers END AS numbers,
         CASE WHEN t.seq IS NULL OR (t.source = 'sheet' AND c.seq IS NOT NULL) THEN c.source ELSE t.source END AS source,
         CASE WHEN t.seq IS NULL OR (t.source = 'sheet' AND c.seq IS NOT NULL) THEN c.seq ELSE t.seq END AS seq
  FROM there t FULL OUTER JOIN comes c ON t.lottery = c.lottery AND t.draw = c.draw AND t.draw_date = c.draw_date)"""
_LAST8 = """
last8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY draw_date DESC, lottery DESC, draw DESC) AS place FROM draws) WHERE place <= 8)"""
_N3 = "numbers[1] AS n1, numbers[2] AS n2, numbers[3] AS n3"
_PAD = "array_to_string(list_transform({}, lambda n: lpad(CAST(n AS VARCHAR), 2, '0')), ' ')"


def _delays(by: str, rows: str, n: int) -> str:
    return f"""SELECT {by}, rank, number, delay_days, last_seen, frequency FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY delay_days DESC, frequency DESC, met) AS INTEGER) AS rank FROM (
    SELECT {by}, number, CAST((SELECT d FROM last) - max(draw_date) AS INTEGER) AS delay_days, max(draw_date) AS last_seen, count(*) AS frequency, min(met) AS met
    FROM {rows} GROUP BY {by}, number)) WHERE rank <= {n}"""


def _top(source: str, order: str, columns: str, n: int = 10) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, {columns} FROM {source} ORDER BY {order} LIMIT {n}"


ORACLE_SQL: dict[str, str] = {
    "dedupe_by_source_priority": f"WITH {_DRAWS} SELECT {_FLAT} FROM draws",
    "streamed_records": f"WITH {_DRAWS} SELECT {_FLAT} FROM draws",
    "merge_history": f"""WITH {_HALVES},{_KEPT},
both_rows AS (SELECT *, 0 AS batch FROM kept UNION ALL SELECT *, 1 FROM incoming)
SELECT {_FLAT} FROM (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, batch, seq) AS k FROM both_rows) WHERE k = 1""",
    "remove_future_republished": f"WITH {_HALVES},{_KEPT} SELECT {_FLAT} FROM kept",
    "insert_if_absent": f"""WITH {_HALVES},
keyed AS (SELECT {_KEY} AS result_key, source, seq FROM incoming), have AS (SELECT {_KEY} AS result_key FROM existing)
SELECT result_key, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY result_key ORDER BY seq) AS k FROM keyed) WHERE k = 1 AND result_key NOT IN (SELECT result_key FROM have)""",
    "result_key": f"WITH {_RAW} SELECT seq, {_KEY} AS result_key FROM raw",
    "coverage": f"WITH {_DRAWS} SELECT min(draw_date) AS from_date, max(draw_date) AS to_date FROM draws",
    "group_totals": f"WITH {_DRAWS} SELECT lottery, draw, count(*) AS total FROM draws GROUP BY ALL",
    "last_seen": f"WITH {_DRAWS} SELECT lottery, number, max(draw_date) AS last_seen FROM (SELECT *, unnest(numbers) AS number FROM draws) GROUP BY lottery, number",
    "number_frequency": f"WITH {_DRAWS} SELECT lottery, draw, number, count(*) AS frequency, max(draw_date) AS last_seen FROM (SELECT *, unnest(numbers) AS number FROM draws) GROUP BY lottery, draw, number",
    "recent_frequency": f"WITH {_DRAWS},{_suggest('lottery')} SELECT lottery, number, recent_frequency FROM best_recent",
    "suggest_by_lottery": f"WITH {_DRAWS},{_suggest('lottery')} SELECT lottery, rank, number, score, frequency, recent_frequency, delay_days FROM best",
    "suggest_by_draw": f"WITH {_DRAWS},{_suggest('lottery, draw')} SELECT lottery, draw, rank, number, score, frequency, recent_frequency, delay_days FROM best",
    "last_results": f"""WITH {_DRAWS} SELECT {_FLAT}, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY lottery, draw ORDER BY draw_date DESC) AS place FROM draws) WHERE place <= 8""",
    "backtest_predictions": f"WITH {_backtest(5)} SELECT * FROM predicted",
    "backtest_kept": f"WITH {_backtest(5)} SELECT * FROM predicted",
    "backtest_hits": f"WITH {_backtest(10)} SELECT lottery, draw, draw_date, top3_any, len(hits) > 0 AS top5_any, first_position, CAST(len(hits) AS BIGINT) AS hits_top5 FROM hits",
    "backtest_report": f"""WITH {_backtest(10)},
r AS (
  SELECT d.lottery, d.draw, d.n, coalesce(h.tested, 0) AS tested, h.* EXCLUDE (lottery, draw, tested)
  FROM (SELECT lottery, draw, count(*) AS n FROM draws GROUP BY ALL) d LEFT JOIN (
    SELECT lottery, draw, count(*) AS tested, count(*) FILTER (WHERE top3_any) AS top3_hits, count(*) FILTER (WHERE len(hits) > 0) AS top5_hits,
           count(*) FILTER (WHERE first_position) AS first_hits, CAST(sum(len(hits)) AS BIGINT) AS total_hits FROM hits GROUP BY ALL) h ON d.lottery = h.lottery AND d.draw = h.draw)
SELECT lottery, draw, CASE WHEN tested > 0 THEN 'ok' ELSE 'insufficient' END AS status,
       CASE WHEN tested > 0 THEN NULL WHEN n <= 30 THEN 'needs 31 rows' ELSE 'no recent row has enough history' END AS message, CAST(60 AS INTEGER) AS window_days, tested AS tested_draws,
       top3_hits, top5_hits, first_hits, total_hits, CASE WHEN tested > 0 THEN round(top3_hits / tested, 3) END AS top3_any_hit_rate, CASE WHEN tested > 0 THEN round(top5_hits / tested, 3) END AS top5_any_hit_rate,
       CASE WHEN tested > 0 THEN round(first_hits / tested, 3) END AS first_position_hit_rate, CASE WHEN tested > 0 THEN round(total_hits / tested, 2) END AS average_hits_top5,
       CASE WHEN tested = 0 THEN NULL WHEN tested < 20 THEN 'Muestra baja' WHEN top5_hits / tested >= 0.35e0 THEN 'Alta' WHEN top5_hits / tested >= 0.18e0 THEN 'Media' ELSE 'Baja' END AS confidence_label
FROM r""",
    "backtest_recent_evals": f"""WITH {_backtest(10)}
SELECT lottery, draw, draw_date, CAST(row_number() OVER (PARTITION BY lottery, draw ORDER BY draw_date, seq) AS INTEGER) AS place,
       array_to_string(predicted, ' ') AS predicted, array_to_string(actual, ' ') AS actual, array_to_string(hits, ' ') AS hits
FROM (SELECT *, row_number() OVER (PARTITION BY lottery, draw ORDER BY draw_date DESC, seq DESC) AS k FROM hits) WHERE k <= 5""",
    "base_window": f"WITH {_BASE} SELECT DATE '1997-01-01' AS from_date, (SELECT d FROM last) AS to_date, count(*) AS results FROM base",
    "base_counts": f"WITH {_BASE},{_COUNTS} SELECT * FROM counts",
    "base_top_recent": f"WITH {_BASE} " + _top("(SELECT number, count(*) AS cnt, min(met) AS met FROM each WHERE recent_30 GROUP BY number)", "cnt DESC, met", "number, cnt"),
    "base_top_historical": f"WITH {_BASE} " + _top("(SELECT number, count(*) AS cnt, min(met) AS met FROM each GROUP BY number)", "cnt DESC, met", "number, cnt"),
    "base_position_counts": f"WITH {_BASE} SELECT CAST(pos AS INTEGER) AS pos, number, count(*) AS frequency, max(draw_date) AS last_seen FROM each GROUP BY pos, number",
    "delayed_by_position": f"WITH {_BASE} " + _delays("pos", "(SELECT * REPLACE (CAST(pos AS INTEGER) AS pos) FROM each)", 10),
    "delayed_by_label": f"""WITH {_BASE},
exact(lottery, draw, label) AS (VALUES ('1-URGENT', 'F', 'Urgent early'), ('1-URGENT', 'O', 'Urgent late'), ('2-HIGH', 'F', 'High'), ('2-HIGH', 'O', 'High'), ('3-MEDIUM', 'F', 'Medium')),
labelled AS (SELECT e.* REPLACE (CAST(pos AS INTEGER) AS pos), x.label FROM each e JOIN exact x ON e.lottery = x.lottery AND e.draw = x.draw) """
    + _delays("label, pos", "labelled", 3),
    "pair_counts": f"WITH {_BASE},{_PAIR_ROWS},{_PAIRS} SELECT a, b, cnt, recent_30 FROM pairs",
    "frequent_pairs": f"WITH {_BASE},{_PAIR_ROWS},{_PAIRS} " + _top("pairs", "cnt DESC, met, a, b", "a, b, cnt"),
    "bullet_pair": f"""WITH {_BASE},{_PAIR_ROWS},{_PAIRS}
SELECT a, b, CASE WHEN recent_30 > 0 THEN recent_30 ELSE cnt END AS cnt FROM pairs
ORDER BY recent_30 > 0 DESC, CASE WHEN recent_30 > 0 THEN recent_30 ELSE cnt END DESC, coalesce(met_recent, met), a, b LIMIT 1""",
    "latest80_counts": f"WITH {_BASE},{_LATEST} SELECT number, cnt FROM latest",
    "coincidences": f"WITH {_BASE},{_COINC} SELECT number, cnt, recent_30 FROM coinc",
    "drags": f"WITH {_BASE},{_DRAGS} SELECT number, cnt, recent_30 FROM drag",
    "moves": f"WITH {_BASE},{_MOVES} SELECT number, cnt, recent_30 FROM move",
    "coincidences_top": f"WITH {_BASE},{_COINC} " + _top("coinc", "cnt DESC, met", "number, cnt"),
    "drags_top": f"WITH {_BASE},{_DRAGS} " + _top("drag", "cnt DESC, met, number", "number, cnt"),
    "moves_top": f"WITH {_BASE},{_MOVES} " + _top("(SELECT number, cnt AS lotteries FROM move WHERE cnt > 0)", "lotteries DESC, number", "number, lotteries"),
    "leader": f"WITH {_STRENGTH} SELECT number, score FROM strength WHERE rank = 1",
    "mirror_counts": f"WITH {_BASE},{_MIRRORS} SELECT number, mirror, cnt, recent_30 FROM mir",
    "active_mirrors": f"""WITH {_BASE},
seen AS (SELECT number, max(draw_date) AS d FROM each GROUP BY number),
act AS (
  SELECT a.number, b.number AS mirror, CAST(abs(a.d - b.d) AS INTEGER) AS diff_days, CAST((SELECT d FROM last) - a.d AS INTEGER) AS days_ago_a, CAST((SELECT d FROM last) - b.d AS INTEGER) AS days_ago_b
  FROM seen a JOIN seen b ON b.number = (a.number % 10) * 10 + a.number // 10 AND a.number < b.number
  WHERE (SELECT d FROM last) - a.d <= 14 AND (SELECT d FROM last) - b.d <= 14) """
    + _top("act", "diff_days, days_ago_a, number", "number, mirror, diff_days, days_ago_a, days_ago_b", 12),
    "strength_ranking": f"WITH {_STRENGTH} SELECT * FROM strength",
    "elite_group": f"WITH {_STRENGTH} SELECT rank, number, score FROM strength WHERE rank <= 5",
    "four_conditions_static": f"""WITH {_STRENGTH},
marked AS (
  SELECT s.number, s.rank, s.number IN (SELECT number FROM (SELECT number, count(*) AS c, min(met) AS m FROM each WHERE recent_30 GROUP BY number ORDER BY c DESC, m LIMIT 10)) AS recent, false AS delayed,
         coalesce(c.cnt > 50, false) AS coincides, coalesce(d.cnt > 100, false) AS drags
  FROM strength s LEFT JOIN (SELECT * FROM coinc ORDER BY cnt DESC, met LIMIT 10) c USING (number) LEFT JOIN (SELECT * FROM drag ORDER BY cnt DESC, met, number LIMIT 10) d USING (number) WHERE s.rank <= 10)
SELECT *, CAST(row_number() OVER (ORDER BY met DESC, rank) AS INTEGER) AS place
FROM (SELECT *, CAST(recent AS INTEGER) + CAST(delayed AS INTEGER) + CAST(coincides AS INTEGER) + CAST(drags AS INTEGER) AS met FROM marked) ORDER BY met DESC, rank LIMIT 3""",
    "daily_series": f"WITH {_DRAWS} SELECT lottery, draw, strftime(draw_date, '%Y%m%d') AS ymd, numbers[1] AS n1, numbers[2] AS n2, numbers[3] AS n3 FROM draws",
    "month_rollup": f"WITH {_ROLLUP} SELECT lottery, month, pos, number, count(*) AS cnt FROM both_pos GROUP BY ALL",
    "compare_date_range": f"WITH {_RANGE} SELECT lottery, pos, number, cnt FROM stats",
    "compare_calendar": f"WITH {_CALENDAR} SELECT lottery, pos, number, cnt FROM stats",
    "compare_matching_draws": f"WITH {_CALENDAR} SELECT lottery, CAST(sum(cnt) AS BIGINT) AS draws FROM stats WHERE pos = 1 GROUP BY lottery",
    "compare_current": f"""WITH {_DRAWS},{_suggest('lottery')},
shown AS (SELECT lottery, number, CASE WHEN frequency <> 0 THEN CAST(frequency AS DOUBLE) WHEN round(score, 2) <> 0 THEN round(score, 2) ELSE 1e0 END AS cnt FROM best)
SELECT lottery, CAST(row_number() OVER (PARTITION BY lottery ORDER BY cnt DESC, number) AS INTEGER) AS rank, number, cnt FROM shown""",
    "compare_top_shared": f"""WITH {_RANGE}
SELECT a.number, a.cnt AS cnt_a, a.rank AS rank_a, b.cnt AS cnt_b, b.rank AS rank_b FROM ranked a JOIN ranked b ON a.number = b.number
WHERE a.lottery = '1-URGENT' AND b.lottery = '2-HIGH' AND a.rank <= 25 AND b.rank <= 25""",
    "compare_delayed": f"""WITH {_RANGE}
SELECT * FROM (SELECT lottery, pos, CAST(row_number() OVER (PARTITION BY lottery, pos ORDER BY cnt, number) AS INTEGER) AS rank, number, cnt FROM stats WHERE pos > 0) WHERE rank <= 3""",
    "compare_four_conditions": f"""WITH {_RANGE},
a AS (SELECT * FROM ranked WHERE lottery = '1-URGENT'), b AS (SELECT * FROM ranked WHERE lottery = '2-HIGH'),
cand AS (SELECT number FROM a WHERE rank <= 15 UNION SELECT number FROM b WHERE rank <= 15),
cond AS (
  SELECT number, number IN (SELECT number FROM a WHERE rank <= 10) AS repeats, number IN (SELECT number FROM a) AND number NOT IN (SELECT number FROM a WHERE rank <= 3) AS delayed,
         number IN (SELECT number FROM b WHERE rank <= 20) AS coincides, number IN (SELECT number FROM a WHERE rank <= 10) AND number IN (SELECT number FROM b WHERE rank <= 10) AS drags FROM cand),
met AS (SELECT *, CAST(repeats AS INTEGER) + CAST(delayed AS INTEGER) + CAST(coincides AS INTEGER) + CAST(drags AS INTEGER) AS met FROM cond)
SELECT *, CAST(row_number() OVER (ORDER BY met DESC, number) AS INTEGER) AS rank FROM met ORDER BY met DESC, number LIMIT 6""",
    "today_board": f"""WITH {_DRAWS},{_LABELS},{_LAST8},{_suggest('lottery, draw')},
rows AS (
  SELECT l.label, d.draw_date, d.numbers, row_number() OVER w AS turn, lead(d.numbers) OVER w AS before
  FROM last8 d JOIN labels l ON d.lottery = l.lottery AND d.draw = l.draw WINDOW w AS (PARTITION BY l.label ORDER BY d.draw_date DESC, d.lottery, d.place)),
named(label, lottery, draw) AS (VALUES ('Urgent early', '1-URGENT', 'F'), ('Urgent late', '1-URGENT', 'O'), ('High early', '2-HIGH', 'F'), ('High late', '2-HIGH', 'O'), ('Medium', '3-MEDIUM', 'F'), ('Other', '4-NOT SPECIFIED', 'F')),
sug AS (SELECT n.label, string_agg(lpad(CAST(number AS VARCHAR), 2, '0'), ' ' ORDER BY rank) AS suggested FROM best b JOIN named n ON b.lottery = n.lottery AND b.draw = n.draw WHERE rank <= 5 GROUP BY n.label)
SELECT r.label, r.draw_date, numbers[1] AS n1, numbers[2] AS n2, numbers[3] AS n3, coalesce(list_contains(before, numbers[1]), false) AS repeats_1,
       coalesce(list_contains(before, numbers[2]), false) AS repeats_2, coalesce(list_contains(before, numbers[3]), false) AS repeats_3, s.suggested
FROM rows r LEFT JOIN sug s ON s.label = r.label WHERE turn = 1""",
    "draw_items": f"""WITH RECURSIVE {_DRAWS[1:]},{_VISIBLE},{_LAST8},
items AS (
  SELECT l.lottery, l.draw, l.draw_date, l.place, row_number() OVER (PARTITION BY l.lottery ORDER BY l.place) AS n, lower(CASE l.draw WHEN 'P' THEN 'O' ELSE l.draw END) AS key,
         {_PAD.format('l.numbers[1:3]').replace("' ')", "'-')")} AS shown
  FROM last8 l SEMI JOIN shown s ON l.lottery = s.lottery AND l.draw = s.draw),
fold AS (
  SELECT DISTINCT lottery, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS sames, CAST([] AS BIGINT[]) AS picked FROM items
  UNION ALL
  SELECT f.lottery, i.n, CASE WHEN i.good THEN list_append(f.keys, i.key) ELSE f.keys END, CASE WHEN i.good THEN list_append(f.sames, i.same) ELSE f.sames END, CASE WHEN i.good THEN list_append(f.picked, i.n) ELSE f.picked END
  FROM (SELECT f.lottery AS of, f.n AS at, x.*, x.draw_date || '|' || x.shown AS same,
               NOT list_contains(f.keys, x.key) AND NOT list_contains(f.sames, x.draw_date || '|' || x.shown) AND len(f.picked) < 3 AS good
        FROM fold f JOIN items x ON x.lottery = f.lottery AND x.n = f.n + 1) i JOIN fold f ON f.lottery = i.of AND f.n = i.at),
last AS (SELECT lottery, unnest(picked) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY n DESC) AS k FROM fold) WHERE k = 1)
SELECT i.lottery, i.draw, i.draw_date, i.shown AS numbers, CAST(i.place AS INTEGER) AS place FROM items i JOIN last t ON t.lottery = i.lottery AND t.n = i.n ORDER BY i.draw_date DESC, i.lottery, i.place LIMIT 21""",
    "date_gaps": f"""WITH {_DRAWS}
SELECT CAST(x AS DATE) AS draw_date FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) g(x)
WHERE CAST(x AS DATE) NOT IN (SELECT draw_date FROM draws WHERE lottery IN ('1-URGENT', '2-HIGH'))""",
    "import_merge": f"WITH {_IMPORT} SELECT {_FLAT} FROM merged",
    "import_counters": f"""WITH {_IMPORT}
SELECT (SELECT count(*) FROM comes c WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.lottery = c.lottery AND t.draw = c.draw AND t.draw_date = c.draw_date)) AS added,
       (SELECT count(*) FROM comes_all c JOIN there t ON t.lottery = c.lottery AND t.draw = c.draw AND t.draw_date = c.draw_date WHERE t.source <> 'sheet') AS conflicts,
       count(*) AS total, min(draw_date) AS from_date, max(draw_date) AS to_date FROM merged""",
    "import_rows_by_draw": f"WITH {_IMPORT} SELECT lottery, draw, count(*) AS rows FROM merged WHERE source = 'sheet' GROUP BY ALL",
    "visible_draw_filter": f"WITH {_DRAWS},{_VISIBLE} SELECT lottery, draw, draw_date, seq FROM visible",
    "canonical_label": f"WITH {_DRAWS} SELECT seq, CASE draw WHEN 'P' THEN 'O' ELSE draw END AS canonical FROM draws",
    "display_label": f"WITH {_DRAWS},{_LABELS} SELECT d.seq, l.label FROM draws d JOIN labels l ON d.lottery = l.lottery AND d.draw = l.draw",
    "preserve_suggestions": f"""WITH {_DRAWS},{_VISIBLE},{_suggest('lottery, draw', name='now')},
old_rows AS (SELECT * FROM draws WHERE draw_date < (SELECT max(draw_date) FROM draws)),{_suggest('lottery, draw', 'old_rows', 'CAST((SELECT max(draw_date) FROM draws) - INTERVAL 1 DAY AS DATE)', 10, 'old')},
pub AS (SELECT o.* FROM old o SEMI JOIN shown s ON o.lottery = s.lottery AND o.draw = s.draw WHERE o.lottery <> '5-LOW')
SELECT n.lottery, n.draw, n.rank, n.number FROM now n WHERE NOT EXISTS (SELECT 1 FROM pub p WHERE p.lottery = n.lottery AND p.draw = n.draw)
UNION ALL SELECT p.lottery, p.draw, p.rank, p.number FROM pub p WHERE EXISTS (SELECT 1 FROM now n WHERE p.lottery = n.lottery AND p.draw = n.draw)""",
    "preserve_by_lottery": f"""WITH {_DRAWS},{_suggest('lottery', name='now')},
old_rows AS (SELECT * FROM draws WHERE draw_date < (SELECT max(draw_date) FROM draws)),{_suggest('lottery', 'old_rows', 'CAST((SELECT max(draw_date) FROM draws) - INTERVAL 1 DAY AS DATE)', 10, 'old')}
SELECT lottery, rank, number FROM now WHERE lottery = '5-LOW' UNION ALL SELECT lottery, rank, number FROM old WHERE lottery <> '5-LOW'""",
    "normalize_text": r"SELECT doc_id, trim(regexp_replace(translate(lower(trim(text, ' ')), 'áéíóúñ', 'aeioun'), '\s+', ' ', 'g'), ' ') AS normal FROM documents",
    "strip_tags": r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS bare FROM pages",
    "extract_numbers": r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: length(d) <= 2), lambda d: CAST(d AS INTEGER)), ' ') AS numbers FROM documents",
    "find_date": f"""WITH {_RAW}
SELECT seq, CASE WHEN seq % 6 IN (0, 2, 3) THEN draw_date WHEN seq % 6 = 1 THEN make_date(2000 + year(draw_date) % 100, month(draw_date), day(draw_date)) END AS day,
       CASE WHEN seq % 6 IN (0, 2, 3, 5) THEN draw_date WHEN seq % 6 = 1 THEN make_date(2000 + year(draw_date) % 100, month(draw_date), day(draw_date)) END AS any_day FROM raw""",
    "repair_text": """SELECT o_orderkey AS seq,
       CASE o_orderkey % 4 WHEN 0 THEN 'Lotería  ' || o_orderkey WHEN 1 THEN '<b>SEÑAL</b> ' || o_orderkey WHEN 2 THEN 'Ã broken ' || o_orderkey ELSE ' Plain É ' || o_orderkey END AS repaired,
       CASE o_orderkey % 4 WHEN 0 THEN 'Lotería ' || o_orderkey WHEN 1 THEN 'SEÑAL ' || o_orderkey WHEN 2 THEN 'Ã broken ' || o_orderkey ELSE 'Plain É ' || o_orderkey END AS clean,
       CASE o_orderkey % 4 WHEN 0 THEN 'loteria ' || o_orderkey WHEN 1 THEN '<b>senal</b> ' || o_orderkey WHEN 2 THEN 'ã broken ' || o_orderkey ELSE 'plain e ' || o_orderkey END AS normal FROM orders""",
    "small_functions": f"""WITH {_RAW}
SELECT seq, ['Noche', 'Tarde', 'Mañana', 'Mediodía', 'General'][CAST(seq % 5 AS INTEGER) + 1] AS session,
       strftime(draw_date, '%d') || ' ' || ['Ene', 'Feb', 'Mar', 'Abr', 'May', 'Jun', 'Jul', 'Ago', 'Sep', 'Oct', 'Nov', 'Dic'][month(draw_date)] AS short,
       CASE WHEN year(draw_date) >= 1996 THEN strftime(draw_date, '%Y-%m') || ' ' ELSE '' END || '2010-01' AS months,
       CASE WHEN seq % 2 = 0 THEN lottery WHEN seq % 3 = 0 THEN '4-NOT SPECIFIED' ELSE draw END AS lottery,
       '{{"a":"<\\/b>' || draw || '"}}' AS json FROM raw""",
    "parse_block_page": f"""WITH {_RAW}
SELECT lottery, draw, CASE WHEN seq % 2 = 0 THEN CAST(draw_date + CAST(seq % 3 AS INTEGER) AS DATE) ELSE make_date(year(CAST(draw_date + CAST(seq % 3 AS INTEGER) AS DATE)), month(draw_date), day(draw_date)) END AS draw_date,
       {_N3} FROM raw""",
    "parse_list_page": f"WITH {_RAW} SELECT lottery, draw, draw_date, {_N3} FROM raw",
    "parse_attribute_page": f"WITH {_RAW} SELECT lottery, draw, draw_date, {_N3} FROM raw",
    "parse_table_page": f"WITH {_RAW} SELECT CASE draw WHEN 'P' THEN '5-LOW' ELSE lottery END AS lottery, draw || ' noche' AS draw, draw_date, {_N3} FROM raw",
    "parse_text": f"WITH {_RAW} SELECT substr(lottery, 3) AS lottery, CASE WHEN seq % 2 = 0 THEN 'Noche' ELSE 'Tarde' END AS draw, draw_date, {_N3} FROM raw",
    "parse_spreadsheet": f"""WITH {_RAW}
SELECT 'Sheet' AS lottery, CASE draw WHEN 'F' THEN 'Early' ELSE 'Late' END AS draw, draw_date, {_N3} FROM raw
WHERE draw IN ('F', 'O') AND draw_date <= DATE '1999-12-31' AND seq % 7 <> 0""",
    "parse_sheet_files": f"""WITH {_RAW}
SELECT 'Sheet' AS lottery, CASE draw WHEN 'F' THEN 'Early' ELSE 'Late' END AS draw, draw_date, {_N3} FROM raw
WHERE draw IN ('F', 'O') AND draw_date <= DATE '1999-12-31' AND seq % 7 <> 0 AND seq % 5 <> 0""",
    "parse_feed": f"""WITH {_RAW}
SELECT CASE WHEN seq % 11 = 0 THEN 'Sin nombre' ELSE lottery END AS lottery, CASE WHEN seq % 2 = 1 THEN draw WHEN seq % 4 = 0 THEN 'General' ELSE 't' || draw END AS draw, draw_date, {_N3} FROM raw WHERE seq % 13 <> 0""",
    "wanted_draws": f"""WITH {_RAW}, names(l, d, lottery, draw) AS (VALUES ('1-urgent', 'f', 'Urgent', 'Early'), ('1-urgent', 'o', 'Urgent', 'Late'), ('3-medium', 'p', 'Medium', 'Other'))
SELECT n.lottery, n.draw, draw_date, {_N3} FROM raw r JOIN names n ON lower(r.lottery) = n.l AND lower(r.draw) = n.d""",
    "daily_job": f"""WITH {_RAW},
existing AS (SELECT * REPLACE (CASE WHEN srank = 0 THEN 0 ELSE srank END AS srank) FROM raw WHERE seq % 2 = 0),
incoming AS (
  SELECT * EXCLUDE (k) REPLACE ('blocks' AS source, 1 AS srank) FROM (
    SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, seq) AS k FROM raw WHERE seq % 2 = 1) WHERE k = 1),{_KEPT},
both_rows AS (SELECT *, 0 AS batch FROM kept UNION ALL SELECT *, 1 FROM incoming)
SELECT lottery, draw, draw_date, source, {_N3} FROM (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, batch, seq) AS k FROM both_rows) WHERE k = 1""",
    "backfill_job": f"""WITH {_RAW},
existing AS (SELECT * FROM raw WHERE seq % 2 = 0),
pages AS (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw, seq % 4 ORDER BY srank, seq) AS k FROM raw WHERE seq % 2 = 1),
incoming AS (
  SELECT * EXCLUDE (k, k2) FROM (
    SELECT * REPLACE (CASE WHEN seq % 4 = 1 THEN 'blocks' ELSE 'table' END AS source, CASE WHEN seq % 4 = 1 THEN 1 ELSE 2 END AS srank),
           row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY seq % 4) AS k2 FROM pages WHERE k = 1) WHERE k2 = 1),{_KEPT},
both_rows AS (SELECT *, 0 AS batch FROM kept UNION ALL SELECT *, 1 FROM incoming)
SELECT lottery, draw, draw_date, {_N3} FROM (SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, batch, seq) AS k FROM both_rows) WHERE k = 1""",
    "gap_fill_job": f"""WITH {_RAW}, names(l, d, lottery, draw) AS (VALUES ('1-urgent', 'f', 'Urgent', 'Early'), ('1-urgent', 'o', 'Urgent', 'Late'), ('3-medium', 'p', 'Medium', 'Other')),
kept AS (
  SELECT * EXCLUDE (k) FROM (
    SELECT n.lottery, n.draw, draw_date, numbers, row_number() OVER (PARTITION BY draw_date, n.lottery, n.draw ORDER BY seq DESC) AS k
    FROM raw r JOIN names n ON lower(r.lottery) = n.l AND lower(r.draw) = n.d WHERE seq % 2 = 0) WHERE k = 1),
gaps AS (
  SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day
  EXCEPT SELECT draw_date FROM kept WHERE lottery = 'Urgent'),
found AS (
  SELECT n.lottery, n.draw, draw_date, numbers FROM (
    SELECT *, row_number() OVER (PARTITION BY draw_date, lottery, draw ORDER BY srank, seq) AS k FROM raw WHERE seq % 2 = 1) r
  JOIN names n ON lower(r.lottery) = n.l AND lower(r.draw) = n.d JOIN gaps ON day = draw_date WHERE k = 1)
SELECT lottery, draw, draw_date, {_N3} FROM (
  SELECT * FROM kept UNION ALL
  SELECT f.* FROM found f ANTI JOIN kept k ON f.lottery = k.lottery AND f.draw = k.draw AND f.draw_date = k.draw_date)""",
    "ingest_counters": f"""WITH {_HALVES},{_KEPT}, slots AS (SELECT DISTINCT draw_date, lottery, draw FROM (SELECT * FROM kept UNION ALL SELECT * FROM incoming))
SELECT (SELECT count(*) FROM slots) AS total, (SELECT count(*) FROM slots) - (SELECT count(*) FROM existing) AS new""",
    "groups_in_order": f"""WITH {_RAW} SELECT lottery, draw, CAST(row_number() OVER (ORDER BY lottery, draw) AS INTEGER) AS place FROM (SELECT DISTINCT lottery, draw FROM raw)""",
    "published_records": f"""WITH {_DRAWS} SELECT lottery, draw, strftime(draw_date, '%Y-%m-%d') AS draw_date, array_to_string(numbers, ' ') AS numbers, source FROM draws""",
    "initials": f"""WITH {_RAW} SELECT seq, CASE WHEN seq % 5 = 0 THEN 'RD' ELSE upper(left(lottery, 1) || CASE WHEN contains(lottery, ' ') THEN left(split_part(lottery, ' ', 2), 1) ELSE '' END) END AS initials FROM raw""",
    "percent_text": f"""WITH {_backtest(10)}
SELECT d.lottery, d.draw, CAST(CAST(round(round(hit / tested, 3) * 100) AS INTEGER) AS VARCHAR) || '%' AS shown
FROM (SELECT DISTINCT lottery, draw FROM draws) d LEFT JOIN (SELECT lottery, draw, count(*) AS tested, count(*) FILTER (WHERE len(hits) > 0) AS hit FROM hits GROUP BY ALL) h ON d.lottery = h.lottery AND d.draw = h.draw""",
    "slug_lookup": """SELECT page_id, CASE WHEN list_contains(regexp_split_to_array(lower(url), '[/?#]+'), 'example.org') THEN 'Org'
  WHEN list_contains(regexp_split_to_array(lower(url), '[/?#]+'), 'en') THEN 'English' WHEN list_contains(regexp_split_to_array(lower(url), '[/?#]+'), 'fr') THEN 'French'
  WHEN list_contains(regexp_split_to_array(lower(url), '[/?#]+'), 'page') THEN 'Page' WHEN contains(lower(url), 'example.org') THEN 'Org' WHEN contains(lower(url), 'en') THEN 'English'
  WHEN contains(lower(url), 'fr') THEN 'French' WHEN contains(lower(url), 'page') THEN 'Page' ELSE 'Sin nombre' END AS lottery FROM pages""",
}
