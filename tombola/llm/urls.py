"""URL filter by the ratio of two character language models.

Rules name hosts and paths to allow or to block. URLs that a rule decides are the
examples: of accepted and of rejected URLs, character models of variable order
are counted over all of them. A model's probability of a character after those
before it blends the counts of contexts of up to ORDER characters, each longer
one weighing as much as it has seen (Witten and Bell). A context takes part from
SUPPORT occurrences on, so the more examples there are, the longer are the
contexts that count. A URL's score is the difference of its log-likelihoods
under both, divided by its length; URLs at or above a threshold, calibrated on
the examples, are allowed.

Everything is DataFrame functions. Characters are taken as they are. The models
grow with the corpus: grams are counted by partial aggregates, and are joined
with the URLs by a broadcast only if a count shows them to be few, otherwise by
a shuffle that AQE can split.

Nulls: a null URL, or one without `://`, has an empty host and path; the model
judges the empty text, which is its end mark only. Repeated rows are judged
each for itself, and rows may repeat or lack ids. A very long URL is read whole,
in linear time. A score equal to the threshold allows; of rules of equal length
the first fits. If there are no examples of either kind, the threshold is 0 and
so is every score: all are allowed. Only id and url are read, so other columns
may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, small

#: Characters of context at most, and how often a context has to occur.
ORDER, SUPPORT = 5, 4
#: What stands before a URL's first character and after its last.
BEFORE, END = "\u0002", "\u0003"
#: Up to so many grams (some 60 bytes each) are broadcast, beyond they are joined.
BROADCAST_GRAMS = 200_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query op6.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.when(rest, ascii_lower(F.regexp_extract(after, r"^([^/?#]*)", 1))).otherwise(F.lit(""))
    path = F.when(rest, F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)?", 1)).otherwise(F.lit(""))
    return host, path


def decide(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and as verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    name = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.host + r.path)) for r in ordered])
    verdict = F.coalesce(*[F.when(r.fits(host, path), F.lit(r.verdict)) for r in ordered])
    return name, verdict


def characters(host: Column, path: Column) -> Column:
    """Host and path in ASCII lower case, marked at the end, with the context of
    the first character before it; as an array of characters."""
    text = F.concat(F.lit(BEFORE * ORDER), ascii_lower(F.concat(host, path)), F.lit(END))
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def grams(rows: DataFrame, *kept: str, chars: str = "chars") -> DataFrame:
    """One row a character: it and the ORDER characters before it. (`chars` is
    named twice, so the optimizer leaves it a column of its own.)"""
    at = F.sequence(F.lit(1), F.size(chars) - ORDER)
    return rows.select(*kept, F.explode(F.transform(at, lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))).alias("gram"))


def counted(rows: DataFrame, accepted: str = "accepted") -> DataFrame:
    """gram, yes, no: all grams of all URLs, and how often accepted and rejected
    examples have them."""
    each = grams(rows, accepted)
    return each.groupBy("gram").agg(F.count_if(F.col(accepted)).alias("yes"), F.count_if(~F.col(accepted)).alias("no"))


def models(counts: DataFrame) -> DataFrame:
    """gram, ratio: for each gram of `counts` the difference of the log
    probabilities of its last character under the two models, in millionths (so
    that sums don't depend on their order)."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("level")
    shorter = F.expr("right(gram, level + 1)")
    met = counts.where("yes + no > 0").select("gram", "yes", "no", levels).groupBy("level", shorter.alias("tail")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    met = cut(met)
    context = F.expr("substring(tail, 1, level)")
    seen = met.groupBy("level", context.alias("context")).agg(
        F.sum("yes").alias("all_yes"), F.count_if(F.col("yes") > 0).alias("kinds_yes"), F.sum("no").alias("all_no"), F.count_if(F.col("no") > 0).alias("kinds_no")
    )
    seen = cut(seen.where((F.col("level") == 0) | (F.col("all_yes") + F.col("all_no") >= SUPPORT)))
    alphabet, yes, no = met.where("level = 0").agg(F.count("*"), F.sum("yes"), F.sum("no")).head()
    if not yes or not no:
        return counts.select("gram", F.lit(0).cast("long").alias("ratio"))
    each = counts.select("gram", levels).withColumn("tail", shorter).withColumn("context", context)
    met, seen = small(met, BROADCAST_GRAMS).withColumnRenamed("level", "met_level"), small(seen, BROADCAST_GRAMS).withColumnRenamed("level", "seen_level")
    each = each.join(seen.withColumnRenamed("context", "of_context"), (F.col("level") == F.col("seen_level")) & (F.col("context") == F.col("of_context")), "left")
    each = each.join(met.withColumnRenamed("tail", "of_tail"), (F.col("level") == F.col("met_level")) & (F.col("tail") == F.col("of_tail")), "left")
    parts = {}
    for kind in ("yes", "no"):
        every = F.col(f"all_{kind}") + F.col(f"kinds_{kind}")
        parts[f"own_{kind}"] = F.coalesce(F.try_divide(F.coalesce(F.col(kind), F.lit(0)).cast("double"), every), F.lit(0.0))
        parts[f"rest_{kind}"] = F.coalesce(F.try_divide(F.col(f"kinds_{kind}").cast("double"), every), F.lit(1.0))
    each = each.select("gram", "level", *[of.alias(name) for name, of in parts.items()])
    by = each.groupBy("gram").agg(*[F.max(F.when(F.col("level") == k, F.col(name))).alias(f"{name}_{k}") for name in parts for k in range(ORDER + 1)])
    logs = []
    for kind in ("yes", "no"):
        p = F.lit(1.0 / (alphabet + 1))
        for k in range(ORDER + 1):
            p = F.col(f"own_{kind}_{k}") + F.col(f"rest_{kind}_{k}") * p
        logs.append(F.log(p))
    return by.select("gram", F.round((logs[0] - logs[1]) * 1e6).cast("long").alias("ratio"))


def scores(rows: DataFrame, model: DataFrame) -> DataFrame:
    """row, score: the mean ratio of a row's characters."""
    by = grams(rows, "row").join(small(model, BROADCAST_GRAMS), "gram")
    return by.groupBy("row").agg((F.sum("ratio") / 1e6 / F.count("*")).alias("score"))


def calibrated(scored: DataFrame, accepted: str = "accepted") -> DataFrame:
    """One row: the threshold that decides most of the examples as their rules
    do, accepted and rejected ones counting alike; the lowest of the best. It lies
    halfway between the least score it accepts and the next one below, for what
    the models haven't seen scores less clearly. It is chosen among bins of
    scores, so the sort is over a bounded number of rows."""
    bins = scored.where(F.col(accepted).isNotNull()).groupBy(F.round("score", 3).alias("bin")).agg(F.count_if(F.col(accepted)).alias("good"), F.count_if(~F.col(accepted)).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    kept = F.sum("good").over(everything) - F.coalesce(F.sum("good").over(below), F.lit(0))
    out = F.coalesce(F.sum("bad").over(below), F.lit(0))
    right = F.expr("1.0d") * F.coalesce(F.try_divide(kept, F.sum("good").over(everything)), F.lit(0.0)) + F.coalesce(F.try_divide(out, F.sum("bad").over(everything)), F.lit(0.0))
    lower = F.coalesce(F.lag("bin").over(Window.orderBy("bin")), F.col("bin") - 0.001)
    best = bins.select("bin", lower.alias("lower"), right.alias("right")).agg(F.max_by(F.struct("bin", "lower"), F.struct("right", -F.col("bin"))).alias("best"))
    return best.select(F.coalesce((F.col("best.bin") + F.col("best.lower")) / 2, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score: of every row."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = decide(F.col("host"), F.col("path"), rules)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "*", name.alias("rule"), verdict.alias("ruled"))
    # Written, so that a row's number stays.
    rows = cut(rows.withColumn("accepted", F.col("ruled") == "allow"))
    read = rows.select("row", "accepted", characters(F.col("host"), F.col("path")).alias("chars"))
    model = cut(models(cut(counted(read))))
    scored = cut(rows.join(scores(read, model), "row"))
    threshold = calibrated(scored).head()[0]
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")


def op6(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _sql() -> str:
    levels = range(ORDER + 1)

    def p(kind: str) -> str:
        out = "1e0 / (alphabet + 1)"
        for k in levels:
            out = f"own_{kind}_{k} + rest_{kind}_{k} * ({out})"
        return out

    parts = ", ".join(f"max(CASE WHEN level = {k} THEN {x}_{kind} END) AS {x}_{kind}_{k}" for kind in ("yes", "no") for x in ("own", "rest") for k in levels)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) END AS rest FROM pages),
v AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path, row_number() OVER () AS r
  FROM u),
x AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
         repeat(chr(2), {ORDER}) || host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(3) AS chars
  FROM v),
y AS (SELECT *, CASE WHEN rule IN ('com/fr/', 'org/') THEN true WHEN rule IS NOT NULL THEN false END AS accepted FROM x),
grams AS (SELECT r, accepted, substr(chars, CAST(i AS INTEGER), {ORDER + 1}) AS gram FROM (SELECT r, accepted, chars, unnest(generate_series(1, length(chars) - {ORDER})) AS i FROM y)),
counts AS (SELECT gram, count(*) FILTER (WHERE accepted) AS yes, count(*) FILTER (WHERE NOT accepted) AS no FROM grams GROUP BY ALL),
lv AS (SELECT unnest(generate_series(0, {ORDER})) AS level),
met AS (
  SELECT level, right(gram, level + 1) AS tail, CAST(sum(yes) AS BIGINT) AS yes, CAST(sum(no) AS BIGINT) AS no
  FROM counts, lv WHERE yes + no > 0 GROUP BY ALL),
seen AS (
  SELECT level, substr(tail, 1, CAST(level AS INTEGER)) AS context, CAST(sum(yes) AS BIGINT) AS all_yes, count(*) FILTER (WHERE yes > 0) AS kinds_yes,
         CAST(sum(no) AS BIGINT) AS all_no, count(*) FILTER (WHERE no > 0) AS kinds_no
  FROM met GROUP BY ALL HAVING level = 0 OR CAST(sum(yes) + sum(no) AS BIGINT) >= {SUPPORT}),
whole AS (SELECT count(*) AS alphabet, sum(yes) AS whole_yes, sum(no) AS whole_no FROM met WHERE level = 0),
parts AS (
  SELECT c.gram, lv.level,
         coalesce(CAST(coalesce(m.yes, 0) AS DOUBLE) / nullif(s.all_yes + s.kinds_yes, 0), 0e0) AS own_yes,
         coalesce(CAST(s.kinds_yes AS DOUBLE) / nullif(s.all_yes + s.kinds_yes, 0), 1e0) AS rest_yes,
         coalesce(CAST(coalesce(m.no, 0) AS DOUBLE) / nullif(s.all_no + s.kinds_no, 0), 0e0) AS own_no,
         coalesce(CAST(s.kinds_no AS DOUBLE) / nullif(s.all_no + s.kinds_no, 0), 1e0) AS rest_no
  FROM counts c CROSS JOIN lv
  LEFT JOIN seen s ON s.level = lv.level AND s.context = substr(right(c.gram, lv.level + 1), 1, CAST(lv.level AS INTEGER))
  LEFT JOIN met m ON m.level = lv.level AND m.tail = right(c.gram, lv.level + 1)),
pivoted AS (SELECT gram, {parts} FROM parts GROUP BY gram),
model AS (
  SELECT gram, CASE WHEN whole_yes > 0 AND whole_no > 0 THEN CAST(round((ln({p("yes")}) - ln({p("no")})) * 1e6) AS BIGINT) ELSE 0 END AS ratio
  FROM pivoted, whole),
scored AS (SELECT g.r, CAST(sum(m.ratio) AS BIGINT) / 1e6 / count(*) AS score FROM grams g JOIN model m ON m.gram = g.gram GROUP BY g.r),
z AS (SELECT y.*, s.score FROM y JOIN scored s ON s.r = y.r),
bins AS (SELECT round(score, 3) AS bin, count(*) FILTER (WHERE accepted) AS good, count(*) FILTER (WHERE NOT accepted) AS bad FROM z WHERE accepted IS NOT NULL GROUP BY ALL),
sides AS (
  SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), bin - 0.001e0) AS lower,
         coalesce((sum(good) OVER () - coalesce(sum(good) OVER below, 0)) / nullif(sum(good) OVER (), 0), 0)
           + coalesce(coalesce(sum(bad) OVER below, 0) / nullif(sum(bad) OVER (), 0), 0) AS correct
  FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
threshold AS (SELECT coalesce((SELECT (bin + lower) / 2 FROM sides ORDER BY correct DESC, bin LIMIT 1), 0e0) AS cutoff)
SELECT page_id, host, path, rule,
       CASE WHEN accepted THEN 'allow' WHEN NOT accepted THEN 'block' WHEN score >= (SELECT cutoff FROM threshold) THEN 'allow' ELSE 'block' END AS verdict, score
FROM z
"""


#: op6 in SQL: rules, models, scores and threshold.
OP6_SQL = _sql()
