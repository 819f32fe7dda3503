"""Quality rules as a ledger of bits.

Every rule is evaluated once per document: the ledger keeps its measurements and
a bit for each rule that fails. Policies are versioned sets of rules and are
applied to the bits alone; what a rule does to a corpus (an ablation) comes from
counts of bit patterns, of which there are no more than 2 ** rules.

All is DataFrame functions on single rows, without a shuffle. Repeated windows of
three words are found by sorting a document's windows by hash; where two hashes
agree the windows themselves are compared, so a collision changes nothing.

Nulls: a null text has no words, lines or symbols and fails the rule on the
number of words, as an empty one does. Repeated rows are judged alike, and ids
don't matter. A very long text is one row's arrays, in one task; sorting makes
it n log n. A rule at its bound passes. Columns named like a measurement are replaced,
others may have any name. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """fails: a condition over the measurements."""

    name: str
    fails: str


#: A rule's place is its bit and never changes; new rules come last.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_lines > 0 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}

#: Policies by version: the rules that reject a document.
POLICIES: dict[int, tuple[str, ...]] = {
    0: ("few_words", "repeated_windows"),
    1: ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    2: tuple(BIT),
}


def mask(policy: int) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words, all longs; columns of those names are
    replaced."""
    rows = docs.select(F.struct("*").alias("row"))  # so that no name can clash
    raw = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    out = rows.withColumns({"_words": F.array_remove(F.split(raw, rf"[{SPACE}]+"), ""), "_lines": lines})
    words = F.col("_words")
    # Each step is a column of its own: an expression inside a lambda would be
    # evaluated for every element.
    out = out.withColumn("_n", F.size("_words")).withColumn(
        "_windows",
        F.when(F.col("_n") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))
        ),
    )
    out = out.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    window = lambda i: F.struct(*[F.get(words, i + k).alias(f"w{k}") for k in range(WINDOW)])
    # Only documents in which two hashes agree: the windows in order, with their places.
    out = out.withColumn("_sorted", F.when(F.col("_repeats"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), window(i).alias("w"), i.alias("at"))))))
    ordered = F.col("_sorted")
    alike = lambda x, i: (F.get(ordered, i - 1)["w"] == x["w"]) | (F.get(ordered, i + 1)["w"] == x["w"])
    out = out.withColumn("_places", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x["at"])))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words")),
        lambda acc, at: F.struct(at.alias("last"), (acc["words"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("words")),
        lambda acc: acc["words"],
    )
    figures = {
        "n_words": F.col("_n"),
        "word_chars": F.char_length(F.regexp_replace(raw, rf"[{SPACE}]+", "")),
        "n_symbols": F.char_length(F.regexp_replace(raw, r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # A generator is a border for the optimizer: a filter on a measurement would
    # otherwise be pushed below the steps, put together as one expression, and
    # evaluate them anew for every element.
    measures = F.explode(F.array(F.struct(*[of.cast("long").alias(name) for name, of in figures.items()]))).alias("measures")
    return out.select("row", measures).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in figures], "measures.*")


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with its measurements and `failures`, the bits of the rules that
    fail. Columns of those names are replaced."""
    return measured(docs, text).withColumn("failures", failure_bits())


def passes(policy: int, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame, policy: int, failures: str = "failures") -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many it
    alone rejects, that is, would be kept without it; from counts of bit patterns."""
    patterns = entries.groupBy(F.col(failures).bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy]])).alias("r")
    by = patterns.select("bits", "docs", rules).select("docs", "bits", "r.rule", "r.bit")
    return by.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("docs")).otherwise(0)).alias("rejected_alone"),
    )


def op3(docs: DataFrame, policy: int = 2) -> DataFrame:
    base = F.col("failures").bitwiseAND(F.lit(mask(0))) != 0
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes(policy).alias("kept"), "failures", F.lit(policy).alias("policy"),
    )


#: The same in SQL, the method's rules included.
OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM t),
win AS (
  SELECT r, i, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3
  FROM (SELECT r, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM w)
  WINDOW p AS (PARTITION BY r ORDER BY i)),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM win WHERE w3 IS NOT NULL),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, CAST(2 AS INTEGER) AS policy
FROM b
"""
