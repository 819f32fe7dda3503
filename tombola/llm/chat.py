r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only its text is trained on. A conversation that doesn't end with an
assistant turn has one more example, all context, so that the examples hold every
turn.

Template. A turn is <s>, its role, [INST], its text, and what ends it: </s> after
an assistant turn, [/INST] after any other. So those four are control strings. Where
a role or a text holds one, a backslash goes behind its first character (<\s>,
[\/INST]); where it holds one that is so changed already, it gets one backslash
more. Reading back takes one away, which gives the very text again.

A conversation's turns are brought together once, in one task (its digest is over all
of them); its examples are generated there one by one and read back without another
shuffle. What an example repeats is its context: for a conversation of n turns the
method's output grows with the square of n.

Nulls: a null text or role is empty; a null turn comes after all others; rows of
a null conversation are one conversation. Ties in turn go by role, then text.
Repeated rows are turns of their own. Empty and very long texts are turns like
any others. Only the four columns are read, so others may have any name. An
empty table has no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings: before a role, before a text, after a text.
OPEN, HEAD_END, END, REPLY_END = "<s>", "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"

#: A control string's first character and the rest, with any backslashes between.
_FIRST, _REST = r"([<\[])", r"(\\*/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\" + _REST, "$1$2")


def examples(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, example (from 0), formatted, loss_start (from 0) and loss_length, in
    code points of `formatted` (null and 0 where nothing is trained on), and
    whether it is the conversation's last."""
    say = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    said = F.struct(F.col(f"`{turn}`").isNull().alias("late"), F.col(f"`{turn}`").alias("turn"), say(role).alias("role"), say(text).alias("text"))
    whole = rows.groupBy(F.col(f"`{conv}`").alias("conv")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    trained = lambda t: t["role"] == TRAINED
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(HEAD_END), escaped(t["text"]), F.when(trained(t), REPLY_END).otherwise(END)))
    # The turns that end an example: every assistant turn, and the last of all.
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: trained(F.get("turns", k - 1)) | (k == F.size("turns")))
    whole = whole.select("conv", F.size("turns").alias("size"), written.alias("written"), F.transform("turns", trained).alias("trains"), F.posexplode(ends).alias("example", "end"))
    formatted = F.array_join(F.slice("written", F.lit(1), F.col("end")), "").alias("formatted")
    head = F.lit(len(OPEN + TRAINED + HEAD_END))
    last = F.length(F.get("written", F.col("end") - 1))
    length = F.when(F.get("trains", F.col("end") - 1), last - head - len(REPLY_END)).otherwise(0)
    each = whole.select("conv", "example", formatted, F.get("trains", F.col("end") - 1).alias("train"), last.alias("last"), length.alias("loss_length"), (F.col("end") == F.col("size")).alias("whole"))
    start = F.when(F.col("train"), F.length("formatted") - F.col("last") + head)
    return each.select(F.col("conv").alias(conv), "example", "formatted", start.alias("loss_start"), "loss_length", "whole")


def _halves(turn: Column) -> Column:
    return F.split(turn, r"\[INST\]", 2)


def turns_of(formatted: Column) -> Column:
    """An example's turns (role and text), read back."""
    parts = F.split(formatted, r"\[/INST\]|</s>")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # nothing follows the last end
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.substring(F.get(_halves(p), F.lit(0)), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescaped(F.get(_halves(p), F.lit(1))).alias("text"),
        ),
    )


def loss_of(example: DataFrame) -> Column:
    """The text under an example's mask, read back; empty where there is none."""
    return F.coalesce(unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))), F.lit(""))


def read_back(made: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation: what its examples say of its turns, and of what is
    trained on."""
    turns = turns_of(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(
        F.col(f"`{conv}`").alias("conv"), "example", loss_of(made).alias("loss"), F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("whole"), F.size(F.split("formatted", r"\[/INST\]|</s>")) - 1).cast("long").alias("n_turns"), F.when(F.col("whole"), F.sha2(said, 256)).alias("turns_sha256"),
    )
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    by = read.groupBy("conv").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return by.select(
        F.col("conv").alias(conv), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation whose texts are made of control strings.
HARD = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13(conversations: DataFrame) -> DataFrame:
    """All conversations and the hard one."""
    hard = conversations.sparkSession.createDataFrame(HARD, "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(hard)
    return read_back(examples(rows))


#: The same from the rows themselves.
OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
         sum(9 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
             + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END) OVER (o ROWS UNBOUNDED PRECEDING) AS so_far
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR k = turns) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
