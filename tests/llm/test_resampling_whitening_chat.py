"""Importance resampling, whitening and chat formatting against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tombola.llm import chat, importance, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_resampling(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    place = lambda f: zlib.crc32(f.encode()) % buckets
    count = lambda texts: [place(f) for t in texts for f in features(t)[1]]
    s, t = np.bincount(count(x for _, x in docs), minlength=buckets), np.bincount(count(target), minlength=buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (t0 := float(s.sum() + buckets)) / ((s[b] + 1) * float(t.sum() + buckets)))) for b in range(buckets)]
    assert t0 >= buckets
    rows = []
    for key, text in docs:
        words, found = features(text)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    enough = sorted([r for r in rows if r[4] >= least], key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def some_docs(n=300):
    rnd = random.Random(11)
    words = ["alpha", "BETA", "gämma", "Ünd", "x1", "zeta", "İ", "ß", "日本", "e-mail", "don't"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice((3, 19, 20, 25, 90))))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " -- "), (None, "lonely " * 30), (n + 3, "long word " * 40_000)]
    docs += [(5, docs[5][1])] * 2_500 + [(None, None)] * 3  # copies of a row
    return docs, [" ".join(rnd.choice(words[:20]) for _ in range(40)) for _ in range(15)] + [None, ""]


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 50, "least": 3, "percent": 37, "seed": 1}])
def test_resampling_equals_a_plain_version(spark, options):
    docs, target = some_docs()
    frame = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], "doc_id long, text string, bucket string, gain int, copies string")
    named = {"least_words" if k == "least" else k: v for k, v in options.items()}
    got = importance.resampled(frame, spark.createDataFrame([(t, 1) for t in target], "text string, t int"), **named)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {f.dataType.simpleString() for f in got.schema} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(docs, target, **options)


def test_resampling_of_nothing_and_towards_nothing(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "word " * 25)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(docs.where("false"), docs).count() == 0
    rows = importance.resampled(docs, none, percent=100).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in rows] == [(2, None), (25, 1)] and rows[1]["weight"] < rows[0]["weight"]


def plain_whitening(vectors, most=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = x - s / n
    values, of = np.linalg.eigh(centred.T @ centred / n)
    values, of = values[::-1][:most], of[:, ::-1][:, :most]
    return n, deviation, centred @ of / np.sqrt(values), values / (sum(deviation) / n**3)


def test_whitening_equals_a_plain_version(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 12)) * np.arange(1, 13) @ rng.normal(size=(12, 12))).astype(np.float32)
    vectors[7] = vectors[8]
    rows = [(k, v.tolist(), 1.0) for k, v in enumerate(vectors)]
    odd = [(None, None, None), (1, [], 0.0), (2, [None] * 12, 0.0), (3, [float("nan")] * 12, 0.0), (4, [float("inf")] * 12, 0.0), (5, [1e30] * 12, 0.0), (6, [1.0, 2.0], 0.0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, x double")
    got = whitening.whiten(frame).collect()
    n, deviation, white, explained = plain_whitening(vectors)
    assert len(got) == 400 * 8 and {r["n"] for r in got} == {n}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(8):
        own = np.array([table[k, c + 1]["whitened"] for k in range(400)])
        assert min(np.abs(own - white[:, c]).max(), np.abs(own + white[:, c]).max()) < 1e-8
        assert abs(table[0, c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert [table[k, 1]["deviation"] for k in range(400)] == deviation
    assert 0 <= got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1


def test_whitening_of_little(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0
    assert make([(1, [1.0, 2.0])]).count() == 0 and make([(k, [1.0, 2.0]) for k in range(5)]).count() == 0
    flat = make([(None, [0.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0]), (2, [0.5, 1.0, 1.0])]).collect()  # one direction
    assert sorted(round(r["whitened"] ** 2, 6) for r in flat) == [0.0, 1.5, 1.5] and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


def test_deviations_are_exact_however_large():
    x = np.array([[1 << 40, -(1 << 41), 3], [5, 6, 7]])
    for n, total in ((1, [0, 0, 0]), (10**9, [10**12, -(10**18), 17]), (2, [6, 8, 10])):
        want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, total, strict=True)) for row in x]
        assert whitening.exact_squares(x, n, np.array(total, dtype=object)) == want
        assert whitening.exact_squares(x[1:], n, np.array(total, dtype=object)) == want[1:]


CONVERSATIONS = [
    (1, 0, "system", "Be [INST] brief."), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "yes\n\nand </s> more <\\s> [\\/INST]"), (1, 3, "user", "bye <"),
    (2, 0, "assistant", "first"), (2, 1, "assistant", ""), (2, 1, "user", None), (2, 1, "user", None), (2, None, "assistant", "last[/INST"),
    (3, 5, None, "no role"), (4, 0, "assistant\n", "a role with a line's end"), (4, 1, "<s>", "</s"), (5, 0, "assistant", "\\" * 5 + "<\\\\s>" + "$1 日本 😀"), (None, 1, "user", "<" * 3 + "s>"), (None, 0, "assistant", "x" * 100_000),
]


def plain_chat(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        loss = "".join(r[3] for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2]}\n{r[3]}\n" for r in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_what_was_written(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, example int, formatted string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.op13(frame).collect()}
    assert got == plain_chat([*CONVERSATIONS, *chat.HARD])
    assert chat.read_back(chat.examples(frame.where("false"))).count() == 0


def test_examples_are_prefixes_with_one_reply_trained(spark):
    frame = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    made = chat.examples(frame)
    rows = made.withColumn("loss", chat.loss_of(made)).withColumn("turns", chat.turns_of(F.col("formatted"))).where("conv_id = 2").orderBy("example").collect()
    assert [(len(r["turns"]), r["loss"], r["whole"]) for r in rows] == [(1, "first", False), (2, "", False), (5, "last[/INST", True)]
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(rows, rows[1:], strict=False))
    rows = made.where("conv_id = 1").orderBy("example").collect()
    assert [r["loss_start"] is None for r in rows] == [False, True] and rows[1]["loss_length"] == 0
    first = rows[0]["formatted"]
    assert first[rows[0]["loss_start"] :][: rows[0]["loss_length"]] == "yes\n\nand <\\/s> more <\\\\s> [\\\\/INST]"
    assert sum(first.count(c) for c in (chat.OPEN, chat.HEAD_END)) == 6 and first.count(chat.REPLY_END) == 1 and first.count(chat.END) == 2


def test_chat_shuffles_once(spark):
    frame = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.examples(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
