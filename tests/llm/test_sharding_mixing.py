"""Sharding and mixing on small tables, and whole queries by brute force."""

import os
import re
import zlib

import pytest

from tombola.llm import mixing, queries, sharding

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", None, 0), (2, "", None, "a", None), (3, "x y z", "en", "b", 3), (3, "x y z", "en", "b", 3), (None, "é " * 5000, "en", "b", 1), (4, "same", "en", "a", 4), (5, "same", "en", "", 4)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def levels(sizes, share=1.5, most=2):
    """Targets by resharing until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, free = share * sum(sizes.values()), set(names)
    while True:
        rest = budget - sum(most * sizes[s] for s in names if s not in free)
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: level * weight[s] if s in free else most * sizes[s] for s in names}
        free -= over


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_op1_whole_table(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_mixing"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, taken = {}, {}
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    target = levels(sizes)
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(target[source])
    assert all(abs(taken[s] - target[s]) < 1.001 for s in sizes)
    order = [r["position"] for r in rows if r["position"] is not None]
    assert order == sorted(order)
    again = queries.QUERIES["op1_mixing"](spark, DATA).collect()
    assert {(r["doc_id"], r["taken"], r["position"]) for r in rows} == {(r["doc_id"], r["taken"], r["position"]) for r in again}


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {(r["source"], r["source_size"]) for r in rows} == {(None, 0), ("a", 1), ("b", 5004), ("", 1)}
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows if r["source"] == "b") == int(next(r["target"] for r in rows if r["source"] == "b"))
    assert mixing.op1(odd(spark).where("false")).count() == 0


def test_mixed_documents_keep_their_columns(spark):
    docs = odd(spark).withColumnRenamed("n_chars", "passes")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.where("doc_id IS NULL").count() >= 1
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def made(spark):
    """Repeated ids within and across sources, null ids, whole rows repeated, and
    columns with names that the operators use."""
    rows = [(7, "a b c", "x", 1.0), (7, "a b c", "y", 1.0), (7, "d e f", "x", 2.0), (7, "d e f g h", "y", 3.0), (None, "i j", "x", 1.0), (None, "k l", "x", 1.0)]
    rows += [(None, "m n o", "z", 1.0)] * 40 + [(8, "m n o", "z", float(k)) for k in range(20)] + [(9 + k, f"w{k} v u t", "xyz"[k % 3], 0.5) for k in range(30)]
    rows += [(100, None, "x", 0.0), (101, "", None, 0.0)]
    return spark.createDataFrame([(*r, "c", k % 2) for k, r in enumerate(rows)], "doc_id long, text string, source string, _position double, copies string, one int")


@pytest.mark.parametrize("share", [0.5, 1.5])
def test_mixed_documents_take_what_the_mix_takes(spark, share, monkeypatch):
    monkeypatch.setattr(mixing, "COPY_RUN", 7)
    docs = made(spark)
    plan = mixing.mix(docs, share=share).collect()
    out = mixing.mixed_documents(docs, share=share)
    assert out.columns == docs.columns
    rows = out.collect()
    assert set(rows) <= set(docs.collect())
    size = lambda t: len(WORD.findall(t or ""))
    for s in ("x", "y", "z", None):
        taken = sum(r["taken"] for r in plan if r["source"] == s)
        most = max(r["size"] for r in plan if r["source"] == s)
        assert abs(sum(size(r["text"]) for r in rows if r["source"] == s) - taken) <= most
        assert abs(taken - next(r["target"] for r in plan if r["source"] == s)) < 1
    want = sorted((r[0] or 0, r["source"] or "", r["size"]) for r in plan for p in r["passes"] if 2 * p["words"] >= r["size"])
    assert sorted((r[0] or 0, r["source"] or "", size(r["text"])) for r in rows) == want
    assert max(rows.count(r) for r in set(rows)) <= 2 * 40


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:03d}": (k * 37) % 101 for k in range(150)} | {None: 9}
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    want = levels(sizes)
    for r in mixing.mix(docs).collect():
        assert r["target"] == pytest.approx(want[r["source"]])


def test_inverted_demand(spark):
    """The numerically integrated schedule reaches each share where invert says."""
    from pyspark.sql import functions as F

    plan = mixing.THREE_ONE_TWO
    rows = spark.range(0, 11).select(*[plan.invert(F.lit(k), F.col("id") / 10).alias(f"k{k}") for k in range(3)]).collect()
    for k, w in enumerate(plan.weights):
        at = lambda t: w[0] + (w[1] - w[0]) * t * 2 if t < 0.5 else w[1] + (w[2] - w[1]) * (t - 0.5) * 2  # noqa: B023, E731
        for n, r in enumerate(rows):
            steps = 2000
            area = sum(at((j + 0.5) / steps * r[f"k{k}"]) for j in range(steps)) / steps * r[f"k{k}"]
            assert area / plan.integral(k) == pytest.approx(n / 10, abs=1e-4)
    assert [plan.integral(k) for k in range(3)] == [3, 1, 2]
    zero = mixing.Curriculum(((0.0, 2.0), (1.0, 0.0)))
    assert spark.range(1).select(zero.invert(F.lit(0), F.lit(0.0)), zero.invert(F.lit(1), F.lit(1.0))).head()[:] == (0.0, 1.0)
    with pytest.raises(ValueError):
        mixing.Curriculum(((1.0,),))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_op2_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_sharding"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    total, places = [0] * 16, [[] for _ in range(16)]
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(total) - min(total) <= max(r["size"] for r in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places)


def test_shards_of_odd_rows(spark):
    rows = sharding.op2(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["size"], by[1]["text_crc32"]) == (1, 0) and by[None]["size"] == 15001
    assert sharding.op2(odd(spark).where("false")).count() == 0


def test_shards_are_even_where_ids_repeat_or_are_null(spark):
    rows = [(None, f"text {k:05d}") for k in range(2000)] + [(5, "copy")] * 3000 + [(6, f"t{k}") for k in range(1000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, shard int, slot int, virtual_slot int")
    out = sharding.op2(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == sorted((i or 0, len(t) + 1) for i, t in rows)
    total, places = [0] * 16, [[] for _ in range(16)]
    for r in out:
        total[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert max(total) - min(total) <= 11
    assert all(sorted(p) == list(range(len(p))) for p in places) and {r["map_version"] for r in out} == {1}


def test_rebalance_moves_few_slots_and_evens_loads():
    load = {s: 100 + s % 7 for s in range(4096)}
    one = sharding.rebalance(sharding.even_map(16), load)
    grown = sharding.rebalance(one, load, 17)
    shares = [sum(load[s] for s, k in enumerate(grown.shard_of) if k == shard) for shard in range(17)]
    assert max(shares) - min(shares) <= 110
    assert len(grown.moved(one)) <= 1.5 * 4096 / 17  # a 17th has to move
    shrunk = sharding.rebalance(grown, load, 8)
    assert set(shrunk.shard_of) == set(range(8)) and shrunk.version == 3
    hot = sharding.rebalance(sharding.even_map(4, 64), {5: 10_000, **{s: 1 for s in range(6, 64)}})
    assert len({hot.shard_of[s] for s in range(6, 64)} - {hot.shard_of[5]}) == 3
    assert sharding.rebalance(sharding.even_map(4), {}).shard_of == sharding.even_map(4).shard_of


def test_map_versions_are_stored(spark, tmp_path):
    path = str(tmp_path / "maps")
    first = sharding.even_map(4, 64)
    second = sharding.rebalance(first, {s: s for s in range(64)})
    sharding.store_map(spark, first, path)
    sharding.store_map(spark, second, path)
    assert sharding.load_map(spark, path) == second and sharding.load_map(spark, path, 0) == first


def test_a_stored_map_is_edited_and_few_rows_move(spark, tmp_path):
    maps = f"file://{tmp_path}/maps"
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(20 + id % 50 as int)) as text", "'en' as lang", "'s' as source", "1L as n_chars")
    first = {r["doc_id"]: r for r in sharding.op2(docs.where("doc_id < 5000"), maps).collect()}
    grown = {r["doc_id"]: r for r in sharding.op2(docs, maps).collect()}
    assert {r["map_version"] for r in first.values()} == {1} and {r["map_version"] for r in grown.values()} == {2}
    assert sharding.load_map(spark, maps, 1).moved(sharding.load_map(spark, maps))
    assert all(first[k]["virtual_slot"] == grown[k]["virtual_slot"] for k in first)
    moved = sum(first[k]["shard"] != grown[k]["shard"] for k in first)
    assert 0 < moved < 0.1 * len(first)
    for rows in (first, grown):
        held = {}
        for r in rows.values():
            held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
        assert len(held) == 16 and max(held.values()) < 1.02 * min(held.values())
    again = {r["doc_id"]: r["shard"] for r in sharding.op2(docs, maps).collect()}
    assert again == {k: r["shard"] for k, r in grown.items()}
