"""Near-duplicates by exact similarity of five-word shingles."""

import random

import pytest

from tombola.llm import jaccard, simhash
from tombola.llm.components import components


def plain(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_all_pairs_from_four_fifths_on_link_and_no_others(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(jaccard, "PART", 4)  # so that shingles are dealt in blocks
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for k in range(12):
        base = [word() for _ in range(rnd.choice((8, 60, 200, 700)))]
        for change in (0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            texts.append(" ".join(word() if rnd.random() < change else w for w in base))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(20 + k % 5)]) for k in range(30)]  # one common passage
    texts += [None, "", " \n", "one", "ONE", "two words", texts[0].upper()]
    sets = [plain(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))
    links = simhash.similar_links(docs)[1].collect()
    assert components(spark.createDataFrame(links, "a long, b long")).count() > 20


def test_rows_without_or_with_repeated_ids(spark):
    rows = [(3, None), (2, ""), (9, " \n"), (5, "One two"), (4, "one TWO"), (4, "one TWO"), (None, "one two"), (None, "alone and without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.one_of_each(docs).collect()) == [0, 2, 4]
    assert simhash.one_of_each(docs.where("false")).count() == 0


def families(n, seed=7):
    """Texts, and one label a class of those that are similar, by brute force."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.choice((40, 80, 160)))]
        texts += [" ".join(rnd.choice(words) if rnd.random() < 0.012 * v else w for w in base) for v in range(5)]
    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return texts, label


@pytest.fixture
def partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]

    def into(n, coalesce):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], str(coalesce).lower())

    yield into
    for n, value in zip(names, before, strict=True):
        spark.conf.set(n, value)


@pytest.mark.parametrize("n, coalesce", [(1, True), (4, False), (29, True), (29, False), (211, False)])
def test_links_do_not_depend_on_partitions(spark, partitions, n, coalesce):
    texts, label = families(30 if n < 211 else 8)
    partitions(n, coalesce)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(set(label))


@pytest.mark.parametrize("n, coalesce, rows", [(1, True, 2048), (4, False, 4), (29, False, 4), (29, False, 2048), (211, False, 2048)])
def test_fingerprints_link_alike_over_any_partitions(spark, partitions, n, coalesce, rows):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rnd.sample(range(64), k)) for f in fps[:40] for k in (1, 2, 3, 4, 6)]
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {f: low if x == high else x for f, x in label.items()}
    partitions(n, coalesce)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long"), rows=rows)
    roots = {r["node"]: r["root"] for r in components(found).collect()}
    classes, want = {}, {}
    for f in set(fps):
        classes.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
        want.setdefault(label[f], set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, want.values()))


def test_what_takes_whole_partitions_is_dealt_again_after_a_join(spark, partitions):
    partitions(7, False)
    left = spark.range(200).selectExpr("id % 20 as list", "id % 3 as x", "id % 2 as y", "id as size", "id as key", "cast('a' as binary) as bits", "id as root")
    joined = left.join(left.select("list", "x", "y").distinct(), ["list", "x", "y"])
    plan = jaccard._candidates(joined, "all")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "REPARTITION_BY_NUM" in below.split("Join")[0]
