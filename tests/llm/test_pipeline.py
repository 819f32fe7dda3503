"""The pipeline's stages on odd rows and with columns that operators use too."""

import random

import pytest

import corpus_pipeline
from tombola.llm import bpe, classifier

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, failures string, _quality string, verdict string, _position double, document int, digest string, row string, key string, id string, one int, copies int"


def rows():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randint(3, 8)))
    base = [[word() for _ in range(rnd.randint(70, 160))] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(base[3][:-1]), " ".join([*base[4], word()])] + [None, "", "too short", "# " * 200]
    out = [(k, t, "en", f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    out += [out[5], out[5], (None, texts[6], None, None, None), (7, texts[8], "en", "s1", 1)]
    return [(*r, f"n{k}", "f", None, "v", 0.5, k, "d", "r", "k", "i", 1, 2) for k, r in enumerate(out)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    labels = [(k, 1, 0) for k in range(20)] + [(34, 0, 0), (35, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(rows(), COLUMNS).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_values(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stage(spark, docs, sf_dir)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    out, given = kept.collect(), docs.collect()
    assert out and set(out) <= set(given)
    clean = {r["doc_id"] for r in given if r["doc_id"] is not None and r["doc_id"] < 30} - {7}
    if name in ("quality_classifier", "quality_rules"):
        assert clean <= {r["doc_id"] for r in out}
    if name == "quality_rules":
        assert not {32, 33, 34, 35} & {r["doc_id"] for r in out}
    if name == "simhash_near_dedup":
        # 8 is a copy of a second row of id 7, and texts without words are one class.
        assert sorted(r["doc_id"] for r in out) == sorted([*set(range(30)) - {8}, 7, 32, 34, 35])
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} <= set(range(32)) | {None}
    own = bpe.tokenizer(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    texts = {r[0]: r[1] for r in rows() if r[0] not in (None, 7)}
    assert all(own.decode(bytes(r["tokens"])).decode() == texts[r["doc_id"]] for r in out if r["doc_id"] in texts)


def test_too_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    for labels in ([], [(1, 1)], [(1, 1), (2, 0)], [(1, 1), (2, 1), (34, 0)]):
        assert classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int")) is None
    assert classifier.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (34, 0), (35, 0)], "doc_id long, quality int")) is not None
