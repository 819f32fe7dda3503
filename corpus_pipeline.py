"""From raw documents to token ids: classify, filter, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
the first four return the columns of documents. Rows travel whole in a struct, so
that columns besides may have any name and keep their values.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tombola.llm import bpe, classifier, mixing, quality_rules, simhash
from tombola.llm.common import cut, lean_batches, table

#: The version of the quality rules' policy.
POLICY = 2


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the co-trained classifier doesn't reject."""
    lean_batches(spark)
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    read = docs.select(F.struct("*").alias("document"), "text", "lang", "source", "n_chars")
    return classifier.scored(read, model, "verdict").where("verdict.kept").select("document.*")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the policy."""
    return quality_rules.ledger(docs.select(F.struct("*").alias("document"), "text")).where(quality_rules.passes(POLICY)).select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates: five-word shingles
    at a similarity of 0.8 or more. The index links fingerprints; every link is
    counted, and links it can't see are searched for exactly."""
    lean_batches(spark)
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources to their target weights, in training order."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, tokens (little-endian unsigned 32-bit
    ids), and the digests of the ids and of what they decode to."""
    lean_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.encoded_with_digests(docs.select("doc_id", "text", "lang", "source"), path, pattern)
    return out.select("doc_id", "lang", "source", "digest.*")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("byte_level_bpe", encoding),
]

#: The first, third and fifth stage are beyond SQL; tests hold run() against
#: a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
