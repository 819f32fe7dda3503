"""The operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, html_text, importance, licenses, mixing, quality_rules, sharding, simhash, urls, vectors, whitening
from .common import lean_batches, table


def _over(operator: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lean_batches(spark)
        return operator(*[table(spark, sf_dir, name) for name in names])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": _over(mixing.op1, "documents"),
    "op2_sharding": _over(sharding.op2, "documents"),
    "op3_rules": _over(quality_rules.op3, "documents"),
    "op4_licenses": _over(licenses.op4, "documents"),
    "op5_classifier": _over(classifier.op5, "documents", "labels"),
    "op6_urls": _over(urls.op6, "pages"),
    "op7_html": _over(html_text.op7, "pages"),
    "op8_ann": _over(vectors.op8, "embeddings"),
    "op9_simhash": _over(simhash.op9, "documents"),
    "op10_bpe": _over(bpe.op10, "documents"),
    "op11_resampling": _over(importance.op11, "documents", "benchmark"),
    "op12_whitening": _over(whitening.op12, "embeddings"),
    "op13_chat": _over(chat.op13, "conversations"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_rules": quality_rules.OP3_SQL,
    "op6_urls": urls.OP6_SQL,
    "op11_resampling": importance.OP11_SQL,
    "op13_chat": chat.OP13_SQL,
}
