"""The queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import oracles
from quarrygraph.llm.common import documents, pages
from quarrygraph.runtime import shipped


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import secrets

    return secrets.scan(documents(spark, sf_dir)).filter("is_secret")


def op2_htmlcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import htmlcut

    return htmlcut.main_text(pages(spark, sf_dir))


def op3_chunkdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import chunkdedup

    return chunkdedup.repeated_passages(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import sentencepieces

    return sentencepieces.round_trip(documents(spark, sf_dir), tokenizer_file())


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import media

    return media.text_media(documents(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import langid

    return langid.identify(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import mixing

    return mixing.mix(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.assess(documents(spark, sf_dir), quality.trusted_documents(labels))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import neardup

    return neardup.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import licenses

    return licenses.scan(documents(spark, sf_dir)).drop("places")


def op11_urlmarkov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import urlmarkov

    return urlmarkov.judge(pages(spark, sf_dir))


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import filteraudit

    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrygraph.llm import divergence

    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: shipped(f) for f in (op1_secrets, op2_htmlcut, op3_chunkdedup, op4_sentencepiece, op5_media, op6_langid, op7_mixing, op8_quality, op9_neardup, op10_licenses, op11_urlmarkov, op12_filteraudit, op13_divergence)
}

#: No SQL expresses the other operators' rows; tests hold them against brute force, exact round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op12_filteraudit": oracles.AUDIT, "op13_divergence": oracles.DIVERGENCE}
