"""From raw documents to tokens: language ID, near-duplicate removal, secret redaction, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of documents.
Null texts and empty tables go through every stage: a null text has no letter, so language ID removes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import langid, mixing, neardup, secrets, sentencepieces
from quarrygraph.llm.common import documents, stored
from quarrygraph.llm.queries import tokenizer_file
from quarrygraph.runtime import ship

#: Words of a near-duplicate shingle and the least similarity in per cent; epochs of the most repeated source for one of the least repeated.
SHINGLE_WORDS, PERCENT, MAX_REPEATS = 5, 80, 2.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that language ID rejects go."""
    ship(spark)
    return langid.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    ship(spark)
    return neardup.keep_one(docs, SHINGLE_WORDS, PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets masked."""
    ship(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources again, up to MAX_REPEATS epochs, so that the sources' token shares are their target weights."""
    ship(spark)
    return mixing.mixture(docs, MAX_REPEATS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    ship(spark)
    return sentencepieces.round_trip(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: No SQL expresses a trained classifier, minhash links or the library's segmentation; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each stage's rows written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
