"""The queries of this package, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, gam, lang_crf, lm, ngram_join, packing, quality_rules, runs, substrings, vector_codes, warc
from .common import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back."""
    return chat.digests(chat.with_injection(table(spark, sf_dir, "conversations")))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the training documents."""
    return lm.score_all(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into pieces of power-of-two lengths."""
    return packing.described(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, then read back."""
    return warc.described(table(spark, sf_dir, "pages"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted and judged by how a public vocabulary knows it."""
    second = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return quality_rules.rate(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), second)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents.lang."""
    return lang_crf.identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of labels.quality."""
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without words of passages that also start earlier."""
    return substrings.described(substrings.dedupe(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a code of 16 parts, with its error and its label's."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, a tenth of the documents made to repeat, and its text without the repetitions."""
    return runs.described(runs.find(runs.with_loops(table(spark, sf_dir, "documents"))))


OPERATORS = (op1_nearest, op2_chat_formatting, op3_lm_scoring, op4_packing, op5_warc, op6_ngram_join, op7_quality_rules, op8_language_id, op9_bpe, op10_quality_classifier, op11_substrings, op12_vector_codes, op13_periodic_runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op11_substrings": substrings.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_periodic_runs": runs.ORACLE_SQL}
