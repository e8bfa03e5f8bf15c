"""Training-corpus pipeline: quality, language, near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrand.llm import gam, lang_crf, ngram_join, packing
from lodestrand.llm.common import fold, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more; learned from labelled ones as op10 does.

    All columns stay, whatever they are called.  A null text counts as an empty
    one, and both are scored by their (all zero) counts; a text is counted
    whole, however long; repeated rows are kept or go together; a row without
    doc_id is scored but not learned from; where there is no label every score
    is 0.5, so nothing stays; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    return gam.keep(docs, gam.train(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one known language (mean probability 0.5 or more).

    All columns stay, whatever they are called.  Null and empty texts, and those
    without a letter, go; a text is labelled whole, however long; repeated rows
    stay or go together; equal languages go to the smaller name; where no
    language is known, nothing can be rejected and all rows stay; an empty table
    stays empty.
    """
    return lang_crf.keep(docs, lang_crf.train(docs.where(fold("doc_id", 4) != 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, similarity 0.8 or more.

    All columns stay, whatever they are called.  Of a component the row of the
    smallest doc_id stays, rows without one last, and a hash of doc_id and text
    decides between rows of equal doc_id; rows that repeat both are one.  Null
    and empty texts are near nothing: each stays, once for each doc_id.  A text
    is compared whole, however long; an empty table stays empty.
    """
    return ngram_join.keep_one(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, a row each: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    The last stage: of the columns of documents doc_id stays, null where it was
    null.  A null text is an empty one, of which the end id is packed; a text is
    packed whole, however long; each of repeated rows is packed; an empty table
    gives no piece.
    """
    return packing.described(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality classifier", quality), ("language ID", language), ("n-gram Jaccard join", near_copies), ("packing", packed)]

#: The classifiers are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what they write between them lies in the shared folder until
    lodestrand.llm.common.clear_scratch() removes it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
