"""A corpus pipeline: each stage works on all documents that the one before kept, and its decisions take effect.

Stages take (spark, docs, sf_dir) and return the columns of documents, the last one the packed pieces. Between stages the
documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import decontaminate, minhash, packing, repeats, site_quality
from wayfare.llm.common import cut, discard, table

#: Near-duplicates share 80 percent of their shingles or more.
NEAR_PERCENT = 80
#: A repeated passage has so many words, and at least so many bytes: letters and the blanks between them.
PASSAGE_WORDS = 51
PASSAGE_BYTES = 2 * PASSAGE_WORDS - 1

#: Learned weights, minima and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (of low quality or toxic) go; repeated rows are judged alike.

    A text that is null, empty or without words is judged by its measures like any other, a null source is a site of its
    own. Without labels all stay; no rows give none; columns of any names pass through.
    """
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, of repeated rows one.

    Rows without an id or without words are in no group and stay, each; unlike texts that share an id are told apart.
    No rows give none; columns of any names pass through.
    """
    return minhash.one_of_each(docs, NEAR_PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that come again go, every copy; a document of which nothing but blanks is left by it goes.

    Null and empty texts stay; repeated rows are repeats of each other; no rows give none; columns of any names pass through.
    """
    return repeats.without_repeats(docs, PASSAGE_BYTES, words=PASSAGE_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that benchmark windows cover go with what stands between them; a document left without a word by this goes.

    Null and empty texts stay; repeated rows are changed alike; no rows give none; columns of any names pass through.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places: columns of packing.SCHEMA alone.

    A null or empty text is the end token alone; repeated rows are packed once each; no rows give none.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
