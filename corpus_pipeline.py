"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes what its predecessor kept, in the columns of ``documents``, and returns what it keeps; the last
returns the pieces of packed sequences. Null texts count as empty, other columns are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrid import ship
from lumagrid.llm.common import Staging, table
from lumagrid.llm.exact_dedup import drop_exact
from lumagrid.llm.ngram_join import drop_similar
from lumagrid.llm.packing import pack
from lumagrid.llm.quality import drop_rejected
from lumagrid.llm.substring_dedup import dedup_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labelled ones among docs."""
    ship(spark)
    return drop_rejected(spark, docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    ship(spark)
    return drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of five-word shingles, the smallest doc_id."""
    ship(spark)
    return drop_similar(docs, words=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has; n_chars follows the text."""
    ship(spark)
    cleaned = dedup_substrings(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cleaned.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; a document whose text the stage before emptied is its end token alone."""
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: A trained classifier can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.put(docs)
    return docs
