"""The corpus pipeline: classify, drop near copies, decontaminate, mask personal data, pack.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; the last returns the packed pieces.

A null text is kept by the classifier's score as an empty one is, is one node with all wordless texts for near copies, holds no leak and no
personal data, and packs as the piece [0]. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinframe.llm import decontaminate, packing, pii, quality, simhash
from twinframe.llm.base import keep, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the learning folds of the labels."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash neighbours stays, the one with the smallest id; shingles of 3 words, at most 3 bits."""
    return simhash.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows the text."""
    masked = pii.mask_personal(docs)
    return masked.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document's token pieces and their places in sequences of 2048."""
    import public_tokenizers
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).withColumnRenamed("key", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", classify), ("simhash near-dedup", near_copies), ("benchmark decontamination", leaks),
          ("personal data", personal), ("best-fit packing", pack)]

ORACLE_SQL = None  # no stage can be said in SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs)
    return docs
