"""The corpus pipeline: identify languages, drop near-duplicates and benchmark leaks, pack what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import decontam, langid, near_copies, packing
from halyard.llm.common import fresh_path, read_table
from halyard.llm.queries import vocab_path

#: Five-word shingles; candidates share one of five bit blocks of one of eight
#: fingerprint words and differ in at most 108 of 512 bits, four deviations above what texts do on average
#: whose shingles are alike by 0.8. Their shingle sets decide.
NEAR = {"k": 5, "words": 8, "index_words": 8, "blocks": 5, "agree": 1, "radius": 14, "total": 108}

#: A sequence holds 16 documents and three quarters of the attention cost of one full-length document at most,
#: so that steps take about as long as each other; the bounds count as much as tokens when a sequence is chosen.
PACK = {"capacity": 2048, "max_docs": 16, "max_attention": 3 * 2048 * 2048 // 4, "weights": (1.0, 1.0, 1.0)}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that is known with at least even odds, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies the document with the smallest doc_id stays."""
    return near_copies.drop_near_copies(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), keep_without_id=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place there."""
    return packing.pack_documents(docs, vocab_path(), **PACK)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Networks, fingerprints and tokenizers can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
    return docs
