"""A corpus from raw documents: quality, near copies, repeats, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep
the columns of ``documents``. Rows with a null or empty text pass as such wherever they are not rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, minhash_dedup, quality, sentencepiece_codec, suffix_dedup
from cadenza.llm.exchange import free, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text is judged as an empty one; rows that repeat are judged alike, each on its own.
    """
    model = quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free(docs.columns, "_score", "_predicted")
    return quality.scored(docs, model, docs.columns, names).where(F.col(names[1]) == 1).drop(*names)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the least doc_id, a null one before all.

    Rows without words stay. Of rows that repeat doc_id and text, one stays.
    """
    return minhash_dedup.one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 200 bytes or more that also start anywhere else, rows that repeat included.

    Null and empty texts stay as they are; every row stays.
    """
    return suffix_dedup.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold under 0.8 of every benchmark item's shingles; each row is judged by its own text, whatever its doc_id.

    Rows without a text stay.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with merge-dropout: one row for each document, null ids for a null text."""
    return sentencepiece_codec.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
