"""A training corpus from raw documents, in stages that each write Parquet for the next.

Toxic documents go, repeated lines go, of near duplicates the document with the smallest id stays, documents
with a benchmark item go, and what is left is encoded.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.decontaminate import decontaminate
from tallyward.llm.line_dedup import dedup_lines
from tallyward.llm.sentencepiece import encode, load_pieces
from tallyward.llm.simhash import one_of_each
from tallyward.llm.toxicity import without_toxic
from tallyward.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. The models are fitted on the labelled ones among docs."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the lines removed that repeat an earlier one, and n_chars of what is left."""
    clean = dedup_lines(docs).drop("removed_lines")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids and n_tokens."""
    return encode(docs, load_pieces())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_texts),
]

#: SQL can state neither the models of the first stage nor the encoding of the last; tests/llm/test_pipeline.py
#: holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
