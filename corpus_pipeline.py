"""The corpus pipeline: raw documents to token ids, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs; all but the last return the columns of documents. Stages keep extra columns as they are, whatever these are
called. An empty table gives an empty result.

Null and empty texts fail the quality rules and go. Rows without an id pass as rows of their own; rows of one id are
judged each by its text, but for near duplicates, where the least id of a group keeps all its rows. Texts that line
dedup leaves empty are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, line_dedup, near_copies, quality, sentencepiece_codec
from pagewright.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the filtering policy: a short text isn't a bad one."""
    return quality.filter_quality(docs)


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier place repeats; n_chars follows the text."""
    out = line_dedup.filter_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies (5-word shingles, similarity 0.8 or more)."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote no item of the benchmark table (of three words or more)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the near copies' components, the edit matching and the merges; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
