"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Each stage works on all that the one before kept, and its decisions take effect. All but the last return the columns of documents; the last adds ids, n_tokens
and exact. Between stages, rows are written to the cluster's shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsieve.llm import bpe, decontaminate, line_dedup, minhash_dedup, quality_rules
from glyphsieve.llm._common import materialise
from glyphsieve.sources.tables import read_table


def keep_good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept, with their good lines."""
    return quality_rules.clean_lines(docs).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, but for two edits, earlier in the corpus; short ones must be nearer, the shortest equal."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.drop_near_duplicates(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what they share with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", keep_good_lines),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_passages),
    ("bpe", encode_tokens),
]

#: SQL can't express BPE's merges; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
