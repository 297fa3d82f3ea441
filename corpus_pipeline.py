"""A corpus from raw documents to packed training sequences: each stage is an operator of scoutline.llm, its output a Parquet
table in the shared checkpoint folder that the next stage reads.

Every stage works on all rows of the one before, takes nulls, repeated rows and further columns as its operator does, and
passes the columns of documents on; the last one returns where each piece of each document lies in the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoutline.functions.session import scratch_path
from scoutline.llm import linededup, mixing, oddsketch, packing, rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return rules.keep_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by many documents stay in one of them."""
    return linededup.dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equality one stays, that with the smallest id."""
    return oddsketch.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them: not at all, once or twice."""
    return mixing.take(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
          ("pack_sequences", pack_sequences)]

#: Tokenizing has no SQL form; tests/llm/test_pipeline.py checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
