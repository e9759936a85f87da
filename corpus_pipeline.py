"""From documents to packed sequences: five operators of tessera.llm, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. The first four return the columns of documents; packing returns its pieces. The mix decides how often a
document is taken: not at all, once or twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import compression_quality, mixing, packing, perplexity_rules, similar_texts
from tessera.llm._base import shared_dir, table
from tessera.llm._tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below 0.7 go. The model learns from every labelled document of the stage's input."""
    return compression_quality.keep(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go."""
    return perplexity_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: SimHash and Golay fuzzy keys
    find candidates, which are near-duplicates where four fifths of their five-word shingles are the same."""
    return similar_texts.keep_one(docs, least=0.8, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Neither the compressors nor the tokenizer exist in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read back."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{root}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
