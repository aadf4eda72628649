"""Corpus pipeline: rules, classifier, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and is written as Parquet
and read again before the next one. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fjelldoc.llm import decontaminate, ngram_join, packing, quality_rules, rule_ensemble
from fjelldoc.llm.common import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def passes_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more by rules learned from labelled documents, rejected ones among them."""
    ensemble = rule_ensemble.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rule_ensemble.keep_good(docs, ensemble)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.without_near_copies(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", passes_rules),
    ("quality classifier", passes_classifier),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmark),
    ("best-fit packing", packed),
]

#: A classifier and a tokenizer are among the stages, which SQL can't express; tests/llm/test_pipeline.py compares the chain and its stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's input goes once the next stage's is written."""
    work = Workspace(spark)
    docs = _table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.written(stage(spark, docs, sf_dir), f"stage-{n}")
        work.drop(f"stage-{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
