"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjelldoc.llm import bag_search, decontaminate, histogram_topk, licenses, ngram_join, packing, quality_rules, rule_ensemble, shard_tree, token_counts, tool_calls, training_order, turn_repair
from fjelldoc.llm.oracles import REPAIR, SEARCH, TOP_K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op2_shard_tree(spark, sf_dir):
    """All documents in 16 shards; with a 17th, rows move into it alone."""
    docs = table(spark, sf_dir, "documents")
    out = shard_tree.assign_shards(docs, "doc_id", shard_tree.layout(16), shard_tree.layout(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op3_token_counts(spark, sf_dir):
    """Token counts of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_training_order(spark, sf_dir):
    """All documents as sequences of 1024 ids, written in permuted order; one row per sequence."""
    return training_order.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


@query
def op7_distribution_divergence(spark, sf_dir):
    """Base statistics and verdict of all documents."""
    judged = quality_rules.quality(table(spark, sf_dir, "documents"))
    q = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return judged.select("_row.doc_id", *q)


@query
def op10_rule_ensemble(spark, sf_dir):
    """Scores of all documents by rules learned from the labels outside the held-out fold."""
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    scored = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels), "doc_id")
    return scored.select("doc_id", rule_ensemble.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_block_max_wand(spark, sf_dir):
    """Verified benchmark leaks of all documents, one row per document and item."""
    return decontaminate.found_leaks(*(table(spark, sf_dir, name) for name in ("documents", "benchmark")))


@query
def op9_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark, sf_dir):
    """License notices in all documents, one row per document and license."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark)).select("doc_id", "license", "contained")


@query
def op8_tool_call_linking(spark, sf_dir):
    """Calls and results of all conversations, linked, ordered, checked and as canonical JSON."""
    linked = tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations")), tool_calls.SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


@query
def op11_histogram_topk(spark, sf_dir):
    """The five best other vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    found = histogram_topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op12_turn_repair(spark, sf_dir):
    """Damage and cheapest repair of all conversations."""
    return turn_repair.digests(turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations"))))


@query
def op13_bag_search(spark, sf_dir):
    """The twenty best documents of every benchmark item."""
    return bag_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES |= {"op11_histogram_topk": TOP_K, "op12_turn_repair": REPAIR, "op13_bag_search": SEARCH}
