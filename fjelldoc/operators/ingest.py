"""Incremental indexing: which files to process, claims, status changes and the whole run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.functions.text import file_title, fixed_windows
from fjelldoc.functions.vectors import mean_vector
from fjelldoc.operators.chunking import chunk_documents, document_text
from fjelldoc.operators.embed import Embedder, attach_cache, cached_vectors, embed_missing, embed_texts
from fjelldoc.operators.keyed import replace_children
from fjelldoc.session import checkpoint_root

# Stale limit, messages.
STALE_MINUTES = 30
RECLAIMED = "Reclaimed from stale processing state"
NO_TEXT = "No extractable text"

_STATE = ["indexing_status", "last_modified", "file_hash"]


def with_state(blobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Found files next to what is stored about them; unknown files have null state."""
    known = docs.select(F.col("source_blob").alias("name"), *[F.col(c).alias(f"stored_{c}") for c in _STATE], F.lit(True).alias("known"))
    return blobs.join(known, "name", "left")


def reindex_decision(blobs: DataFrame, docs: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Adds `reindex`; a missing stored value compares as empty text."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    status = F.col("stored_indexing_status")
    changed = (text("stored_last_modified") != text("last_modified")) | (text("stored_file_hash") != text("file_hash"))
    rule = (
        F.when(F.col("known").isNull(), True)
        .when(status == "processing", False)
        .when(status == "ready", changed)
        .when(status == "failed", F.lit(retry_failed))
        .otherwise(True)
    )
    return with_state(blobs, docs).withColumn("reindex", rule)


def claim(blobs: DataFrame, docs: DataFrame, retry_failed: bool = True) -> DataFrame:
    """Files this run takes: new ones, and stored ones that are due; nulls differ from any value."""
    status = F.col("stored_indexing_status")
    differs = ~F.col("stored_last_modified").eqNullSafe(F.col("last_modified")) | ~F.col("stored_file_hash").eqNullSafe(F.col("file_hash"))
    due = F.when(status == "processing", False).when(status == "ready", differs).when(status == "failed", F.lit(retry_failed)).otherwise(True)
    return with_state(blobs, docs).filter(F.col("known").isNull() | due).select(*blobs.columns)


def reclaim_stale(docs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Rows processing for longer than the limit become new again."""
    stale = (F.col("indexing_status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return docs.withColumn("error_message", F.when(stale, RECLAIMED).otherwise(F.col("error_message"))).withColumn(
        "indexing_status", F.when(stale, "new").otherwise(F.col("indexing_status"))
    )


def refresh_lease(docs: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Moves `updated_at` of the named rows, only while they are processing."""
    return _touch(docs, names, lambda hit: {"updated_at": F.when(hit & (F.col("indexing_status") == "processing"), now).otherwise(F.col("updated_at"))})


def force_reset(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Every named row becomes new, also rows being processed."""
    return _touch(docs, names, lambda hit: {"indexing_status": F.when(hit, "new").otherwise(F.col("indexing_status"))})


def set_status(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (source_blob, status, error); a null error clears the message."""
    c = changes.select("source_blob", F.col("status").alias("_s"), F.col("error").alias("_e"))
    hit = F.col("_s").isNotNull()
    out = docs.join(c, "source_blob", "left").withColumn("error_message", F.when(hit, F.col("_e")).otherwise(F.col("error_message")))
    return out.withColumn("indexing_status", F.coalesce("_s", "indexing_status")).select(*docs.columns)


def backfill(docs: DataFrame) -> DataFrame:
    """New rows that already have content are ready, indexed when they were last updated."""
    done = (F.col("indexing_status") == "new") & (F.col("content") != "")
    return docs.withColumn("indexed_at", F.when(done, F.col("updated_at")).otherwise(F.col("indexed_at"))).withColumn(
        "indexing_status", F.when(done, "ready").otherwise(F.col("indexing_status"))
    )


def _touch(docs: DataFrame, names: DataFrame, changes) -> DataFrame:
    named = names.select(F.col("name").alias("source_blob")).distinct().withColumn("_hit", F.lit(True))
    joined = docs.join(named, "source_blob", "left")
    return joined.withColumns(changes(F.coalesce("_hit", F.lit(False)))).select(*docs.columns)


def indexing_status(docs: DataFrame) -> DataFrame:
    """Files per status and in all; manual entries without a file do not count."""
    counts = docs.filter(F.col("source_blob").isNotNull()).groupBy("indexing_status").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("count")).select(F.lit("total").alias("indexing_status"), F.coalesce("count", F.lit(0)).alias("count"))
    return counts.unionByName(total)


def failed_documents(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("indexing_status") == "failed") & F.col("source_blob").isNotNull()).select("source_blob", "error_message")


def embedding_outcome(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks and embedded chunks per document; ready only when all of at least one are embedded."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    return counts.withColumn("status", outcome_status(F.col("total"), F.col("embedded")))


def outcome_status(total: Column, embedded: Column) -> Column:
    return F.when((total > 0) & (embedded == total), "ready").otherwise("partial")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of one run; the partial and failed files stay rows of `outcomes`."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("indexed"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


@dataclass
class RunResult:
    """Next versions of both tables and the outcome of every file."""

    docs: DataFrame
    chunks: DataFrame
    outcomes: DataFrame


def fallback_vectors(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """Document vector = mean of the vectors of fixed-size windows of the text."""
    windows = texts.filter(F.trim("content") != "").select("doc_id", F.explode_outer(fixed_windows(F.col("content"))).alias("text"))
    windows = windows.filter("text IS NOT NULL")
    return mean_vector(embed_texts(windows, embedder), "doc_id", "embedding", "doc_vector")


def index_run(
    docs: DataFrame,
    stored_chunks: DataFrame,
    blobs: DataFrame,
    blocks: DataFrame,
    embedder: Embedder,
    dim: int,
    now: Column,
    force: bool = False,
    retry_failed: bool = True,
) -> RunResult:
    """One indexing run. `blocks.doc_id` and `stored_chunks.document_id` hold file names.

    The embedded chunks feed several outputs and are costly, so they are checkpointed once to the
    shared folder; everything else stays lazy.
    """
    checkpoint_root(docs.sparkSession)
    state = reclaim_stale(docs, now)
    if force:
        state = force_reset(state, blobs)
    taken = claim(blobs, state, retry_failed)
    own_blocks = blocks.join(taken.select(F.col("name").alias("doc_id")), "doc_id", "left_semi")
    texts = document_text(own_blocks)
    fresh = chunk_documents(own_blocks).withColumnRenamed("doc_id", "document_id")
    embedded = embed_missing(attach_cache(fresh, cached_vectors(stored_chunks, dim)), embedder).checkpoint()

    counts = embedded.groupBy("document_id").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))
    result = (
        taken.join(texts.withColumnRenamed("doc_id", "name"), "name", "left")
        .join(counts.withColumnRenamed("document_id", "name"), "name", "left")
        .withColumn("content", F.coalesce("content", F.lit("")))
        .fillna(0, ["total", "embedded"])
    )
    bare = result.filter("embedded = 0").select(F.col("name").alias("doc_id"), "content")
    vectors = fallback_vectors(bare, embedder).withColumnRenamed("doc_id", "name")
    empty = (F.trim("content") == "") & (F.col("total") == 0)
    done = result.join(vectors, "name", "left").withColumn(
        "status", F.when(empty, "failed").otherwise(outcome_status(F.col("total"), F.col("embedded")))
    )

    columns = docs.columns
    updates = done.select(
        F.col("name").alias("source_blob"),
        F.struct(
            file_title(F.col("name")).alias("title"),
            "content",
            "last_modified",
            "file_hash",
            F.col("status").alias("indexing_status"),
            F.when(empty, F.lit(NO_TEXT)).alias("error_message"),
            F.col("doc_vector").cast("array<float>").alias("embedding"),
            now.alias("indexed_at"),
            now.alias("updated_at"),
        ).alias("_u"),
    )
    both = state.join(updates, "source_blob", "full")
    fields = ["title", "content", "last_modified", "file_hash", "indexing_status", "error_message", "embedding", "indexed_at", "updated_at"]
    taken_over = F.col("_u").isNotNull()
    # a stored document whose new version yields no text keeps all but its status
    replaced = taken_over & ((F.col("_u.indexing_status") != "failed") | F.col("created_at").isNull())
    state_fields = ("indexing_status", "error_message", "updated_at")
    picked = {f: F.when(taken_over if f in state_fields else replaced, F.col(f"_u.{f}")).otherwise(F.col(f)) for f in fields}
    next_docs = both.withColumns({**picked, "created_at": F.coalesce("created_at", now)}).select(*columns)

    kept = embedded.select(*stored_chunks.columns)
    succeeded = done.where("status <> 'failed'").select(F.col("name").alias("document_id"))
    next_chunks = replace_children(stored_chunks, kept, succeeded, "document_id")
    word = F.when(F.col("status") == "ready", "ok").when(F.col("status") == "failed", "error").otherwise("partial")
    outcomes = (
        blobs.select("name")
        .join(done.select("name", word.alias("status"), F.when(empty, F.lit(NO_TEXT)).alias("error")), "name", "left")
        .withColumn("status", F.coalesce("status", F.lit("skipped")))
    )
    return RunResult(next_docs, next_chunks, outcomes)
