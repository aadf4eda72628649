"""Incremental indexing of a folder: each trigger hands the new files to a batch function."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fjelldoc.session import checkpoint_root
from fjelldoc.sources import files
from fjelldoc.sources.files import discover_stream


def index_new_files(
    spark: SparkSession, folder: str, run: Callable[[DataFrame, int], None], checkpoint: str | None = None
) -> StreamingQuery:
    """Starts a query that processes every path not seen before, of any date, and stops.

    The checkpoint, one per folder, remembers seen paths. A file that changes under its path is not seen
    again: `index_changes` finds those.
    """
    location = checkpoint or f"{checkpoint_root(spark)}/index-new-files-{sha256(folder.encode()).hexdigest()[:16]}"
    writer = discover_stream(spark, folder).writeStream.foreachBatch(run)
    return writer.option("checkpointLocation", location).trigger(availableNow=True).start()


def index_changes(spark: SparkSession, folder: str, state: str, run: Callable[[DataFrame, DataFrame], None]) -> dict[str, int]:
    """One step of a repeated run: what is new, changed or removed since the last one, of any date; returns the counts.

    The folder is listed without opening a file and compared with the versioned table `state`; only new and changed files
    are read. `run` gets them as (name, last_modified, length, file_hash, change), change `touched` where the content is
    as it was, and the removed names. The new state counts when `run` has ended well, so a failed step is repeated.
    """
    known = files.read_version(spark, state) if files.exists(spark, f"{state}/_pointer") else spark.createDataFrame([], files.STATE)
    work = f"{checkpoint_root(spark)}/changes-{uuid4().hex}"
    files.changes(files.listing(spark, folder), known).write.parquet(f"{work}/changes")
    found = spark.read.parquet(f"{work}/changes")
    read = files.read_files(spark, found.where("change IN ('new', 'changed')"), f"{work}/read")
    before = known.select("name", F.col("file_hash").alias("_before"))
    change = F.when(F.col("_before") == F.col("file_hash"), "touched").otherwise(F.col("change"))
    delivered = read.join(found.select("name", "change"), "name").join(before, "name", "left").withColumn("change", change).drop("_before")
    removed = found.where("change = 'removed'").select("name")
    run(delivered, removed)
    same = known.join(found.where("change = 'same'").select("name"), "name", "left_semi")
    files.write_version(same.unionByName(read), state)
    counts = delivered.groupBy("change").count().unionByName(found.where("change IN ('removed', 'same')").groupBy("change").count())
    return {r["change"]: r["count"] for r in counts.collect()}
