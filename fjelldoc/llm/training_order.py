"""Training-order materialisation (operator 5).

Sequences of fixed stride get dense numbers, a keyed Feistel permutation with cycle-walking turns
each number into a global slot, and a range partition per shard writes the records in slot order. A
reader that stops at slot s goes on with `read_from(spark, path, s)`.

Defined cases: a null text is empty; an empty text is one sequence of padding; rows that repeat have
sequences of their own; an empty table writes an empty one.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fjelldoc.llm.common import bounded_batches, shared_folder, slices, utf8, written

ROUNDS = 4
#: Slots of a shard at least, and shards at most.
LEAST_SHARD, MOST_SHARDS = 8192, 1 << 16


def feistel(numbers, size: int, key: int):
    """A permutation of 0..size-1, the same for the same key; numpy in, numpy out.

    The domain is the next even number of bits; a value outside walks on along its cycle until it is inside.
    """
    import numpy as np

    half = np.uint64(max(1, (max(1, size - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    with np.errstate(over="ignore"):
        keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1) for r in range(1, ROUNDS + 1)]

        def once(x):
            left, right = x >> half, x & mask
            for k in keys:
                f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
            return (left << half) | right

        out = once(np.asarray(numbers).astype(np.uint64))
        while (outside := out >= np.uint64(size)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, tokenizer_path: str, length: int = 1024, pad: int = 0xFFFF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, n_tokens, ids_crc32, ids, stride, task, place: up to `length` ids of two bytes each.

    stride is the number of bytes that a record gets; task and place say which task made the sequence and as which of its own. The vocabulary's ids must lie below `pad`.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from fjelldoc.llm.tokens import NarrowIds, loaded

        task, made, width = TaskContext.get().partitionId(), 0, 2 * length
        encode = loaded(NarrowIds, tokenizer_path)
        if encode.tokenizer.get_vocab_size() > pad:
            raise ValueError(f"the vocabulary's ids don't fit in two bytes below the padding {pad}")
        for batch in batches:
            for part in slices(batch, text):
                of, piece, cuts = [], [], []
                for row, ids in enumerate(encode(utf8(part.column(text)))):
                    own = [ids] if len(ids) <= width else [ids[at : at + width] for at in range(0, len(ids), width)]
                    of += [row] * len(own)
                    piece += range(len(own))
                    cuts += own
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array([len(x) >> 1 for x in cuts], pa.int32()),
                        pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array(cuts, pa.binary()), pa.array([width] * len(of), pa.int32()), pa.array([task] * len(of), pa.int32()), pa.array(range(made, made + len(of)), pa.int64()),
                    ],
                    [key, "piece", "n_tokens", "ids_crc32", "ids", "stride", "task", "place"],
                )
                made += len(of)

    return rows.mapInArrow(cut, f"`{key}` {kind}, piece int, n_tokens int, ids_crc32 long, ids binary, stride int, task int, place long")


def shard_size(sequences: int) -> int:
    """Slots of a shard: LEAST_SHARD, or the power of two that leaves at most MOST_SHARDS shards."""
    return max(LEAST_SHARD, 1 << (-(-sequences // MOST_SHARDS) - 1).bit_length()) if sequences else LEAST_SHARD


def write_training_order(sequences: DataFrame, path: str, seed: int, per_shard: int | None = None, key: str = "doc_id", pad: int = 0xFFFF) -> DataFrame:
    """Writes records (slot, key, piece, n_tokens, ids_crc32, ids) under `path`, one folder and file per shard.

    The sequences are written once as they come; a sequence's dense number is the count of those from
    earlier tasks plus its place in its own. Shard s has the slots s * per_shard to (s + 1) * per_shard - 1
    in order, each filled with `pad` to the same number of bytes. Without `per_shard` the number of sequences sets
    it (see `shard_size`). Returns the written table without the ids.
    """
    made = written(sequences)
    counts = made.groupBy("task").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))  # 12 bytes per input split
    size = made.count()
    per_shard = per_shard or shard_size(size)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), size, seed))

    slots = (
        made.join(F.broadcast(starts), "task")
        .withColumn("slot", slot_of(F.col("_start") + F.col("place")))
        .withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
        .drop("task", "place", "_start")
    )
    shards = max(1, -(-size // per_shard))
    ordered = slots.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot")

    filled = ordered.withColumn("ids", F.rpad("ids", F.col("stride"), F.lit(pad.to_bytes(2, "little")))).drop("stride")
    filled.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return sequences.sparkSession.read.schema(filled.schema).parquet(path).drop("ids")


def read_from(spark: SparkSession, path: str, slot: int, per_shard: int | None = None) -> DataFrame:
    """The records from `slot` on, in training order; earlier shards aren't opened."""
    records = spark.read.parquet(path)
    if per_shard is None:  # all shards but the last have the size of the first
        per_shard = (records.where("shard = 0").agg(F.max("slot")).first()[0] or 0) + 1
    return records.where((F.col("shard") >= slot // per_shard) & (F.col("slot") >= slot)).orderBy("slot")


def materialise(docs: DataFrame, tokenizer_path: str, seed: int = 20240229, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Tokenises, orders and writes all documents; one row per sequence."""
    return write_training_order(token_sequences(docs, tokenizer_path, key=key), path or shared_folder(docs.sparkSession), seed, key=key)
