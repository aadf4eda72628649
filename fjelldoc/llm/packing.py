"""Best-fit packing by a plan over the length histogram (operator 6).

The plan is made over at most `capacity` counts, one per length: best fit, longest first, with whole
runs of equal sequences placed at once. Pieces then take their planned slots by a join on their
rank within their length, so no document passes through the plan.

Defined cases: a null text is empty, and an empty text is its end id alone; rows that repeat are packed
as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjelldoc.llm.common import bounded_batches, numbered, slices, utf8


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence_from, per_sequence, offset).

    Each piece, longest first, goes to the sequence with the least room that still takes it. Sequences
    with equal room are kept as ranges of numbers, so a step places many pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    frees: list[int] = []
    plan, sequences = [], 0

    def put(first: int, n: int, free: int) -> None:
        if n > 0 and free > 0:
            if free not in room:
                room[free] = []
                insort(frees, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(frees, length)
            if at < len(frees):
                free = frees[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], frees[at]
            else:
                free = capacity
                first, n = sequences, -(-left // (free // length))
                sequences += n
            per = free // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, capacity - free))
                put(first, full, free - per * length)
                rank, left = rank + full * per, left - full * per
            used = full
            if full < n and left:
                plan.append((length, rank, rank + left, first + full, left, capacity - free))
                put(first + full, 1, free - left * length)
                rank, left, used = rank + left, 0, full + 1
            put(first + used, n - used, free)
    return plan


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: the ids of each text and the end id, cut at `capacity`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        from fjelldoc.llm.tokens import WordIds, loaded

        encode, end = loaded(WordIds, tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, text):
                of, piece, length, crc = [], [], [], []
                for row, ids in enumerate(encode(utf8(part.column(text)))):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        of.append(row)
                        piece.append(p)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [key, "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column `length` of 1 to `capacity`.

    The histogram on the driver has at most `capacity` rows; the plan grows with it, not with the pieces.
    """
    import pyarrow as pa

    names = [c for c in pieces.columns if c != "length"]
    ranked = numbered(pieces, ["length"], names, "_rank")
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = list(zip(*best_fit_plan(counts, capacity), strict=True)) or [()] * 6
    columns = ["_length", "_from", "_to", "_first", "_per", "_offset"]
    plan = pieces.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(columns, steps, strict=True)}))
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(plan), inside)
        .withColumn("sequence_id", F.col("_first") + F.floor(nth / F.col("_per")))
        .withColumn("offset", F.col("_offset") + F.pmod(nth, F.col("_per")) * F.col("length"))
        .drop("_rank", *columns)
    )
