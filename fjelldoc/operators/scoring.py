"""Score every item against a set of queries where the items lie, keeping only each task's best rows.

There is one lazy plan for every size of the query set, and the items cross no exchange. The queries become one
value, a scalar subquery that Spark evaluates once; the first row of each partition carries it, so a task has
read the queries before its first item. A task's winners are enough: a global winner always wins in its own task.
The value is bounded by `MAX_BYTES`; a larger query set is dealt by hash over `passes` scans of the items.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of the queries of one pass.
MAX_BYTES = 256 << 20


class Scorer(Protocol):
    """Takes a task's items batch by batch, then gives the rows to keep."""

    def add(self, items: pd.DataFrame) -> None: ...

    def rows(self) -> pd.DataFrame: ...


def _scan(items: DataFrame, queries: DataFrame, make: Callable[[pd.DataFrame], Scorer], schema: str) -> DataFrame:
    columns = queries.columns
    row = F.struct(*columns)
    size = F.sum(F.octet_length(F.to_json(row)))
    packed = queries.agg(F.when(F.coalesce(size, F.lit(0)) <= MAX_BYTES, F.collect_list(row)).otherwise(F.raise_error(F.lit("more query bytes than one pass takes: give more passes"))).alias("asked"))
    first = F.monotonically_increasing_id() % (1 << 33) == 0

    def scan(batches):
        import pyarrow as pa

        scorer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if scorer is None:
                asked = batch.column(1)[0]
                scorer = make(pd.DataFrame(asked.as_py() or [], columns=columns))
            scorer.add(pa.RecordBatch.from_struct_array(batch.column(0)).to_pandas())
        found = scorer.rows() if scorer is not None else None
        if found is not None and len(found):
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return items.select(F.struct(*items.columns).alias("item"), F.when(first, packed.scalar()).alias("asked")).mapInArrow(scan, schema)


def scan_items(items: DataFrame, queries: DataFrame, make: Callable[[pd.DataFrame], Scorer], schema: str, passes: int = 1) -> DataFrame:
    """The rows that `make(queries)` keeps of each partition of the items; nothing runs before an action."""
    parts = [queries] if passes == 1 else [queries.where(F.pmod(F.xxhash64(queries.columns[0]), F.lit(passes)) == i) for i in range(passes)]
    return reduce(DataFrame.unionByName, [_scan(items, part, make, schema) for part in parts])


def top_k(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """Best k rows per key; equal scores are settled by the lower id."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
