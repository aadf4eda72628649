"""Ordered passes over groups that may be very large.

A plain window over a hot key sorts that key in one task. Here the key is cut into ordered
buckets; bucket totals are formed with a partial aggregate, their running sums are tiny, and
only the rows of one bucket are ever sorted together. The join and the inner window share the
same partitioning, so the rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over the earlier rows and the row itself, per key, in order.

    `bucket` must not decrease along `order`.
    """
    staged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = staged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.sum("_value").over(inside))
        .drop("_bucket", "_value", "_before")
    )


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """1-based position of every row of its key."""
    return running_total(df, keys, bucket, order, F.lit(1).cast("bigint"), out)


def with_previous(df: DataFrame, keys: list[str], bucket: Column, order: Column, value: str, out: str) -> DataFrame:
    """Adds `value` of the previous row in order; the first row of a bucket looks at the bucket before."""
    staged = df.withColumn("_bucket", bucket).withColumn("_order", order)
    last = staged.groupBy(*keys, "_bucket").agg(F.max_by(value, "_order").alias("_last"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(*keys, "_bucket", F.lag("_last").over(ahead).alias("_carry"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_order")
    return (
        staged.join(carried, [*keys, "_bucket"])
        .withColumn(out, F.coalesce(F.lag(value).over(inside), F.col("_carry")))
        .drop("_bucket", "_order", "_carry")
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by a partial aggregate, so a key with many versions is thinned before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)
