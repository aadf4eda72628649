"""Float vectors as arrays: text form, dimension check, products and means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_vector(text: Column) -> Column:
    """Array of floats from "[0.1,...]"; anything malformed or holding nulls becomes null."""
    shaped = F.when(text.rlike(r"^\s*\[.*\]\s*$"), F.from_json(text, "array<float>"))
    return F.when(~F.exists(shaped, lambda v: v.isNull()), shaped)


def format_vector(vector: Column) -> Column:
    return F.to_json(vector)


def has_dim(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Null when either side has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def mean_vector(df: DataFrame, key: str, vector: str, out: str = "embedding") -> DataFrame:
    """Element-wise mean per key; partial sums are formed per position before the shuffle."""
    long = df.filter(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("pos", "v"))
    means = long.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return means.groupBy(key).agg(F.transform(ordered, lambda s: s["v"]).alias(out))
