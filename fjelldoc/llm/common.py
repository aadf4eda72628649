"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the contracts call white space: \x20 and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only for a local master that sets none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fjelldoc-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder of one operator's intermediate tables, which go when the last step that reads them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, shared_folder(spark), set()

    def write(self, df: DataFrame, name: str, **options: str) -> str:
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        self.names.add(name)
        return path

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name, **options))

    def drop(self, *names: str) -> None:
        """Removes tables of this folder that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_all_but(self, *kept: str) -> None:
        self.drop(*(self.names - set(kept)))


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Adds gapless numbers from 0 per group, also when one group or one id holds most rows.

    Rows are written with the task that made them, so the number of a row is the count of its group
    in earlier tasks plus its place among the group's rows of its own task: no task meets more of
    a group than one input split had.
    """
    staged = written(df.withColumn("_part", F.spark_partition_id()))
    counts = staged.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_part").orderBy(*order)
    return (
        staged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, [*groups, "_part"])
        .withColumn(out, F.col("_start") + F.col("_place"))
        .drop("_part", "_place", "_start")
    )


def bounded_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Caps the bytes of an Arrow batch, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def slices(batch, column: str, most: int = 4 << 20):
    """Parts of an Arrow batch whose texts have at most `most` bytes together (one text at least)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype="int64")
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null for null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
