"""Approximate vector search with an inverted file: items lie in the cell of their nearest centroid, queries visit a few cells.

The centroids are fitted on at most `SAMPLE` unit vectors; every item is indexed. How many cells a query visits is either
given or calibrated: the exact neighbours of at most `TRIAL` queries are looked up in the index, and the least number
of cells that holds the wanted share of them is taken. So the recall is measured, on whatever data; vectors without
any structure need many cells, clustered ones few.

Cells with more than `CELL` components are cut by a hash of the id, and the queries of a cell go to each of its parts in
blocks, so that no task holds more than one part and one block.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fjelldoc.operators.scoring import top_k
from fjelldoc.session import checkpoint_root

#: Rows that the centroids are fitted on, queries of a calibration, most centroids, components of a part of a cell and of a block of queries.
SAMPLE, TRIAL, MOST_CELLS, CELL = 50_000, 200, 4096, 1 << 22
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Share of the exact neighbours that a calibration asks for; above the promised 0.9, as other queries may do worse.
TARGET = 0.95


def unit_vector(v: Column) -> Column:
    """The vector at length one; null where it is null, holds a null or NaN, or has no direction."""
    wide = v.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((length > 0) & (length < float("inf")), F.transform(wide, lambda x: x / length))


class InvertedFile:
    """Centroids (one row each) and the items (id, cell, part, vector)."""

    def __init__(self, centroids: np.ndarray, items: DataFrame):
        self.centroids, self.items = centroids, items

    @staticmethod
    def build(items: DataFrame, cells: int | None = None, seed: int = 7) -> InvertedFile:
        """Indexes all usable vectors of (id, embedding) of the commonest length; by default 2 * sqrt(rows) cells."""
        units = items.select("id", unit_vector(F.col("embedding")).alias("vector")).where("vector IS NOT NULL")
        sizes = units.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
        if sizes is None:
            return InvertedFile(np.zeros((0, 0)), units.select("id", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(1).alias("parts"), "vector"))
        dim, rows = sizes["dim"], sizes["n"]
        units = units.where(F.size("vector") == dim)
        cells = cells or min(MOST_CELLS, max(1, round(2 * rows**0.5)))
        sample = units.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE) if rows > SAMPLE else units
        model = KMeans(k=cells, seed=seed, maxIter=8, initSteps=2, featuresCol="features").fit(sample.select(array_to_vector("vector").alias("features")))
        centroids = np.array(model.clusterCenters())
        centroids /= np.maximum(np.sqrt((centroids * centroids).sum(axis=1, keepdims=True)), 1e-12)
        placed = _cells(units, centroids, 1).select("id", F.col("cells")[0].alias("cell"), "vector")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") * dim / CELL).cast("int").alias("parts"))  # a row per cell
        placed = placed.join(parts, "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "parts", "vector")
        checkpoint_root(items.sparkSession)
        return InvertedFile(centroids, placed.checkpoint())  # built once, read by each search

    def visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, vector, cell, nearness) of the nearest cells of each usable query, nearness from 0."""
        asked = queries.select(F.col("query_id").alias("id"), unit_vector(F.col("embedding")).alias("vector")).where(F.size("vector") == self.centroids.shape[1])
        near = _cells(asked, self.centroids, min(probes, len(self.centroids)))
        return near.select(F.col("id").alias("query_id"), "vector", F.posexplode("cells").alias("nearness", "cell"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, score, rank): the k best of the items in the cells visited, by cosine."""
        visits = self.visits(queries, probes).drop("nearness")
        dim = max(1, self.centroids.shape[1])
        blocks = visits.groupBy("cell").agg(F.ceil(F.count("*") * dim / CELL).cast("int").alias("blocks"))
        parts = self.items.select("cell", "parts").distinct()  # a row per cell
        asked = visits.join(blocks, "cell").join(parts, "cell")
        asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "vector")
        held = self.items.join(blocks, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "vector")

        def best(left, right):
            import pyarrow as pa

            q, v = (np.array(t.column("vector").combine_chunks().flatten().to_numpy()).reshape(t.num_rows, -1) for t in (left, right))
            ids, asks = right.column("id").to_numpy(), left.column("query_id").to_numpy()
            by_id = np.argsort(ids, kind="stable")
            ids, v, tables = ids[by_id], v[by_id], []
            step = max(1, SCORES // max(1, len(v)))
            for begin in range(0, max(1, len(q)), step):  # a slice's scores at a time
                scores = np.round(q[begin : begin + step] @ v.T, 6)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                tables.append(pa.table({"query_id": np.repeat(asks[begin : begin + step], top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(scores, top, axis=1).ravel()}))
            return pa.concat_tables(tables)

        groups = ["cell", "part", "block"]
        found = asked.groupBy(*groups).cogroup(held.groupBy(*groups)).applyInArrow(best, "query_id bigint, id bigint, score double")
        return top_k(found, "query_id", "score", "id", k)

    def calibrated(self, queries: DataFrame, exact: DataFrame, target: float = TARGET) -> int:
        """The least number of cells whose items hold the target share of the `exact` hits (query_id, id)."""
        if not len(self.centroids):
            return 1
        places = self.visits(queries, len(self.centroids)).select("query_id", "cell", "nearness")
        needed = exact.select("query_id", "id").join(self.items.select("id", "cell"), "id").join(places, ["query_id", "cell"])
        counts = {r["nearness"]: r["n"] for r in needed.groupBy("nearness").agg(F.count("*").alias("n")).collect()}  # a row per cell at most
        wanted, held = target * sum(counts.values()), 0
        for nearness in sorted(counts):
            held += counts[nearness]
            if held >= wanted:
                return nearness + 1
        return 1

    def compared(self, queries: DataFrame, probes: int) -> DataFrame:
        """(queries, items, pairs): how many pairs a search compares, in one row."""
        sizes = self.items.groupBy("cell").agg(F.count("*").alias("n"))
        pairs = self.visits(queries, probes).join(sizes, "cell").agg(F.count_distinct("query_id").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
        return pairs.withColumn("items", self.items.agg(F.count("*")).scalar())


def _cells(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """(id, vector, cells): the nearest centroids of each unit vector, nearest first; equal ones by number."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors

    def place(batches):
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            step = max(1, SCORES // max(1, len(c)))
            for begin in range(0, batch.num_rows, step):  # a slice's scores at a time
                some = batch.slice(begin, step)
                v = some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                near = np.round(v @ c.T, 9)
                order = near.argmax(axis=1)[:, None] if most == 1 else np.argsort(-near, axis=1, kind="stable")[:, :most]
                offsets = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * order.shape[1])
                cells = pa.ListArray.from_arrays(offsets, pa.array(order.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("vector"), cells], ["id", "vector", "cells"])

    return rows.select("id", "vector").mapInArrow(place, "id bigint, vector array<double>, cells array<int>")


def trial(queries: DataFrame, most: int = TRIAL) -> DataFrame:
    """At most `most` queries, picked by a hash of their id."""
    return queries.orderBy(F.xxhash64("query_id")).limit(most)


def approximate_top_k(items: DataFrame, queries: DataFrame, k: int, probes: int | None = None, cells: int | None = None, seed: int = 7, target: float = TARGET) -> DataFrame:
    """Nearest items (id, embedding) of the queries (query_id, embedding) by cosine; without `probes` they are calibrated."""
    index = InvertedFile.build(items, cells, seed)
    if probes is None:
        few = trial(queries)
        probes = index.calibrated(few, exact_top_k(items, few, k), target)
    return index.search(queries, k, probes)


def exact_top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    from fjelldoc.operators.search import _nearest

    return _nearest(items.select("id", F.col("id").alias("chunk_id"), "embedding"), queries, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per query."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
