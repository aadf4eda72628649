"""Exact top-k search by histogram selection (operator 11).

Every query is scored against every vector, where the vectors lie: a block of queries of bounded size goes to
all tasks, and each task multiplies it with its own vectors. Scores are never stored. A first pass counts them in
`BINS` bins per query over the range that the norms allow; the bin that holds the kth best score becomes the
next pass's range, until a bin is one score wide. A last pass then keeps the scores above the kth value and,
of those equal to it, as many as are missing, those with the smallest ids.

How little is sent: of its counts, a task sends those at or above the bin in which it has k scores of its own (the
kth best of all lies no lower), and of equal scores no more than are missing. So a vector that a third of the
rows repeat costs no more rows than any other. Blocks of queries follow one another; each is one broadcast of
at most `BLOCK` vectors and `COMPONENTS` components.

Components are floor(scale * x) as 64-bit integers (beyond that range the nearest 64-bit integer). Products are summed
in floats where the norms prove that every sum is exact, else in integers of any size, with scores beyond
64 bits set to the nearest one.

Defined cases: vectors that are null or hold a null, infinite or NaN component take no part; vectors of another
length than the query's are no candidates of it; a query is every *row* that the condition selects, and only that
row is left out of its own candidates, so rows that repeat an id find one another; null ids sort last; fewer than k
candidates are all returned; no queries or no vectors give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjelldoc.llm.common import Workspace, bounded_batches

SCALE = 256
#: Queries and components of one broadcast.
BLOCK, COMPONENTS = 8192, 4 << 20
BINS = 512
#: Scores that a task holds at once.
CELLS = 1 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query long, query_id long, row long, id long, score long"


def quantised(vectors: DataFrame, key: str, vector: str, wanted: Column, scale: int = SCALE) -> DataFrame:
    """row, id, wanted, v for each usable vector; the row numbers hold once the rows are written."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(v.isNotNull() & ~odd).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.coalesce(wanted, F.lit(False)).alias("wanted"), whole.alias("v")
    )


class Queries:
    """A block of queries: their matrices by length, and the range in which each one's kth score lies."""

    def __init__(self, rows: list, k: int, norm: float):
        import numpy as np

        self.k, self.rows, self.ids = k, np.array([r["row"] for r in rows], dtype=np.int64), [r["id"] for r in rows]
        lengths = np.array([len(r["v"]) for r in rows])
        self.of_length = {int(d): np.flatnonzero(lengths == d) for d in set(lengths.tolist())}
        norms = [sum(x * x for x in r["v"]) ** 0.5 for r in rows]
        greatest = max(norms) * norm * (1 + 1e-9) + 1
        #: no partial sum of products is greater than the product of the norms
        self.kind = "f4" if greatest < 1 << 24 else "f8" if greatest < 1 << 53 else "O"
        self.matrix = {d: np.array([rows[i]["v"] for i in at], dtype=self.kind).reshape(len(at), d) for d, at in self.of_length.items()}
        bounds = [min(int(n * norm * (1 + 1e-9)) + 1, MOST) for n in norms]
        self.lo = [-b for b in bounds]
        width = max(1, -(-(2 * max(bounds) + 1) // BINS))
        self.width = 1 << (width - 1).bit_length()  # a power of two, so that bins are exact in floats too
        self.bins = BINS
        self.above = [0] * len(rows)
        self.short = [False] * len(rows)

    def narrow(self, found: dict[int, tuple[int, int]]) -> bool:
        """Takes each query's bin and the count above it; true when all bins are one score wide."""
        for q in range(len(self.ids)):
            if self.short[q]:
                continue
            if q not in found:
                self.short[q] = True
                continue
            at, over = found[q]
            self.lo[q] += at * self.width
            self.above[q] += over
        done = self.width == 1
        before = self.width
        self.width = max(1, before // BINS)
        self.bins = before // self.width  # the next range is the bin found, no wider
        return done

    def scores(self, batch) -> Iterator[tuple]:
        """(query numbers, rows, ids, id is null, scores) of parts of at most CELLS scores; ids ascend, own scores are set to below any."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches([batch]).sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        v = table.column("v").combine_chunks()
        lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
        for d, queries in self.of_length.items():
            mine = np.flatnonzero(lengths == d)
            if not len(mine):
                continue
            rows = table.column("row").to_numpy()[mine]
            ids = table.column("id")
            nameless = ids.is_null().to_numpy()[mine]
            ids = ids.fill_null(0).to_numpy()[mine]
            values = v.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
            items = values.astype(self.kind) if self.kind != "O" else np.array(values.tolist(), dtype="O").reshape(len(mine), d)
            step = max(1, CELLS // len(mine))
            order = np.argsort(rows)
            for start in range(0, len(queries), step):
                part = queries[start : start + step]
                s = self.matrix[d][start : start + step] @ items.T if d else np.zeros((len(part), len(mine)), self.kind)
                if self.kind == "O":
                    s = np.minimum(np.maximum(s, LEAST + 1), MOST)
                place = np.searchsorted(rows[order], self.rows[part])
                own = np.flatnonzero((place < len(rows)) & (rows[order][np.minimum(place, len(rows) - 1)] == self.rows[part]))
                s[own, order[place[own]]] = LEAST if self.kind == "O" else -np.inf
                yield part, rows, ids, nameless, s


def _histograms(sent):
    def count(batches):
        import numpy as np
        import pyarrow as pa

        block: Queries = sent.value
        n = len(block.ids)
        need = np.array([block.k - a for a in block.above], dtype=np.int64)
        live = ~np.array(block.short)
        lo = np.array(block.lo, dtype="O" if block.kind == "O" else "f8")
        counts = np.zeros((n, BINS), dtype=np.int64)
        floor = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for part, _, _, _, s in block.scores(batch):
                if block.kind == "O":
                    bins = np.minimum(np.maximum((s - lo[part][:, None]) // block.width, -1), BINS).astype(np.int64)
                else:
                    bins = np.clip(np.floor((s - lo[part].astype(s.dtype)[:, None]) * s.dtype.type(1 / block.width)), -1, BINS).astype(np.int64)
                at, column = np.nonzero((bins >= floor[part][:, None]) & (bins < block.bins) & live[part][:, None])
                if not len(at):
                    continue
                counts[part] += np.bincount(at * BINS + bins[at, column], minlength=len(part) * BINS).reshape(len(part), BINS)
                reached = np.cumsum(counts[part][:, ::-1], axis=1) >= need[part][:, None]
                floor[part] = np.where(reached.any(axis=1), BINS - 1 - reached.argmax(axis=1), 0)
        query, bins = np.nonzero((counts > 0) & (np.arange(BINS)[None, :] >= floor[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts[query, bins]), pa.array(need[query])], ["query", "bin", "n", "need"])

    return count


def _kept(sent):
    """Scores above the kth value, and of those equal to it the missing ones with the smallest ids."""

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        block: Queries = sent.value
        need = np.array([block.k - a for a in block.above], dtype=np.int64)
        short = np.array(block.short)
        kth = np.array(block.lo, dtype="O" if block.kind == "O" else "f8")
        over: list[tuple] = []
        ties: list[tuple] = []

        def least(rows: list[tuple]) -> tuple:
            """Of all equal scores found so far, each query's missing ones by id."""
            query, row, own, nameless, score = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((row, own, nameless, query))
            query = query[order]
            starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
            rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
            chosen = order[rank < need[query]]
            return tuple(x[chosen] for x in (np.concatenate([r[0] for r in rows]), row, own, nameless, score))

        for batch in batches:
            for part, rows, ids, nameless, s in block.scores(batch):
                real = s > LEAST if block.kind == "O" else np.isfinite(s)
                limit = kth[part].astype(s.dtype)[:, None]
                for found, where in ((over, real & (short[part][:, None] | (s > limit))), (ties, real & ~short[part][:, None] & (s == limit))):
                    at, column = np.nonzero(where)
                    if len(at):
                        first = np.searchsorted(at, np.arange(len(part)))
                        if found is ties:  # ids ascend, so a batch needs no more than the first ones
                            few = np.arange(len(at)) - first[at] < need[part[at]]
                            at, column = at[few], column[few]
                        found.append((part[at], rows[column], ids[column], nameless[column], s[at, column].astype(np.int64)))
                if len(ties) > 64:
                    ties = [least(ties)]
        kept = over + ([least(ties)] if ties else [])
        for query, row, own, nameless, score in kept:
            owner = pa.array([block.ids[q] for q in query.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), owner, pa.array(row), pa.array(own, mask=nameless), pa.array(score)], ["query", "query_id", "row", "id", "score"])

    return keep


def _located(counts: DataFrame) -> dict[int, tuple[int, int]]:
    """By query, the highest bin at or above which the needed number of scores lies, and how many lie above it: one row per query of a block."""
    total = counts.groupBy("query", "bin", "need").agg(F.sum("n").alias("n"))
    down = total.withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))
    rows = down.where(F.col("upto") >= F.col("need")).groupBy("query").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("over"))).alias("at")).collect()
    return {r["query"]: (r["at"]["bin"], r["at"]["over"]) for r in rows}


def _blocks(queries: DataFrame, rows: int) -> Iterator[list]:
    """The queries in blocks of at most BLOCK rows and COMPONENTS components; the driver holds one or two blocks."""
    block, size = [], 0
    for row in queries.repartition(-(-rows // BLOCK)).toLocalIterator():
        if block and (len(block) == BLOCK or size + len(row["v"]) > COMPONENTS):
            yield block
            block, size = [], 0
        block.append(row)
        size += len(row["v"])
    if block:
        yield block


def top_k(vectors: DataFrame, wanted: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, id, score of the k best rows for each row that `wanted` selects, itself excepted."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    work = Workspace(spark)
    items = work.written(quantised(vectors, key, vector, wanted, scale), "items")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    head = items.agg(F.max(square).alias("square"), F.count_if("wanted").alias("queries")).first()
    parts = []
    for rows in _blocks(items.where("wanted").select("row", "id", "v"), head["queries"]) if head["queries"] else ():
        block = Queries(rows, k, head["square"] ** 0.5)
        done = False
        while not done:
            sent = spark.sparkContext.broadcast(block)
            done = block.narrow(_located(items.select("row", "id", "v").mapInArrow(_histograms(sent), "query int, bin int, n long, need long")))
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)
        kept = items.select("row", "id", "v").mapInArrow(_kept(sent), FOUND)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
        parts.append(work.write(kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score"), f"found-{len(parts)}"))
        sent.unpersist()
    work.drop("items")
    schema = "query_id long, rank int, id long, score long"
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
