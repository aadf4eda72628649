"""Ranked lexical search by bag deduplication (operator 13).

A text is reduced to the counts of the items' words in it and to its length class m; nothing else of it enters a
score. Texts with the same counts and m are one class: classes are keyed by a hash and verified by their whole
counts. Each class is scored once against all items, and the best classes are expanded to their texts by
ascending id.

How it is spread: one pass over the texts counts words where they lie, with the items' words in a broadcast of at most
`PART_TERMS` terms (more terms are more passes, joined by row). One exchange makes the classes; a class that holds
a third of all texts is counted before it. Items go to the classes in broadcasts of at most `PART_ENTRIES`
pairs of item and term, one after another; a task returns the k best classes of each item, and of a class the k
texts of smallest id are kept per task, so ranking needs no more than k rows a task and item.

Words in many items are multiplied as a matrix, the others are walked in posting lists; sums are exact (floats only
where all sums stay below 2 ** 53, else 64-bit integers).

Defined cases: null and empty texts and items have no terms and no rows; each row of the items is an item, each row
of the documents a document, also when ids repeat; null doc_ids sort last; fewer than k texts above 0 are
all returned; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import string
from itertools import repeat

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fjelldoc.llm.common import Workspace, bounded_batches, slices, utf8

#: Characters that are in no term, as bytes; terms are what stands between them, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PART_TERMS, PART_ENTRIES = 500_000, 500_000
#: Numbers that a task holds at once, and the share of items above which a word's list is a row of the matrix.
CELLS, COMMON = 1 << 20, 0.05
#: Hashes of wanted classes (16 bytes each) that are broadcast; beyond it they are joined by an exchange.
SMALL = 1 << 17

_plain = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits else 32 if b < 128 else b for b in range(256))


def _number(text: bytes | None) -> list[bytes]:
    """The terms of a text."""
    return text.translate(_plain).split() if text else []


def _terms(text: str):
    return F.regexp_extract_all(F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase), F.lit(f"({TERM})"))


def _counted(rows: DataFrame, sent, first: int) -> DataFrame:
    """row, id, n, bag for each text with a term: bag holds (term number, count) as 32-bit pairs by number."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        number = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                lengths, numbers = [], []
                for text in utf8(part.column("text")):
                    found = _number(text)
                    lengths.append(len(found))
                    numbers.append(np.fromiter(map(number.get, found, repeat(-1)), dtype=np.int64, count=len(found)))
                every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                held = every >= 0
                keys, counts = np.unique(owner[held] << 32 | every[held] + first, return_counts=True)
                pairs = np.column_stack([keys & 0xFFFFFFFF, counts]).astype("<u4").tobytes()
                ends = np.searchsorted(keys, np.arange(len(lengths) + 1) << 32).astype(np.int32) * 8
                bags = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
                out = pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(lengths, pa.int64()), bags], ["row", "id", "n", "bag"])
                yield out.filter(pa.array(np.array(lengths) > 0))

    return rows.mapInArrow(count, "row long, id long, n long, bag binary")


def _frequencies(classes: DataFrame) -> DataFrame:
    """term, df over all documents, from the classes and their sizes."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bags = [np.frombuffer(b"".join(b), "<u4")[::2] for b in batch.column("bags").to_pylist()]
            sizes = np.repeat(batch.column("texts").to_numpy(), [len(b) for b in bags])
            terms, at = np.unique(np.concatenate(bags), return_inverse=True) if bags else (np.zeros(0), np.zeros(0, int))
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, at, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(total)], ["number", "df"])

    return classes.select("bags", "texts").mapInArrow(count, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))


class Scorer:
    """A bounded part of the items: their terms' weights, a matrix of the common terms and lists of the others."""

    def __init__(self, entries: list, k: int):
        import numpy as np

        self.k = k
        self.items = sorted({e["item"] for e in entries})
        place = {item: i for i, item in enumerate(self.items)}
        self.numbers = np.array(sorted({e["number"] for e in entries}), dtype=np.int64)
        term = np.searchsorted(self.numbers, [e["number"] for e in entries])
        item = np.array([place[e["item"]] for e in entries], dtype=np.int64)
        times = np.array([e["times"] for e in entries], dtype=np.int64)
        self.weights = np.zeros(len(self.numbers), np.int64)
        self.weights[term] = [e["weight"] for e in entries]
        most = np.zeros(len(self.items))
        np.add.at(most, item, times * self.weights[term] * 1e6)  # a count's factor is below 10 ** 6
        self.kind = np.float64 if most.max(initial=0) < 1 << 53 else np.int64
        spread = np.bincount(term, minlength=len(self.numbers))
        often = spread > max(8, COMMON * len(self.items))
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((int(often.sum()), len(self.items)), dtype=self.kind)
        common = often[term]
        self.matrix[self.column[term[common]], item[common]] = times[common]
        order = np.argsort(term[~common], kind="stable")
        self.item, self.times = item[~common][order], times[~common][order]
        listed = np.where(often, 0, spread)
        self.ends = np.cumsum(listed)
        self.starts, self.listed = self.ends - listed, listed

    def scores(self, bags: list[bytes], m):
        """Scores of classes (rows) for the items (columns)."""
        import numpy as np

        pairs = [np.frombuffer(b, "<u4").reshape(-1, 2).astype(np.int64) for b in bags]
        row = np.repeat(np.arange(len(bags)), [len(p) for p in pairs])
        number, times = np.concatenate(pairs).T
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        mine = self.numbers[at] == number
        row, at, times = row[mine], at[mine], times[mine]
        impact = self.weights[at] * ((1_000_000_000 * times) // (1000 * times + 12 * m[row]))
        common = self.column[at] >= 0
        dense = np.zeros((len(bags), len(self.matrix)), dtype=self.kind)
        dense[row[common], self.column[at[common]]] = impact[common]
        out = dense @ self.matrix
        row, at, impact = row[~common], at[~common], impact[~common]
        sizes = self.listed[at]
        place = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        cell, values = np.repeat(row * len(self.items), sizes) + self.item[place], np.repeat(impact, sizes) * self.times[place]
        if self.kind is np.float64:
            out += np.bincount(cell, weights=values, minlength=out.size).reshape(out.shape)
        else:
            np.add.at(out.reshape(-1), cell, values)
        return out


def _best(sent):
    """The k best classes of each item: by score, then by their first text."""

    def rank(batches):
        import numpy as np
        import pyarrow as pa

        scorer: Scorer = sent.value
        k, n = scorer.k, len(scorer.items)
        held = [np.zeros(0, np.int64)] * 5  # item, score, nameless, id, class
        least = np.ones(n)

        def pruned(rows):
            item, score, nameless, first, row = rows
            order = np.lexsort((row, first, nameless, -score, item))
            starts = np.searchsorted(item[order], np.arange(n))
            keep = order[np.arange(len(order)) - starts[item[order]] < k]
            return [x[keep] for x in rows]

        for batch in batches:
            step = max(1, CELLS // max(n, len(scorer.matrix), 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                s = scorer.scores([b"".join(b) for b in part.column("bags").to_pylist()], part.column("m").to_numpy())
                if len(s) > k:
                    least = np.maximum(least, np.partition(s, len(s) - k, axis=0)[len(s) - k])
                at, item = np.nonzero(s >= least[None, :])
                first = part.column("first")
                nameless = first.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                new = [item, s[at, item].astype(np.int64), nameless[at], first.fill_null(0).to_numpy(zero_copy_only=False)[at], part.column("class").to_numpy()[at]]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
                if len(held[0]) > 4 * n * k + 10_000:
                    held = pruned(held)
                    full = np.bincount(held[0], minlength=n) >= k
                    worst = np.full(n, np.inf)
                    np.minimum.at(worst, held[0], held[1])
                    least = np.where(full, np.maximum(least, worst), least)
        item, score, _, _, row = pruned(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(scorer.items, dtype=np.int64)[item]), pa.array(score), pa.array(row)], ["item", "score", "class"])

    return rank


def _parts(spark, wanted: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows with a part number so that a part has about `most` rows, all rows of a `deal` value in one part."""
    parts = -(-wanted.count() // most) or 1
    return wanted.withColumn("part", F.pmod(F.xxhash64("deal"), F.lit(parts))), parts


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    bounded_batches(spark)
    work = Workspace(spark)
    asked = work.written(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_key).cast("bigint").alias("item_id"), _terms(item_text).alias("terms")), "items")
    entries = asked.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
    terms, passes = _parts(spark, work.written(entries.select(F.col("term").alias("deal")).distinct(), "terms"), PART_TERMS)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    if passes > 1:  # row numbers must be the same in each pass
        rows = work.written(rows, "rows")
    first, numbered, bags = 0, [], []
    for i in range(passes):
        own = sorted(r["deal"] for r in terms.where(F.col("part") == i).select("deal").collect())  # about PART_TERMS at most
        number = {t.encode(): j for j, t in enumerate(own)}
        sent = spark.sparkContext.broadcast(number)
        bags.append(work.written(_counted(rows, sent, first), f"bags-{i}"))
        sent.unpersist()
        numbers = spark.createDataFrame([(t, first + j) for j, t in enumerate(own)], "term string, number long")
        numbered.append(work.written(numbers, f"numbers-{i}"))
        first += len(own)
    bag = bags[0].select("row", "id", "n", F.array("bag").alias("bags"))
    numbers = numbered[0]
    if passes > 1:
        every = bags[0].withColumn("i", F.lit(0))
        for i, more in enumerate(bags[1:], 1):
            every, numbers = every.unionByName(more.withColumn("i", F.lit(i))), numbers.unionByName(numbered[i])
        joined = every.groupBy("row", "id", "n").agg(F.sort_array(F.collect_list(F.struct("i", "bag"))).alias("parts"))  # one per pass
        bag = joined.select("row", "id", "n", F.transform("parts", lambda p: p["bag"]).alias("bags"))
    total = bags[0].agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
    m = F.expr(f"75L + (25L * n * {total['texts']}L) div {total['terms']}L")
    held = F.exists("bags", lambda b: F.length(b) > 0)
    keyed = bag.where(held).withColumn("m", m).withColumn("hash", F.xxhash64("m", "bags"))
    named = F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("row"))
    classes = keyed.groupBy("hash", "m", "bags").agg(F.count("*").alias("texts"), F.min(named).alias("least"))
    classes = work.written(classes.select("hash", "m", "bags", "texts", F.col("least.id").alias("first"), F.col("least.row").alias("class")), "classes")
    df = _frequencies(classes)
    weight = F.floor(1000 * F.log((F.lit(2.0) * total["texts"] + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = entries.join(numbers, "term").join(df, "number").select("item", "number", "times", weight.alias("weight"), F.col("item").alias("deal"))
    dealt, rounds = _parts(spark, work.written(weighed, "weighed"), PART_ENTRIES)
    found = []
    for i in range(rounds):
        part = dealt.where(F.col("part") == i).select("item", "number", "times", "weight").collect()  # about PART_ENTRIES at most
        if not part:
            continue
        sent = spark.sparkContext.broadcast(Scorer(part, k))
        best = classes.select("class", "first", "m", "bags").mapInArrow(_best(sent), "item long, score long, class long")
        found.append(work.write(best, f"best-{i}"))
        sent.unpersist()
    schema = "item_id long, rank int, doc_id long, score long"
    if not found:
        return spark.createDataFrame([], schema)
    best = spark.read.schema("item long, score long, class long").parquet(*found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("first.nameless"), F.col("first.id"), "class")
    named = classes.select("class", F.struct(F.col("first").isNull().alias("nameless"), F.col("first").alias("id")).alias("first"), "hash", "m", "bags")
    top = best.join(named, "class").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    top = work.written(top.select("item", "score", "class", "hash", "m", "bags"), "top")
    # texts of the best classes, at most k a class: the hash finds them, the whole bag confirms them
    wanted = top.select("hash", "m").distinct()
    if top.count() <= SMALL:
        wanted = F.broadcast(wanted)
    inside = Window.partitionBy("hash", "m", "bags").orderBy(F.asc_nulls_last("id"), "row")
    few = keyed.select("row", "id", "m", "bags", "hash").join(wanted, ["hash", "m"], "left_semi").withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k)
    chosen = few.select("row", "id", "hash", "m", "bags").join(top, ["hash", "m", "bags"]).select("item", "score", "id", "row")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = chosen.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    out = ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
    out = work.written(out, "out")
    work.drop("items", "terms", "rows", "classes", "weighed", "top", *[f"{name}-{i}" for name in ("bags", "numbers") for i in range(passes)], *[f"best-{i}" for i in range(rounds)])
    return out
