"""N-gram Jaccard join with a count-vector R-tree (operator 9).

Shingles are hashed into `FINE` groups, so a text is a point of group counts. The overlap of two texts is at
most the sum of the coordinate minima of their points, and that of two leaves at most the sum of the
minima of their boxes (of `GROUPS` coarser groups); what the bound lets through is verified on the whole texts.

How it is spread: two sets whose Jaccard similarity reaches the threshold share one of their first
n - ceil(t * n) + 1 shingles in any common order. Shingles of rare words come first, so few texts meet
under a key. Under each key, texts are first compared with one of them (a star, linear in the group);
then leaves of the texts that are not yet connected are joined by their boxes. Pairs inside one component
need no comparison, so a large group of copies costs no square.

Defined cases: null and empty texts have no shingles and link with nothing; a text shorter than a
shingle is one sequence; rows with equal sets are one node; rows that repeat an id are linked through it; a null
id takes part, and its component is the smallest id among the others (null if there is none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjelldoc.llm.common import Workspace, bounded_batches, slices, utf8

#: Groups of a point: enough that copies with a fifth of their words changed are told from linked ones without their texts.
FINE = 128
#: The most that a coordinate shows, so that it is one byte; what a text has above it is `over`, one number a text.
SHOWN = 127
#: Groups of a box; a point's are the sums of those that fall together.
GROUPS = 32
#: Groups of the coarser points that travel with every key.
COARSE = 8
#: Lesser keys that a row carries to see that its pair has met before.
EARLIER = 12
LEAF = 64
#: Cells of the word count by hash; a cell's count is an upper bound of its words' counts.
CELLS = 1 << 18
#: Bits of the filter that thins a join before its shuffle.
BITS = 1 << 23


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased, in order."""
        if len(self) > 1_000_000:
            self.clear()
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_hashes = WordHashes()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words; one for the whole of a shorter sequence."""
    if not len(hashes):
        return hashes
    n = min(size, len(hashes))
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _word_cells(docs: DataFrame, text: str) -> np.ndarray:
    """How many words of the corpus fall in each cell; CELLS numbers, whatever the corpus."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text):
                for t in utf8(part.column(text)):
                    h = _hashes.of(t)
                    if len(h):
                        np.add.at(total, (h >> np.uint64(46)).astype(np.int64), 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    sums = docs.select(text).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS)
    out[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return out


def _points(work: Workspace, docs: DataFrame, key: str, text: str, size: int, num: int, den: int) -> DataFrame:
    """_id, node (hash of the set), n, keys (the shingles it may be found by), point and over for each row."""
    weights = np.minimum(np.round(1.5 * np.log2(1 + _word_cells(docs, text))), 63).astype(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[key].dataType.simpleString()

    def describe(batches):
        import pyarrow as pa

        rarity = sent.value
        for batch in batches:
            for part in slices(batch, text):
                node, n, keys, points, over = [], [], [], [], []
                for t in utf8(part.column(text)):
                    h = _hashes.of(t)
                    own, first = np.unique(shingles(h, size), return_index=True)
                    n.append(len(own))
                    if not len(own):
                        node.append(None)
                        keys.append([])
                        points.append([])
                        over.append(0)
                        continue
                    common = rarity[(h >> np.uint64(46)).astype(np.int64)]
                    width = min(size, len(h))
                    each = [common[first + k] for k in range(width)]
                    # no shingle is in more texts than its rarest word; the order has that first, then all words, then the hash
                    rank = (np.minimum.reduce(each) << np.uint64(9)) | np.minimum(sum(each), 511)
                    order = np.argsort((rank << np.uint64(49)) | (own >> np.uint64(15)), kind="stable")
                    prefix = len(own) - -(-num * len(own) // den) + 1
                    node.append(_node(own))
                    keys.append(own[order[:prefix]].view(np.int64))
                    point = np.minimum(np.bincount((own % np.uint64(FINE)).astype(np.int64), minlength=FINE), SHOWN)
                    points.append(point.astype(np.int8))
                    over.append(len(own) - int(point.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int8())), pa.array(over, pa.int64())],
                    ["_id", "node", "n", "keys", "point", "over"],
                )

    return work.written(docs.select(key, text).mapInArrow(describe, f"_id {kind}, node long, n long, keys array<long>, point array<tinyint>, over long"), "points")


def bound(a: Column, b: Column) -> Column:
    """The greatest overlap two boxes allow."""
    return sum((F.least(a[i], b[i]) for i in range(1, GROUPS)), F.least(a[0], b[0]))


def overlap(a: str, b: str) -> Column:
    """The greatest overlap two points allow, but for what they don't show; a loop, since written-out minima are too long to be compiled."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda most, x: most + x)


def _likely(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key may be among the `_id` of `wanted`; an exact join follows."""
    return docs.where(_may_be(docs, key, wanted))


def _may_be(docs: DataFrame, key: str, wanted: DataFrame) -> Column:
    """Whether a key may be among the `_id` of `wanted`, by a bitmap of BITS bits: false is certain, true is not."""
    bit = F.pmod(F.xxhash64("_id"), F.lit(BITS))
    rows = wanted.select((bit + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()  # BITS / 32768 rows
    table = {r["bucket"]: bytes(r["bits"]) for r in rows}
    sent = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(bits):
        import pandas as pd

        held, out = sent.value, np.zeros(len(bits), dtype=bool)
        b = bits.to_numpy()
        for bucket, own in held.items():
            mine = np.flatnonzero(b // 32768 + 1 == bucket)
            at = b[mine] % 32768
            out[mine] = np.frombuffer(own, np.uint8)[at // 8] >> (at % 8) & 1
        return pd.Series(out)

    return may_be(F.pmod(F.xxhash64(key), F.lit(BITS)))


class Texts:
    """The texts of nodes: found by the id of one of their rows, or by their set where no row has an id."""

    def __init__(self, rows: DataFrame, key: str, text: str, nodes: DataFrame, size: int, nameless: bool):
        self.rows, self.key, self.text, self.nodes, self.size = rows.where(F.col(key).isNotNull()), key, text, nodes.select("node", "_id"), size
        self.nameless = _of_set(rows.where(F.col(key).isNull()).select(F.col(text).alias("text")), size) if nameless else None

    def of(self, sides: DataFrame) -> DataFrame:
        """The rows of `sides` with their node's text; rows of one id may have several, of which the reader takes those of the node's set."""
        named = sides.join(self.nodes, "node")
        held = _likely(self.rows, self.key, named.select("_id")).join(named, F.col(self.key) == F.col("_id")).select(*sides.columns, F.col(self.text).alias("text"))
        if self.nameless is not None:
            held = held.unionByName(named.where("_id is null").join(self.nameless, "node").select(*sides.columns, "text"))
        return held


def _of_set(rows: DataFrame, size: int) -> DataFrame:
    """node, text for each text with words: one row per node."""

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_node(np.unique(shingles(_hashes.of(t), size))) for t in utf8(batch.column(0))]
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0)], ["node", "text"])
            yield out.filter(out.column(0).is_valid())

    return rows.mapInArrow(hashed, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def _node(own: np.ndarray) -> int | None:
    """The hash of a set of shingles."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None


def _verified(pairs: DataFrame, texts: Texts, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    Each b meets its partners in portions of bounded number; a task holds one set of b at a time.
    """
    portions = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).alias("of"))
    dealt = pairs.join(portions, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("of")).alias("portion"))
    sides = dealt.select("b", "portion", F.lit(1).alias("side"), F.col("a").alias("node")).unionByName(dealt.select("b", "portion").distinct().select("b", "portion", F.lit(0).alias("side"), F.col("b").alias("node")))
    rows = texts.of(sides).repartition("b", "portion").sortWithinPartitions("b", "portion", "side").select("b", "side", "node", "text")

    def compare(batches):
        import pyarrow as pa

        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            a, b = [], []
            for of, side, node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                these = np.unique(shingles(_hashes.of(t), size))
                if _node(these) != node:  # another text of the same id
                    continue
                if not side:
                    own = these
                    continue
                both = len(np.intersect1d(own, these, assume_unique=True))
                if den * both >= num * (len(own) + len(these) - both):
                    a.append(node)
                    b.append(of)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, work: Workspace | None = None, name: str = "links") -> DataFrame:
    """u, root: each node of the edges (u, v) but the roots with the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; each step is a minimum per node and a join.
    """
    work = work or Workspace(edges.sparkSession)
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    links = work.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    before, step = mark(links), 0
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        step += 1
        links = work.written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        now = mark(links)
        if now == before:
            return links.select("u", F.col("v").alias("root"))
        before = now


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _coarse(point: Column, at: int, groups: int = COARSE) -> Column:
    """One coordinate of a point of fewer groups: the sum of the groups that fall together."""
    own = [point[i].cast("bigint") for i in range(at, FINE, groups)]
    return sum(own[1:], own[0])


def _other_pairs(work: Workspace, members: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one key and two components whose sizes, boxes and points allow a link.

    Keys of more than LEAF texts are cut into leaves by size, and leaves whose boxes can't link don't meet.
    A pair that shares several keys meets under the least of them: each row carries up to EARLIER of its text's lesser
    keys. A pair whose first common key is not among those may meet more than once, and is one pair at the end.
    """
    c = F.col
    coarse = [f"c{i}" for i in range(COARSE)]
    crowd = members.groupBy("key").agg(F.ceil(F.count("*") / LEAF).alias("of"))
    own = members.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("own"))  # at most the keys of one text
    earlier = F.slice("own", F.lit(1), F.least(F.array_position("own", c("key")).cast("int") - 1, F.lit(EARLIER)))
    leaf = F.floor(F.log(c("n").cast("double")) * 10) * (1 << 24) + F.pmod(F.xxhash64("node"), c("of"))
    # keys first and points last, so that points are moved by text and not once a key
    dealt = members.join(crowd, "key").join(own, "node").join(nodes.select("node", "n", "point", "over", *[_coarse(c("point"), i).alias(x) for i, x in enumerate(coarse)]), "node")
    dealt = dealt.select("key", "node", "root", "n", "point", "over", earlier.alias("earlier"), *coarse, F.when(c("of") > 1, leaf).otherwise(F.lit(0)).alias("leaf"), (c("of") > 1).alias("crowded"))
    leaves = work.written(dealt, "leaves")

    def allowed(a: str, b: str) -> Column:
        x, y = (lambda name: c(f"{a}.{name}")), (lambda name: c(f"{b}.{name}"))
        unseen, wanted = F.least(x("over"), y("over")), num * (x("n") + y("n"))
        minima = [F.least(x(name), y(name)) for name in coarse]
        able = (x("root") != y("root")) & (den * x("n") >= num * y("n")) & (den * y("n") >= num * x("n"))
        able &= (num + den) * (sum(minima, unseen)) >= wanted
        able &= ~F.arrays_overlap(x("earlier"), y("earlier"))
        # the few pairs left by the coarse sums meet the whole points
        return able & ((num + den) * (overlap(f"{a}.point", f"{b}.point") + unseen) >= wanted)

    found = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]
    # texts of a key that is no crowd meet at once: both sides are one shuffle
    few = leaves.where("not crowded").drop("leaf", "crowded")
    pairs = few.alias("a").join(few.alias("b"), c("a.key") == c("b.key")).where((c("a.node") < c("b.node")) & allowed("a", "b")).select(*found)
    many = leaves.where("crowded").drop("crowded")
    boxes = many.groupBy("key", "leaf").agg(
        F.array(*[F.max(_coarse(c("point"), i, GROUPS)) for i in range(GROUPS)]).alias("box"), F.max("over").alias("over"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("root0"), F.max("root").alias("root1")
    )
    x, y = boxes.alias("x"), boxes.alias("y")
    near = (c("x.key") == c("y.key")) & (c("x.leaf") <= c("y.leaf"))
    near &= (den * c("x.most") >= num * c("y.least")) & (den * c("y.most") >= num * c("x.least"))
    near &= (num + den) * (bound(c("x.box"), c("y.box")) + F.least("x.over", "y.over")) >= num * (c("x.least") + c("y.least"))
    near &= (c("x.root0") != c("x.root1")) | (c("y.root0") != c("y.root1")) | (c("x.root0") != c("y.root0"))
    meeting = x.join(y, near).select(c("x.key").alias("key"), c("x.leaf").alias("leaf"), c("y.leaf").alias("other"))
    sides = meeting.alias("m").join(many.alias("a"), (c("m.key") == c("a.key")) & (c("m.leaf") == c("a.leaf")))
    sides = sides.join(many.alias("b"), (c("m.key") == c("b.key")) & (c("m.other") == c("b.leaf"))).where(((c("m.leaf") != c("m.other")) | (c("a.node") < c("b.node"))) & allowed("a", "b"))
    return pairs.unionByName(sides.select(*found)).distinct()


def _within_bound(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sizes and points allow a link."""

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("point").alias(f"p_{name}"), F.col("over").alias(f"o_{name}"))

    n, m = F.col("n_a"), F.col("n_b")
    described = pairs.join(side("a"), "a").join(side("b"), "b").where((den * n >= num * m) & (den * m >= num * n))
    return described.where((num + den) * (overlap("p_a", "p_b") + F.least("o_a", "o_b")) >= num * (n + m)).select("a", "b")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links of num/den or more) for each row."""
    bounded_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession)
    rows = docs.select(key, text)
    points = _points(work, rows, key, text, size, num, den)
    keyed = points.where("n > 0").select("node", F.explode("keys").alias("key"))
    # one shuffle of the keys, not one to find the shared ones and another to meet them
    of_key = Window.partitionBy("key")
    shared = keyed.withColumns({"lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key)}).where("lo < hi")
    members = work.written(shared.select("node", "key").distinct(), "members")
    described = points.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min_by(F.struct("n", "point", "over"), F.coalesce("_id", F.lit(0))).alias("d"), F.min("_id").alias("_id"))
    nodes = work.written(described.select("node", "d.*", "_id"), "nodes")
    texts = Texts(rows, key, text, nodes, size, nodes.where("_id is null").limit(1).count() > 0)
    # a star per key around the text that shares the most keys: an original, if the others are its copies
    weights = members.groupBy("node").agg(F.count("*").alias("w"))
    centres = members.join(weights, "node").groupBy("key").agg(F.max(F.struct("w", "node"))["node"].alias("b"))
    star = members.join(centres, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    star = work.written(_within_bound(star, nodes, num, den), "star")
    first = work.written(_verified(star, texts, size, num, den), "first")
    rooted = _with_roots(members, components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), work, "first-links"))
    # keys with the same texts are one key; a key inside one component needs no comparison
    same = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("texts"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    split = same.where("lo < hi").groupBy("texts", "x", "s").agg(F.min("key").alias("key")).select("key")
    crowd = work.written(rooted.join(split, "key"), "crowd")
    work.drop("members")
    # written before the star's pairs are left out, else they would be looked for once a key
    rest = work.written(_other_pairs(work, crowd, nodes, num, den), "rest")
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = work.written(rest.join(tried, ["a", "b"], "left_anti"), "left")
    second = work.written(_verified(left, texts, size, num, den), "second")
    same_id = points.where("_id is not null and n > 0").groupBy("_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u < v")
    same_id = points.where("n > 0").join(same_id.select("_id", "u"), "_id").select("u", F.col("node").alias("v")).where("u <> v").distinct()
    links = first.unionByName(second).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same_id)
    named = points.where("n > 0").groupBy("node").agg(F.min("_id").alias("_id"))
    roots = _with_roots(named, components(links, work, "all-links"))
    smallest = roots.groupBy("root").agg(F.min("_id").alias("component_id"))
    of_node = roots.join(smallest, "root").select("node", "component_id")
    out = points.select("_id", "n", "node").join(of_node, "node", "left")
    out = out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    out = work.written(out, "out")
    work.drop_all_but("out")
    return out


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class of like texts, the one with the smallest id (null last; the first of equal ones); rows without words stay.

    Rows are numbered, so neither a null nor a repeated id makes two rows one.
    """
    work = Workspace(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = work.written(docs.select(row, F.monotonically_increasing_id().alias("number")), "rows")
    classes = near_components(rows.select("number", F.col(f"row.`{text}`").alias("text")), "number", "text", size, num, den).select("number", "component_id")
    ids = rows.select("number", F.struct(F.col(f"row.`{key}`").isNull().alias("nameless"), F.col(f"row.`{key}`").alias("id"), F.col("number").alias("n")).alias("order"))
    classes = work.written(classes.join(ids, "number").select("component_id", "order"), "classes")
    first = classes.groupBy("component_id").agg(F.min("order")["n"].alias("number"))
    dropped = work.written(classes.select(F.col("order")["n"].alias("number")).join(first, "number", "left_anti"), "dropped")
    # few rows are dropped; only those that may be are moved to meet the exact list
    doubtful = _may_be(rows, "number", dropped.select(F.col("number").alias("_id")))
    kept = rows.where(~doubtful).unionByName(rows.where(doubtful).join(dropped, "number", "left_anti"))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
