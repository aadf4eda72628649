"""Benchmark decontamination (operator 1).

Test items form a BM25 inverted index with block maxima. Every training passage is a query: blocks of
items whose upper bound stays below the threshold are skipped for all passages of a batch at once, and a
WAND walk over the posting lists of the blocks left finds the items above it. Impacts are divided by
the item's own total, so a score is the share of the item's BM25 mass that a passage holds, and one
threshold fits all items. What is retrieved is verified: the passage must hold the question's and the
answer's words in order, each in a window little longer than it, or nearly all words of both.

The index is broadcast in parts of at most about `PART_WORDS` item words; each part is one pass over the documents, after
the one before it, so a worker holds one index (some 50 MB of bounds) whatever the number of items.

Defined cases: null and empty texts have no passages, null and empty items are never found; items
with equal texts are all reported; rows that repeat are judged one by one; a text of any length is read
whole, in overlapping passages of twice the longest item; items of fewer than `LEAST` words say too little to be a leak
and are left out unless asked for; no column name of the documents can clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjelldoc.llm.common import Workspace, bounded_batches

PART_WORDS = 100_000
K1, B = 1.2, 0.75
#: Share of an item's BM25 mass that retrieves it, and shares of its question's and answer's words that confirm it.
RETRIEVE, QUESTION, ANSWER = 0.6, 0.6, 0.6
#: Share of all its words that confirms an item whatever the parts hold.
NEARLY_ALL = 0.8
#: Words of a sequence; a part of fewer is measured together with the other one.
SEQUENCE = 5
#: A part of at least so many words may miss more than one of them.
SHORT = 10
#: Words of an item that can be leaked.
LEAST = 5
BLOCK = 4
LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double,first_word:bigint>>"

_word = re.compile(r"\w+")
_sentence = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before the last sentence and those of the last sentence; one sentence is all question."""
    parts = [w for s in _sentence.split(text) if (w := words(s))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def sequences(of: list[str], n: int = SEQUENCE) -> set[tuple[str, ...]]:
    return {tuple(of[i : i + n]) for i in range(max(1, len(of) - n + 1))} if of else set()


def in_order(wanted: list[str], passage: list[str]) -> int:
    """How many words of `wanted` a window of the passage has in the same order, at most.

    A window may be an eighth longer than the words on either side. The longest common subsequence is
    counted with one bit per wanted word, however many there are.
    """
    n, slack = len(wanted), max(2, len(wanted) // 8)
    masks: dict[str, int] = {}
    for i, w in enumerate(wanted):
        masks[w] = masks.get(w, 0) | 1 << i
    held = [(j, masks[w]) for j, w in enumerate(passage) if w in masks]
    places, full, best = [j for j, _ in held], (1 << n) - 1, 0
    for first in range(-slack, len(passage), slack):
        lo, hi = bisect_left(places, first), bisect_left(places, first + n + 2 * slack)
        if hi - lo <= best:
            continue
        left = full
        for _, mask in held[lo:hi]:
            both = left & mask
            left = ((left + both) | (left - both)) & full
        best = max(best, n - left.bit_count())
        if best == n:
            break
    return best


@dataclass
class Item:
    item_id: int
    question: set
    answer: set
    counts: Counter
    question_words: list
    answer_words: list


class Index:
    """Posting lists of normalised BM25 impacts in blocks of `BLOCK` items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], total: int, mean: float):
        import numpy as np

        self.np = np
        self.items, self.longest = [], 0
        for item_id, text in items:
            question, answer = question_and_answer(text)
            own = Counter(question + answer)
            if own:
                self.items.append(Item(item_id, sequences(question), sequences(answer), own, question, answer))
                self.longest = max(self.longest, sum(own.values()))
        self.items.sort(key=lambda item: (sum(item.counts.values()), item.item_id))  # items of one block have like impacts
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for number, item in enumerate(self.items):
            length = sum(item.counts.values())
            impacts = {}
            for term, n in item.counts.items():
                df = frequency[term]
                idf = float(np.log(1 + (total - df + 0.5) / (df + 0.5)))
                impacts[term] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
            mass = sum(impacts.values())
            for term, impact in impacts.items():
                at = self.terms.setdefault(term, len(postings))
                if at == len(postings):
                    postings.append([])
                postings[at].append((number, impact / mass))
        blocks = -(-len(self.items) // BLOCK)
        #: the greatest impact of a term in each block; the last row is that of words in no item
        self.maxima = np.zeros((len(postings) + 1, max(1, blocks)), dtype="float32")
        self.lists: list[dict[int, tuple[list[int], list[float]]]] = []
        for t, rows in enumerate(postings):
            own: dict[int, tuple[list[int], list[float]]] = {}
            for number, impact in rows:
                items_, impacts_ = own.setdefault(number // BLOCK, ([], []))
                items_.append(number)
                impacts_.append(impact)
                self.maxima[t, number // BLOCK] = max(self.maxima[t, number // BLOCK], impact)
            self.lists.append(own)
        self.maxima *= np.float32(1.00001)  # rounding must not lower a bound

    def block_walk(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """WAND over one block: the items whose score reaches the threshold."""
        lists = [(float(self.maxima[t, block]), *self.lists[t][block]) for t in terms if block in self.lists[t]]
        at = [0] * len(lists)
        out = []
        while True:
            live = sorted((lists[i][1][at[i]], i) for i in range(len(lists)) if at[i] < len(lists[i][1]))
            bound, pivot = 0.0, None
            for number, i in live:
                bound += lists[i][0]
                if bound >= threshold:
                    pivot = number
                    break
            if pivot is None:
                return out
            if live[0][0] == pivot:
                score = 0.0
                for number, i in live:
                    if number != pivot:
                        break
                    score += lists[i][2][at[i]]
                    at[i] += 1
                if score >= threshold:
                    out.append((pivot, score))
            else:
                for number, i in live:
                    if number >= pivot:
                        break
                    at[i] = bisect_left(lists[i][1], pivot, at[i])

    def leaks(self, texts: list[str | None], threshold: float, question: float, answer: float) -> list[list[dict]]:
        """Verified items of each text, each with its best passage; the bounds of all texts are made at once.

        A passage is a step of as many words as the longest item has, and the step after it, so any run of
        that many words lies whole in one passage.
        """
        np = self.np
        step, absent = max(1, self.longest), len(self.terms)
        found = [words(t) if t else [] for t in texts]
        out: list[dict[int, dict]] = [{} for _ in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        if not self.items or not lengths.sum():
            return [[] for _ in texts]
        ids = np.fromiter(map(self.terms.get, chain.from_iterable(found), repeat(absent)), dtype=np.int64, count=int(lengths.sum()))
        steps = -(-lengths // step)
        starts, first_step = np.cumsum(lengths) - lengths, np.cumsum(steps) - steps
        text_of = np.repeat(np.arange(len(texts)), lengths)
        place = np.flatnonzero(ids < absent)
        within = (place - starts[text_of[place]]) // step
        here, width = first_step[text_of[place]] + within, absent + 1
        inner = within > 0
        own = np.unique(np.concatenate([here * width + ids[place], (here[inner] - 1) * width + ids[place][inner]]))  # each term once a passage
        if not len(own):
            return [[] for _ in texts]
        at, first = np.unique(own // width, return_index=True)
        bounds = np.add.reduceat(self.maxima[own % width], first, axis=0)
        ends = np.append(first[1:], len(own))
        for row, block in zip(*np.nonzero(bounds >= threshold), strict=True):
            passage = int(at[row])
            text = int(np.searchsorted(first_step, passage, side="right")) - 1
            start = (passage - int(first_step[text])) * step
            terms = (own[first[row] : ends[row]] % width).tolist()
            held = None
            for number, score in self.block_walk(terms, int(block), threshold):
                own_words = found[text][start : start + 2 * step]
                held = held if held is not None else sequences(own_words)
                item, best = self.items[number], out[text]
                if number in best and score <= best[number]["score"]:
                    continue
                confirmed, q, a = self._verified(item, held, own_words, question, answer)
                if confirmed:
                    best[number] = {"item_id": item.item_id, "score": score, "question": q, "answer": a, "first_word": start}
        return [[best[n] for n in sorted(best)] for best in out]

    def _verified(self, item: Item, held: set, passage: list[str], question: float, answer: float) -> tuple[bool, float, float]:
        """Whether the passage holds the item, and the shares of its question and answer that it holds."""
        q = self._share(item.question, held, passage)
        a = self._share(item.answer, held, passage) if item.answer else 1.0
        if q >= question and a >= answer:
            return True, q, a
        asked, answered = item.question_words, item.answer_words
        if min(len(asked), len(answered)) >= SEQUENCE:
            parts = [(asked, question), (answered, answer)]
        elif len(asked) + len(answered) >= SEQUENCE:
            parts = [(asked + answered, question)]
        else:
            return False, q, a
        counts = [in_order(part, passage) for part, _ in parts]
        shares = [n / len(part) for n, (part, _) in zip(counts, parts, strict=True)]
        if len(parts) == 2:
            q, a = max(q, shares[0]), max(a, shares[1])
        else:
            q = max(q, shares[0])
        enough = all(s >= least and (len(part) >= SHORT or n + 1 >= len(part)) for n, s, (part, least) in zip(counts, shares, parts, strict=True))
        return enough or sum(counts) >= NEARLY_ALL * (len(asked) + len(answered)), q, a

    @staticmethod
    def _share(wanted: set, held: set, passage: list[str]) -> float:
        n = len(next(iter(wanted)))
        if n < SEQUENCE:  # a part shorter than a sequence is one sequence of its own length
            held = sequences(passage, n)
        return len(wanted & held) / len(wanted)


def item_parts(items: DataFrame, item_id: str = "item_id", text: str = "text", least: int = LEAST) -> tuple[int, Iterator[dict]]:
    """The number of parts, and one after another what the index of each needs: items, document frequencies of their terms, item count and mean length.

    Frequencies are counted by Spark over all items; a part has at most about PART_WORDS words, and the driver holds one.
    """
    full = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    counted = full.withColumn("w", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"))).where(F.size("w") >= max(1, least))
    head = counted.agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("words")).first()
    if not head["n"]:
        return 0, iter(())
    parts = -(-head["words"] // PART_WORDS) or 1
    seen = counted.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def each() -> Iterator[dict]:
        for part in range(parts):
            mine = counted.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
            terms = mine.select(F.explode(F.array_distinct("w")).alias("t")).distinct()
            rows = [(r["id"], r["text"]) for r in mine.select("id", "text").collect()]
            yield {"items": sorted(rows), "df": {r["t"]: r["df"] for r in seen.join(terms, "t").collect()}, "n": head["n"], "mean": head["words"] / head["n"]}

    return parts, each()


_built: dict[int, Index] = {}


def _index(sent) -> Index:
    """The index of the broadcast at hand; a worker keeps no other."""
    if sent.id not in _built:
        _built.clear()
        part = sent.value
        frequency = Counter(t for _, text in part["items"] for t in set(words(text)))
        frequency.update({t: part["df"][t] - n for t, n in frequency.items() if t in part["df"]})
        _built[sent.id] = Index(part["items"], frequency, part["n"], part["mean"])
    return _built[sent.id]


class _Sent:
    """A broadcast value with an id that workers can keep its index under."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"id": self.id, "broadcast": self.broadcast}

    @property
    def value(self):
        return self.broadcast.value


def _finder(sent: _Sent, threshold: float, question: float, answer: float):
    @F.arrow_udf(LEAK)
    def leaks(column):
        import pyarrow as pa

        index, texts, found = _index(sent), column.to_pylist(), []
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= 1 << 20 or i + 1 == len(texts):
                found += index.leaks(texts[start : i + 1], threshold, question, answer)
                start, size = i + 1, 0
        return pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())])))

    return leaks


def _judged(docs: DataFrame, items: DataFrame, text: str, threshold: float, question: float, answer: float, least: int) -> DataFrame:
    """row (all columns) and leaks; with several parts of the index the rows are written after each pass."""
    bounded_batches(docs.sparkSession)
    parts, each = item_parts(items, least=least)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.array().cast(LEAK).alias("leaks"))
    work = Workspace(docs.sparkSession)
    for i, part in enumerate(each):
        find = _finder(_Sent(docs.sparkSession, part), threshold, question, answer)
        rows = rows.withColumn("found", find(F.col("row")[text])).select("row", F.concat("leaks", "found").alias("leaks"))
        if parts > 1:
            rows = work.written(rows, f"pass-{i}")
            work.drop(f"pass-{i - 1}")
    return rows


def with_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", threshold: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER, least: int = LEAST) -> DataFrame:
    """The rows with a column `out` of verified leaks, one struct per item; it takes the place of a column of that name."""
    rows = _judged(docs, items, text, threshold, question, answer, least)
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], F.col("leaks").alias(out))


def found_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document and item: key, item_id, score, question, answer, first_word."""
    rows = _judged(docs.select(key, text), items, text, RETRIEVE, QUESTION, ANSWER, least)
    return rows.select(F.col("row")[key].alias(key), F.explode("leaks").alias("leak")).select(key, "leak.*")


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """The documents in which no item was found, with their columns."""
    rows = _judged(docs, items, text, RETRIEVE, QUESTION, ANSWER, least)
    return rows.where(F.size("leaks") == 0).select(*[F.col("row")[c].alias(c) for c in docs.columns])
