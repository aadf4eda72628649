"""Top-k search, conversation repair and lexical search against brute force, on rows with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fjelldoc.llm import bag_search, histogram_topk, turn_repair

rng = random.Random(11)


# -- top k -------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, row long, id long, v string, rank int, score string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3, "s") for i, v in rows], VECTORS)


def best(rows, k, scale=256):
    """By query row: the scores and ids of its k best other rows."""
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(usable):
        if i is not None and i % 50 == 0:
            scored = [(max(min(sum(a * b for a, b in zip(v, w, strict=True)), (1 << 63) - 1), 1 - (1 << 63)), j) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v)]
            scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(frame, k=5):
    rows = histogram_topk.top_k(frame, F.col("vec_id") % 50 == 0, k=k).collect()
    return sorted([(r.query_id, r.rank, r.id, r.score) for r in rows], key=str)


def test_top_k_with_ties_nulls_and_lengths(spark):
    same = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, same) for i in range(1000, 1400)]  # a third of all rows, ties of many queries
    rows += [(50, same), (50, [1.0] * 8), (None, [0.5] * 8), (None, same), (7, None), (100, [1.0, None]), (150, [math.nan] * 8), (200, [math.inf] * 8), (250, [1.0, 2.0]), (251, [3.0, -2.0]), (300, [])]
    assert found(vector_frame(spark, rows).repartition(5)) == best(rows, 5)
    assert found(vector_frame(spark, rows[:3]), 5) == best(rows[:3], 5)


def test_top_k_of_wide_values(spark):
    """Sums beyond 2 ** 24 and 2 ** 53 are exact, beyond 64 bits the nearest."""
    for size in (1e3, 2e6, 1e15):
        rows = [(i * 25, [rng.uniform(-size, size) for _ in range(6)]) for i in range(40)]
        assert found(vector_frame(spark, rows)) == best(rows, 5), size


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(histogram_topk, "BLOCK", 3)
    rows = [(i * 10, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    assert found(vector_frame(spark, rows).repartition(3)) == best(rows, 5)


def test_top_k_of_nothing(spark):
    assert found(vector_frame(spark, [])) == []
    assert found(vector_frame(spark, [(1, [1.0]), (2, [2.0])])) == []


# -- conversations -----------------------------------------------------------------

TALKS = "conv_id long, turn long, role string, text string, copy int, fault int, digest string, kind int"
LEGAL = re.compile(r"(s?(ua)+)?")


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "d", 9) for r in rows], TALKS)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text, copy) for copy in range(0 if code == 0 else 2 if code == 3 else 1)]
    return out


def shortest(faults, initials):
    """Cost, initials of the edits and roles, by trying all edits of each message and up to two inserts around it."""
    paths = {"": (0, "", ())}  # by the state reached: the least (cost, initials)
    paths = [(0, "", "", ())]

    def inserts(now):
        more = list(now)
        for _ in range(2):
            now = [(c + 3, a + "I", r + x, n + (x,)) for c, a, r, n in now for x in "ua"]
            more += now
        return [p for p in more if LEGAL.fullmatch(p[2]) or LEGAL.fullmatch(p[2] + "a") or LEGAL.fullmatch(p[2] + "ua")]

    for fault, initial in zip(faults, initials, strict=True):
        step = []
        for c, a, r, n in inserts(paths):
            step.append((c + 4, a + "D", r, n + ("D",)))
            if fault in ("fine", "cut"):
                extra = 3 * (fault == "cut")
                if initial.strip():
                    step.append((c + extra, a + "K", r + initial, n + ("K",)))
                step += [(c + 3 + extra, a + "R", r + x, n + ("R",)) for x in "ua"]
        paths = [p for p in step if LEGAL.fullmatch(p[2]) or LEGAL.fullmatch(p[2] + "a") or LEGAL.fullmatch(p[2] + "ua")]
        least = min(p[0] for p in paths)
        paths = [p for p in paths if p[0] <= least + 10]
    return min((p for p in inserts(paths) if LEGAL.fullmatch(p[2])), key=lambda p: p[:2])


def repaired(rows):
    out = {}
    by = defaultdict(list)
    for row in damage(rows):
        by[row[0]].append(row)
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest(), r[4]))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "cut" if bare[-1] not in ".!?" else "fine")
            seen.add((role, text))
        initials = [r[2][:1] or " " for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles, steps = shortest(faults, initials)
        lines, messages, at = [], iter(own), 0
        for step in steps:
            message = next(messages) if step in "DKR" else None
            if step != "D":
                name = message[2] if step == "K" else {"u": "user", "a": "assistant"}[roles[at]]
                lines.append(f"{name}:{message[3] if message else ''}")
                at += 1
        n = Counter(faults)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["cut"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_talks(n):
    texts = ["Yes.", "No", "", " \t", "Why not?\n", "é!", "x" * 3000 + ".", None, "a\nb."]
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 7])):
            rows.append((conv if conv % 9 else None, turn if rng.random() > 0.1 else rng.choice([None, turn, turn + 5]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    return rows


def test_repair_equals_trying_all_edits(spark):
    rows = [r for r in random_talks(160) if r[0] is not None]
    rows += [(None, t, role, text) for t, (role, text) in enumerate([("user", "Hello."), ("assistant", "Good day."), ("system", "Late.")])]
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in turn_repair.digests(turn_repair.repair(turn_repair.damaged(talk_frame(spark, rows).repartition(4)))).collect()}
    assert got == repaired(rows)


def test_repaired_messages_are_legal(spark):
    rows = random_talks(60)
    edits = defaultdict(list)
    for r in turn_repair.repair(turn_repair.damaged(talk_frame(spark, rows))).collect():
        edits[r.conv_id].append(r)
    for own in edits.values():
        assert [r.place for r in own] == list(range(-1, len(own) - 1))
        assert LEGAL.fullmatch("".join(r.role[0] for r in own if r.place >= 0 and r.edit != "D"))


def test_repair_of_a_long_conversation_and_of_nothing(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)]
    (row,) = turn_repair.digests(turn_repair.repair(turn_repair.damaged(talk_frame(spark, rows)))).collect()
    assert row.cost > 0 and row.audit.count("K") > 2000
    assert turn_repair.digests(turn_repair.repair(turn_repair.damaged(talk_frame(spark, [])))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    (row,) = turn_repair.digests(turn_repair.repair(turn_repair.damaged(talk_frame(spark, [(8, gone, "user", "Hi.")])))).collect()
    assert (row.cost, row.audit, row.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


# -- lexical search ----------------------------------------------------------------

WORDS = ["sea", "Sea", "river", "é", "x1", "stone", "the", "THE", "of", "日本", "old", "light", "house", "q"]
DOCS = "doc_id long, text string, row long, id long, n long, bag string, m int, item long, score double, hash int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def ranking(docs, items, k):
    bags = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for at, (doc, bag, n) in enumerate(bags):
            m = 75 + (25 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            scored.append((-score, doc is None, doc or 0))
        scored = sorted(s for s in scored if s[0] < 0)[:k]
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(scored, 1)]
    return sorted(out, key=str)


def sample_docs():
    text = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "\x00", "_", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 10, 30]))) for i in range(200)]
    docs += [(1000 + i, "The river, of stone") for i in range(100)]  # a third is one class
    docs += [(1200 + i, "the RIVER of-stone") for i in range(10)]
    docs += [(None, "river river stone"), (None, text(20)), (5, "old stone"), (5, "old stone"), (2000, None), (2001, ""), (2002, " ?! "), (2003, text(20000)), (2004, "nothing shared here")]
    return docs


ITEMS = [(1, "The old light-house of the sea"), (2, "river stone river"), (3, None), (4, ""), (5, "unheard words"), (6, "日本 é"), (6, "q"), (None, "x1 x1 x1 sea")]


def search(spark, docs, items, k):
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "b", 4, 5, 6.0, 7) for i, t in docs], DOCS).repartition(4)
    rows = bag_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=k).collect()
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in rows], key=str)


def test_search_equals_brute_force(spark):
    docs = sample_docs()
    for k in (20, 400):
        assert search(spark, docs, ITEMS, k) == ranking(docs, ITEMS, k)


def test_search_in_parts_and_in_integers(spark, monkeypatch):
    """More terms and items than one broadcast holds are more passes; no common-word matrix is another path."""
    monkeypatch.setattr(bag_search, "PART_TERMS", 4)
    monkeypatch.setattr(bag_search, "PART_ENTRIES", 3)
    docs = sample_docs()
    assert search(spark, docs, ITEMS, 20) == ranking(docs, ITEMS, 20)


def test_scorer_beyond_exact_floats():
    import numpy as np

    entries = [{"item": i, "number": t, "times": 1 << 20, "weight": 30_000} for i in range(12) for t in range(3) if (i + t) % 3]
    scorer = bag_search.Scorer(entries, 5)
    bags = [np.array([[0, 1], [2, 7]], "<u4").tobytes(), np.array([[1, 3]], "<u4").tobytes(), b""]
    got = scorer.scores(bags, np.array([75, 100, 80]))
    assert scorer.kind is np.int64
    for row, (bag, m) in enumerate(zip([{0: 1, 2: 7}, {1: 3}, {}], [75, 100, 80], strict=True)):
        want = [sum((1 << 20) * 30_000 * ((10**9 * n) // (1000 * n + 12 * m)) for t, n in bag.items() if (i + t) % 3) for i in range(12)]
        assert got[row].tolist() == want


@pytest.mark.parametrize("docs, items", [([], ITEMS), ([(1, "sea")], []), ([(1, None)], ITEMS)])
def test_search_of_nothing(spark, docs, items):
    assert search(spark, docs, items, 20) == []
