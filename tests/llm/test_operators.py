"""The training-data operators against brute force, on rows with nulls, repeats, long texts and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fjelldoc.llm import decontaminate, licenses, ngram_join, packing, quality_rules, rule_ensemble, shard_tree, token_counts, tokens, tool_calls, training_order

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, length long, node long, quality int, leaks int, score double, _t string, key string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice(["th", "er", "on", "an", "ré", "ü", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))


BASE = prose(120)
ITEM = "Where does the quiet river meet the northern sea today? It meets the sea below the old stone lighthouse."
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, BASE), (7, BASE), (8, BASE.upper().lower()), (9, BASE + " tail"), (10, BASE.replace(BASE.split()[60], "changed", 1)),
    (11, prose(6000)), (12, prose(60) + " " + ITEM + " " + prose(40)), (13, prose(50) + "\nReleased under the MIT License.\n" + prose(50)), (14, "word " * 90), (15, "NO!! " * 200),
    (16, "<|endoftext|> it's 42 ½ Ⅷ ﬁ  two  spaces ▁ mark  "), (17, "x" * 5000), (18, "same line here\nsame line here\n" + prose(30)), (None, "no id " + prose(30)), (6, "another text " + prose(30)), (19, prose(200)),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i != 19 else None, "s", 0, 1, 1, 1, 1, 1, 1, 1.0, "t", "k") for i, t in rows], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_tokens_equal_the_libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(WORD_FILE), SentencePieceProcessor(model_file=PIECE_FILE)
    odd = [t or "" for _, t in TEXTS] + ["É́aİK Å", "a b c", " lead", "trail ", "a▁ b", "▁", "\n b\n\nc ", "Σίσυφος ΣΑΣ", "don't I'LL ''s", "<s> a</s>", "日本語 テスト", "🙂🙂 x"]
    odd += ["".join(rng.choice(" \n▁aAé'.<|9") for _ in range(40)) for _ in range(200)]
    raw = [t.encode() for t in odd]
    got = tokens.WordIds(WORD_FILE)(raw)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in odd]
    assert tokens.PieceCounts(PIECE_FILE)(raw) == [len(pieces.encode(t)) for t in odd]


def test_words_are_learned_once_whatever_their_case():
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(WORD_FILE), tokens.WordIds(WORD_FILE)
    texts = ["Word word, WORD WORD, H\u0331an h\u0331an", "Word word, WORD WORD", "a <|endoftext|> A <|ENDOFTEXT|>", "Ünder ünder ÜNDER"]
    got = encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    plain = tokens.WordIds(WORD_FILE)
    plain([t.encode() for t in ("Word word, WORD WORD,", "wOrd, worD")])
    assert set(plain.words) == {b"", b"word", b"word,"}


def test_shard_tree(docs, none):
    tree, grown = shard_tree.layout(16), shard_tree.layout(17)
    rows = shard_tree.assign_shards(docs, "doc_id", tree, grown).collect()
    assert len(rows) == len(TEXTS)
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in TEXTS)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert not shard_tree.assign_shards(none, "doc_id", tree).collect()


def test_shard_tree_weights_and_confined_moves(spark):
    keys = spark.range(20000)
    light = [shard_tree.Shard("a", "r", 0, 1), shard_tree.Shard("a", "r", 1, 3), shard_tree.Shard("b", "q", 2, 4)]
    moved = [shard_tree.Shard("a", "r", 0, 2), shard_tree.Shard("a", "r", 1, 2), shard_tree.Shard("b", "q", 2, 4)]
    pairs = keys.select(shard_tree.shard_of(F.col("id"), light).alias("x"), shard_tree.shard_of(F.col("id"), moved).alias("y")).collect()
    share = Counter(p.x for p in pairs)
    assert abs(share[0] / 20000 - 1 / 8) < 0.02 and abs(share[2] / 20000 - 1 / 2) < 0.02
    assert all((p.x == 2) == (p.y == 2) for p in pairs)  # the rack's weight is the same, so nothing leaves it


def test_token_counts(docs, none):
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=PIECE_FILE)
    got = token_counts.count_tokens(docs, PIECE_FILE).collect()
    want = Counter((i, len((t or "").encode()), n := len(pieces.encode(t or "")), n > 4096) for i, t in TEXTS)
    assert Counter(map(tuple, got)) == want
    assert not token_counts.count_tokens(none, PIECE_FILE).collect()


def test_best_fit_plan_equals_item_by_item():
    for seed in range(20):
        own = random.Random(seed)
        lengths = sorted((own.choice([1, 1, 2, 5, 7, 9, 16, 20]) for _ in range(own.randint(0, 60))), reverse=True)
        free = []
        for n in lengths:
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(20 - n)
        plan = packing.best_fit_plan(Counter(lengths), 20)
        used = defaultdict(int)
        for length, start, stop, first, per, _ in plan:
            for rank in range(start, stop):
                used[first + (rank - start) // per] += length
        assert sorted(20 - u for u in used.values()) == sorted(free)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_FILE)
    rows = packing.pack(packing.token_pieces(docs, WORD_FILE)).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, p, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert not packing.pack(packing.token_pieces(none, WORD_FILE)).collect()


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(size), size, 9).tolist()) == list(range(size))
    assert training_order.feistel(np.arange(1000), 1000, 9).tolist() != training_order.feistel(np.arange(1000), 1000, 10).tolist()


def test_training_order(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    whole, path = Tokenizer.from_file(WORD_FILE), str(tmp_path / "order")
    made = training_order.write_training_order(training_order.token_sequences(docs, WORD_FILE, length=64), path, 3, per_shard=16).collect()
    assert sorted(r.slot for r in made) == list(range(len(made)))
    later = training_order.read_from(spark, path, 20, per_shard=16).collect()
    assert [r.slot for r in later] == list(range(20, len(made))) and {len(r.ids) for r in later} == {128}
    every = training_order.read_from(spark, path, 0, per_shard=16).where("doc_id = 11").orderBy("piece").collect()
    ids = [x for r in every for x in np.frombuffer(r.ids, "<u2")[: r.n_tokens].tolist()]
    assert ids == whole.encode(dict(TEXTS)[11], add_special_tokens=False).ids
    assert not training_order.write_training_order(training_order.token_sequences(none, WORD_FILE), str(tmp_path / "empty"), 3).collect()


def statistics_of(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, none):
    rows = quality_rules.quality(docs).select("_row.doc_id", "_row.text", "quality.*").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        s = statistics_of(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 10 or 100 * s[4] > 20 * s[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert {6, 9, 10, 11} <= kept and not kept & {1, 2, 3, 4, 14, 15}
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert not quality_rules.keep_good(none).collect()


def test_words_of_another_language_go(spark):
    def of(lang, n):
        own = quality_rules.COMMON_WORDS[lang]
        return " ".join(rng.choices([*own, *(f"{w}x" for w in VOCABULARY)], [*own.values(), *[(1 - sum(own.values())) / len(VOCABULARY)] * len(VOCABULARY)], k=n))

    rows = [(i, of(text, 3000), lang, text) for i, (text, lang) in enumerate((a, b) for a in quality_rules.COMMON_WORDS for b in quality_rules.COMMON_WORDS)]
    rows += [(90, of("de", 40), "en", "en"), (91, of("de", 400), None, None), (92, of("de", 400), "xx", "xx")]
    got = {r.i: r.quality for r in quality_rules.quality(spark.createDataFrame(rows, "i int, text string, lang string, really string")).select("_row.i", "quality").collect()}
    assert {i for i, q in got.items() if q.kept} == {i for i, _, lang, really in rows if lang == really}
    assert got[90].word_distance is None and got[91].other_word_distance is None


def test_js_distance(spark):
    got = spark.range(1).select(quality_rules.js_distance(F.array(F.lit(3.0), F.lit(1.0), F.lit(0.0)), F.lit(4.0), F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("d")).first().d
    p, q = [0.75, 0.25, 0], [0.2, 0.3, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_rule_ensemble(spark, docs, none):
    good = [(i, prose(rng.randint(20, 90)), 1) for i in range(300)]
    bad = [(i, " ".join(rng.choice(VOCABULARY).upper() + "!!" for _ in range(60)), 0) for i in range(300, 420)]
    corpus = frame(spark, [(i, t) for i, t, _ in good + bad])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    ensemble = rule_ensemble.fit(corpus, labels)
    scored = rule_ensemble.score(corpus, ensemble, "doc_id").join(labels, "doc_id").where(rule_ensemble.held_out() & F.col("quality").isNotNull()).collect()
    assert len(scored) > 40 and all((r.score >= 0.3) == bool(r.quality) for r in scored)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in scored)
    everything = rule_ensemble.score(docs, ensemble, "doc_id").collect()
    assert len(everything) == len(TEXTS) and all(0 <= r.score <= 1 for r in everything)
    assert rule_ensemble.fit(corpus, labels.where("quality = 1")).rules == ()
    assert rule_ensemble.fit(none, labels.limit(0)).intercept == 0.0
    assert rule_ensemble.keep_good(docs, ensemble).columns == docs.columns


def components_by_brute_force(rows, size, num, den):
    def own(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [own(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (den * both >= num * (len(sets[i]) + len(sets[j]) - both) or (rows[i][0] is not None and rows[i][0] == rows[j][0])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, none, size, num):
    rows = list(TEXTS)
    base = prose(90).split()
    for i in range(100, 190):  # chains: each copy changes a word of one before it
        words = list(rng.choice([base, rows[-1][1].split()]))
        words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
        rows.append((i, " ".join(words)))
    got = ngram_join.near_components(frame(spark, rows), size=size, num=num).collect()
    assert Counter(map(tuple, got)) == components_by_brute_force(rows, size, num, 100)
    assert not ngram_join.near_components(none).collect()


def test_copies_below_the_threshold_are_told_apart_by_their_points(spark, monkeypatch):
    """Copies of one text with every fiftieth word changed share many keys, but no pair of them links."""
    base, compared = prose(400).split(), []
    rows = [(i, " ".join(rng.choice(VOCABULARY) if rng.random() < 0.02 else w for w in base)) for i in range(24)]
    real = ngram_join._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = ngram_join.near_components(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == components_by_brute_force(rows, 3, 90, 100)
    assert sum(compared) <= 60  # of 276 pairs


def test_keys_are_shuffled_once(spark, docs, monkeypatch):
    plans, real = {}, ngram_join.Workspace.written

    def seen(self, df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name, **options)

    monkeypatch.setattr(ngram_join.Workspace, "written", seen)
    ngram_join.near_components(docs).collect()
    assert plans["members"].count("Exchange hashpartitioning") == 1


def test_counts_past_a_byte(spark):
    """Texts with more than 127 shingles in a group of their point, linked and not, and a key of more than LEAF of them."""
    base = [f"{rng.choice(VOCABULARY)}{rng.randrange(900)}" for _ in range(24_000)]
    rows = [(i, " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in base)) for i, share in enumerate([0, 0.01, 0.016, 0.02, 0.05])]
    short = prose(60).split()
    rows += [(10 + i, " ".join([*short[:50], *rng.sample(VOCABULARY, 6)])) for i in range(ngram_join.LEAF + 6)]
    got = ngram_join.near_components(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == components_by_brute_force(rows, 3, 90, 100)


def test_near_copies_leave_one(docs):
    kept = Counter(r.doc_id for r in ngram_join.without_near_copies(docs).collect())
    assert kept[6] == 2 and not {7, 8, 9, 10} & set(kept) and {1, 2, 3, 4, 11, None} <= set(kept)


def test_near_copies_leave_one_row(spark):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(6, a), (5, a), (6, b), (None, c), (None, c), (None, c + " tail"), (7, d), (7, d), (None, d), (None, None), (None, ""), (8, "")]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.without_near_copies(frame(spark, rows)).collect())
    assert {x: n for x, n in kept.items() if x[0] is not None or x[1] not in (c, c + " tail")} == {(5, a): 1, (6, b): 1, (7, d): 1, (None, None): 1, (None, ""): 1, (8, ""): 1}
    assert kept[None, c] + kept[None, c + " tail"] == 1


def test_only_rows_that_may_go_are_moved(docs):
    """The rows that the exact list of dropped ones meets are thinned first; the others stay where they lie."""
    plan = ngram_join.without_near_copies(docs)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join LeftAnti")
    assert len(joined) == 2 and "may_be" in joined[0] and "may_be" in joined[1]


def test_leaks(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, prose(40)), (3, None), (4, ""), (5, ITEM), (None, "x y z"), (6, "Short one.")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.found_leaks(docs, items).collect()}
    assert got == {(12, 1), (12, 5)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {i for i, _ in TEXTS} - {12}
    assert not decontaminate.found_leaks(none, items).collect() and not decontaminate.found_leaks(docs, items.limit(0)).collect()


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *row]
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j + 1] + 1 if x == y else max(new[-1], row[j + 2]))
        row = new
    return row[-1]


def test_in_order_equals_windows_by_brute_force():
    for _ in range(60):
        wanted, passage = ([rng.choice("abcdefgh") for _ in range(n)] for n in (rng.randint(1, 40), rng.randint(0, 90)))
        n, slack = len(wanted), max(2, len(wanted) // 8)
        windows = [passage[max(0, i) : max(0, i + n + 2 * slack)] for i in range(-slack, len(passage), slack)]
        assert decontaminate.in_order(wanted, passage) == max((longest_common(wanted, w) for w in windows), default=0)


def test_leaks_of_changed_copies(spark):
    question, answer = ITEM.split("? ")
    long = question.split() + ["under", "grey", "clouds", "while", "tall", "ships", "wait", "for", "wind"]
    asked, said = " ".join(long) + "?", answer
    short = " ".join(long) + "? By the lighthouse."
    items = spark.createDataFrame([(1, asked + " " + said), (2, short)], "item_id long, text string")
    around = lambda x: prose(40) + "\n" + x + "\n" + prose(40)

    def changed(text, every):
        return " ".join("other" if i % every == every // 2 else w for i, w in enumerate(text.split()))

    texts = {0: asked + " " + said, 1: changed(asked + " " + said, 10), 2: changed(asked + " " + said, 20), 3: short, 4: " ".join(long) + "?", 5: changed(short, 10)}
    texts |= {6: said, 7: " ".join(sorted(set((asked + " " + said).lower().replace("?", "").replace(".", "").split()))), 8: prose(30)}
    docs = frame(spark, [(i, around(x)) for i, x in texts.items()])
    got = defaultdict(set)
    for r in decontaminate.found_leaks(docs, items).collect():
        got[r.doc_id].add(r.item_id)
    assert {1} <= got[0] and {1} <= got[1] and {1} <= got[2]
    assert {2} <= got[3] and {2} <= got[4] and {2} <= got[5]
    assert not {6, 7, 8} & set(got)


def test_block_walk_equals_all_scores():
    items = [(i, prose(rng.randint(3, 30))) for i in range(60)]
    frequency = Counter(t for _, x in items for t in set(decontaminate.words(x)))
    index = decontaminate.Index(items, frequency, 60, 15.0)
    for _ in range(40):
        terms = sorted(rng.sample(range(len(index.terms)), 40))
        want = Counter()
        for t in terms:
            for numbers, impacts in index.lists[t].values():
                for number, impact in zip(numbers, impacts, strict=True):
                    want[number] += impact
        got = {n: s for block in range(index.maxima.shape[1]) if index.maxima[terms, block].sum() >= 0.3 for n, s in index.block_walk(terms, block, 0.3)}
        assert got == {n: pytest.approx(s) for n, s in want.items() if s >= 0.3}


def test_licenses(spark, docs, none):
    found = licenses.scan(docs, licenses.templates(spark)).collect()
    assert {(r.doc_id, r.license) for r in found} == {(13, "MIT")}
    rows = [(i, prose(rng.randint(0, 60)) + "\n" + text + "\n" + prose(rng.randint(0, 60))) for i, text in enumerate(list(licenses.NOTICES.values()) * 4)]
    got = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, rows), licenses.templates(spark)).collect()}
    assert {(i, name) for i, name in enumerate(list(licenses.NOTICES) * 4)} <= got
    assert not licenses.scan(none, licenses.templates(spark)).collect() and not licenses.scan(docs, licenses.templates(spark, {})).collect()


def test_tool_calls(spark):
    good = '{"turn": 1, "prompt": "a"}'
    calls = spark.createDataFrame([("a", None, "reply", good), ("b", "a", "reply", '{"prompt": 3}'), ("c", "b", "other", good), ("d", "e", "reply", "[1]"), ("e", "d", "reply", good), ("f", "gone", "reply", '{"prompt":"x","turn":2,"z":1}'), ("a", None, "reply", good), (None, None, "reply", good)], "call_id string, depends_on string, tool string, arguments string")
    results = spark.createDataFrame([("a", "first"), ("a", "again"), ("q", "lost"), ("c", None)], "call_id string, content string")
    got = {r.call_id: r for r in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0, "q": None, None: None}
    assert {k: r.status for k, r in got.items()} == {"a": "answered", "b": "unanswered", "c": "answered", "d": "unanswered", "e": "unanswered", "f": "unanswered", "q": "orphan", None: "invalid"}
    assert got["a"].message == '{"arguments":{"prompt":"a","turn":1},"call_id":"a","content":"again","name":"reply"}' and got["a"].n_calls == 2
    assert got["b"].errors == ["missing turn", "prompt is not STRING"] and got["c"].errors == ["unknown tool other"]
    assert got["d"].errors == ["arguments are no JSON object"] and got["f"].errors == ["unexpected z"]
    assert not tool_calls.link(calls.limit(0), results.limit(0), tool_calls.SCHEMAS).collect()
