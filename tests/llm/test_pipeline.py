"""The pipeline as a chain and stage by stage, against plain Python, on rows with nulls, repeats, long texts and clashing columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fjelldoc.llm import decontaminate, rule_ensemble
from tests.conftest import SF
from tests.llm.test_operators import TEXTS, components_by_brute_force, frame, prose

rng = random.Random(23)
STAGES = dict(corpus_pipeline.STAGES)
COPY, LEAK = "n-gram Jaccard join", "benchmark decontamination"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with copies, near copies, leaks, rows without id or text and a very long text among the documents."""
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = sorted((r for r in docs.collect() if labels.get(r.doc_id) == 1 and 400 < len(r.text) < 3000), key=lambda r: r.doc_id)[:6]
    a, b, c = good[0], good[1], good[2]
    words = b.text.split(" ")
    near = " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])
    rows = [(9000, a.text), (9001, a.text), (None, a.text), (a.doc_id, a.text), (9002, near), (9003, c.text + "\n" + items[0] + "\n" + c.text[:200]), (None, items[1] + "\n" + items[1])]
    rows += [(9004, None), (9005, ""), (None, None), (9006, "word " * 40_000), (9007, " \n\t "), (9008, "two words")]
    extra = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(extra.columns).unionByName(extra).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path), a, b, c


def stage_rows(spark, folder, upto):
    """The documents after each stage before `upto`."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == upto:
            return docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    return docs


def test_run_equals_its_stages_and_packs_every_token(spark, folder):
    from tokenizers import Tokenizer

    path, a, b, c = folder
    left = stage_rows(spark, path, "best-fit packing").collect()
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in left:
        n = len(ids.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, i // 2048, i, min(2048, n - i)) for i in range(0, n, 2048))
    rows = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    kept = Counter(r.doc_id for r in left)
    assert sum(r.text == a.text for r in left) == 1 and kept[b.doc_id] + kept[9002] == 1
    assert not {9003, 9004, 9005, 9006, 9007, 9008} & set(kept) and not any(r.text and r.doc_id is None for r in left)


def test_near_copies_of_the_chain_by_brute_force(spark, folder):
    docs = stage_rows(spark, folder[0], COPY)
    rows = [(n, r.text) for n, r in enumerate(docs.collect())]
    classes = Counter(c for _, size, c in components_by_brute_force(rows, 5, 80, 100) if size)
    empty = sum(not (t or "").split() for _, t in rows)
    left = STAGES[COPY](spark, docs, folder[0]).collect()
    assert len(left) == len(classes) + empty and 1 < len(classes) < len(rows)
    assert all(size == 1 for size in Counter(r.text for r in left if (r.text or "").split()).values())


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_each_filtering_stage_on_odd_rows(spark, folder, name):
    """Nulls, empties, long texts, repeats and extra columns of any name come back as they went in, or not at all."""
    path = folder[0]
    docs = frame(spark, TEXTS).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("_leaks", "_leaks_0", "_row_number", "number", "row", "leaks", "found", "_row", "quality", "component_id", "order")})
    before = Counter(map(str, docs.collect()))
    out = STAGES[name](spark, docs, path)
    assert out.columns == docs.columns
    after = Counter(map(str, out.collect()))
    assert not after - before
    assert STAGES[name](spark, docs.limit(0), path).collect() == []


def test_leaks_equal_brute_force(spark, monkeypatch):
    """Retrieval by blocks over several parts of the index finds what scoring every passage with every item finds."""
    items = [(i, prose(rng.randint(1, 25)) + (". " + prose(rng.randint(1, 9)) if i % 2 else "")) for i in range(40)]
    texts = []
    for i in range(60):
        own = decontaminate.words(rng.choice(items)[1])
        cut = [w if rng.random() > 0.15 else "other" for w in own]
        texts.append((i, prose(rng.randint(0, 50)) + " " + " ".join(cut) + " " + prose(rng.randint(0, 50))))
    texts += [(100, None), (101, ""), (102, " ".join(t for _, t in items))]
    asked = spark.createDataFrame(items, "item_id long, text string")
    every = {i: decontaminate.words(t) for i, t in items}
    usable = [(i, t) for i, t in items if len(every[i]) >= decontaminate.LEAST]
    frequency = Counter(w for i, _ in usable for w in set(every[i]))
    mean = sum(len(every[i]) for i, _ in usable) / len(usable)
    for part_words in (100_000, 120):
        monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
        parts, each = decontaminate.item_parts(asked)
        indexes = [decontaminate.Index(p["items"], Counter(p["df"]), p["n"], p["mean"]) for p in each]
        assert parts == len(indexes) and (part_words > 1000) == (parts == 1)
        assert all(p == frequency[t] for index in indexes for t, p in ((t, frequency[t]) for t in index.terms))
        want = set()
        for doc, text in texts:
            found = decontaminate.words(text or "")
            for index in indexes:
                step = index.longest
                for start in range(0, len(found), step):
                    passage = found[start : start + 2 * step]
                    held = set(passage)
                    for item in index.items:
                        def impact(t):
                            n, df = item.counts[t], frequency[t]
                            size = sum(item.counts.values())
                            return float(np.log(1 + (len(usable) - df + 0.5) / (df + 0.5))) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean))

                        mass = sum(map(impact, item.counts))
                        if sum(impact(t) for t in item.counts if t in held) / mass >= decontaminate.RETRIEVE and index._verified(item, decontaminate.sequences(passage), passage, 0.6, 0.6)[0]:
                            want.add((doc, item.item_id))
        got = {(r.doc_id, r.item_id) for r in decontaminate.found_leaks(frame(spark, texts), asked).collect()}
        assert got == want and len(want) > 30


def test_short_items_are_no_leaks_unless_asked_for(spark):
    items = spark.createDataFrame([(1, "Yes."), (2, "Paris"), (3, "They said yes to the offer.")], "item_id long, text string")
    docs = frame(spark, [(1, "They said yes to the offer last week."), (2, "A summer in Paris by the river."), (3, "yes")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.found_leaks(docs, items).collect()} == {(1, 3)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {2, 3}
    assert {(2, 2), (3, 1)} <= {(r.doc_id, r.item_id) for r in decontaminate.found_leaks(docs, items, least=1).collect()}


def test_long_parts_share_one_window():
    wanted = [f"w{i}" for i in range(900)]
    assert decontaminate.in_order(wanted, wanted[::-1]) <= 2
    assert decontaminate.in_order(wanted, ["x"] * 50 + wanted + ["x"] * 50) == 900
    assert decontaminate.in_order(wanted, wanted[450:] + wanted[:450]) == 450  # halves in the wrong order count once


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    ensemble = rule_ensemble.fit(docs, labels)
    rows = rule_ensemble.score(docs, ensemble, "doc_id").join(labels, "doc_id").where(rule_ensemble.held_out() & F.col("quality").isNotNull()).select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == y] for y in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) > 10 and len(bad) > 10 and auc > 0.95
