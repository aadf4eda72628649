"""Search: brute force, both scoring ways, recall, and failure cases."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fjelldoc.functions import vectors
from fjelldoc.operators import ann, embed, search, wordsim
from fjelldoc.operators.postings import PostingsStore
from fjelldoc.operators.wordsim import ordered_trigrams, word_similarity_batch
from fjelldoc.plans import search_queries
from fjelldoc.plans.search_queries import doc_vectors, label_vectors


def brute(query: str, text: str) -> float:
    q, seq = set(ordered_trigrams(query)), ordered_trigrams(text)
    best = 0.0
    for i in range(len(seq)):
        seen = set()
        for g in seq[i:]:
            seen.add(g)
            best = max(best, len(q & seen) / len(q | seen))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_word_similarity_is_the_greatest_over_all_extents(seed):
    rng = np.random.default_rng(seed)
    words = ["kultur", "minne", "kulturminne", "vei", "veien", "natur", "området", "a", "bro"]
    text = " ".join(rng.choice(words, 60))
    query = " ".join(rng.choice(words, 3)) + "xq"
    got = word_similarity_batch(
        pd.DataFrame({"id": [1], "content": [text]}), pd.DataFrame({"query_id": [1], "query": [query]}), 5, 0.0
    )
    assert got["score"].iloc[0] == pytest.approx(brute(query, text), abs=1e-6)


@pytest.mark.parametrize("seed, block", [(1, 2), (2, 4), (3, 32), (4, 3), (5, 8)])
def test_best_texts_equal_brute_force(seed, block, monkeypatch):
    """Many texts and queries, some long, with bounds, limits and sweeps over many blocks."""
    monkeypatch.setattr(wordsim, "BLOCK", block)
    monkeypatch.setattr(wordsim, "CELLS", 64 if seed % 2 else 1 << 20)
    rng = np.random.default_rng(seed)
    words = ["kultur", "minne", "kulturminne", "vei", "veien", "natur", "området", "a", "bro", "brua", "stein", "x1"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 5, 9, 14, 20, 26, 30, 30)] + ["", None, "!!", "zzz yyy"]
    queries = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 5)] + ["", "qqq", "vei q"]
    want = {}
    for q, query in enumerate(queries):
        scored = [(-round(brute(query, x or ""), 6), i) for i, x in enumerate(texts)]
        want |= {(q, i): -s for s, i in sorted((s, i) for s, i in scored if -s > 0.1)[:4]}
    best = wordsim.BestTexts(pd.DataFrame({"query_id": range(len(queries)), "query": queries}), 4, 0.1)
    frame = pd.DataFrame({"id": range(len(texts)), "content": texts})
    for part in (frame[:5], frame[5:]):
        best.add(part)
    assert {(r.query_id, r.id): r.score for r in best.rows().itertuples()} == want


def test_queries_in_several_passes_and_items_without_exchange(tables, monkeypatch):
    chunks = tables.embeddings.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = tables.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())
    once = search._nearest(chunks, asked, 5)
    assert key(once) == key(search._nearest(chunks, asked, 5, passes=3))
    plan = once._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :].split("Subquery")[0]
    assert "Exchange" not in below
    from fjelldoc.operators import scoring

    monkeypatch.setattr(scoring, "MAX_BYTES", 10)
    with pytest.raises(Exception, match="give more passes"):
        search._nearest(chunks, asked, 5).collect()


def test_large_query_sets_give_the_same_hits(tables):
    few = search.search_semantic_chunks(tables.chunks, tables.docs, label_vectors(tables))
    blocked = search.search_semantic_chunks(tables.chunks, tables.docs, label_vectors(tables), max_queries=3)
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.chunk_id, r.score) for r in df.collect())
    assert key(few) == key(blocked) and key(few)


def test_approximate_recall(tables):
    items = tables.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    q = label_vectors(tables)
    exact = search._nearest(items.select("id", F.col("id").alias("chunk_id"), "embedding"), q, 10)
    mean = ann.recall(ann.approximate_top_k(items, q, 10), exact).agg(F.avg("recall")).first()[0]
    assert mean >= 0.9


def test_inverted_file_on_clusters_compares_few_pairs(spark, monkeypatch):
    """Clustered vectors need few cells; crowded cells and many queries are cut and give the same hits."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.15).tolist()) for i in range(1200)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [float("nan")] * 16)]
    rows += [(6000 + i, rows[7][1]) for i in range(600)]  # a third in one cell
    items = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    asked = items.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = ann.InvertedFile.build(items, cells=40)
    exact = ann.exact_top_k(items, asked, 10)
    probes = index.calibrated(asked, exact)
    row = index.compared(asked, probes).first()
    found = index.search(asked, 10, probes)
    assert ann.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert row.pairs < 0.35 * row["items"] * row.queries and row["items"] == 1800
    monkeypatch.setattr(ann, "CELL", 16 * 50)
    cut = ann.InvertedFile.build(items, cells=40)
    assert cut.items.agg(F.max("part")).first()[0] > 5
    key = lambda df: sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())
    assert key(cut.search(asked, 10, probes)) == key(found)
    none = items.limit(0)
    assert ann.approximate_top_k(none, asked, 3).collect() == []


def test_null_wrong_and_zero_vectors_are_skipped(spark):
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, [1.0]), (4, 4, [0.0, 0.0])], "id bigint, chunk_id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r.id for r in search._nearest(items, q, 5).collect()] == [1]


def test_queries_of_any_dimension_and_order(spark):
    items = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 0.0, 1.0])], "id bigint, chunk_id bigint, embedding array<float>")
    rows = [(1, None), (2, [0.0, 0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])]
    for order in (rows, rows[::-1]):
        q = spark.createDataFrame(order, "query_id bigint, embedding array<float>")
        for most in (1, 2048):
            assert sorted((r.query_id, r.id) for r in search._nearest(items, q, 5, most).collect()) == [(2, 2), (3, 1)]
        errors = {r.query_id: r.error for r in search.check_vectors(q, 2).collect()}
        assert errors[3] is None and all(errors[i] for i in (1, 2, 4))


def test_scoring_starts_no_job(spark, tables):
    chunks, docs = tables.chunks, tables.docs
    asked = tables.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    search.search_semantic_chunks(chunks, docs, asked)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_malformed_vector_text(spark):
    df = spark.createDataFrame([("[0.1,0.2]",), ("[0.1,",), ("nope",), (None,), ("[1,null]",)], "t string")
    got = [r[0] for r in df.select(vectors.parse_vector(F.col("t"))).collect()]
    assert got[0] == pytest.approx([0.1, 0.2]) and got[1:] == [None] * 4


def test_merge_prefers_earlier_methods_on_ties(spark):
    hit = lambda rows: spark.createDataFrame(rows, "query_id bigint, id bigint, score double")
    got = search.hybrid_merge({"fulltext": hit([(1, 1, 0.5)]), "semantic": hit([(1, 1, 0.5), (1, 2, 0.9)]), "fuzzy": hit([(1, 1, 0.6), (1, 2, 0.9)])})
    assert [(r.id, r.source) for r in got.orderBy("rank").collect()] == [(2, "semantic"), (1, "fuzzy")]


def test_failing_embedding_batch_leaves_nulls(spark):
    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(8)], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in embed.embed_texts(df, embedder, batch=4).collect()}
    assert [i for i, v in got.items() if v is None] == [0, 1, 2, 3] and got[7] == [1.0]


def test_wrong_number_of_vectors_fails_its_batch(spark):
    df = spark.createDataFrame([(i, "t") for i in range(5)], "i int, text string").coalesce(1)
    got = {r.i: r for r in embed.embed_texts(df, lambda texts: [[1.0]] * min(4, len(texts) + 2), batch=4, error="why").collect()}
    assert [i for i, r in got.items() if r.embedding is None] == [4]
    assert got[0].why is None and got[4].why == "3 vectors for 1 texts"


def test_document_vectors_have_all_dimensions(tables):
    assert doc_vectors(tables).filter(F.size("embedding") != 64).count() == 0


def test_stored_postings_follow_their_documents(spark, tables):
    """Added, replaced and removed documents, before and after a merge, give what fresh postings give."""
    docs = search.searchable(tables.docs)
    few = tables.queries.select("query_id", F.array_join(F.slice(F.split("query", " "), 2, 2), " ").alias("query"))
    key = lambda df: sorted((r.query_id, r.id, r.score) for r in df.collect())
    fresh = lambda d: key(search.full_text_scores(search.build_postings(d), few))
    store = PostingsStore.new(spark, buckets=4)
    store.add(docs.where("id < 150").withColumn("content", F.lit("old text of nothing")))
    store.add(docs.where("id < 100"))
    store.add(docs.where("id >= 90"))
    store.add(docs.where("id >= 100 AND id < 150"))
    assert key(store.scores(few)) == fresh(docs)
    store.remove(docs.where("id % 3 = 0").select("id"))
    left = docs.where("id % 3 <> 0")
    assert key(store.scores(few)) == fresh(left)
    store.merge()
    assert len(store.segments()) == 1 and key(store.scores(few)) == fresh(left)
    store.add(docs.where("id % 3 = 0"))
    assert key(PostingsStore(spark, store.root).scores(few)) == fresh(docs)
    assert not store.scores(few.limit(0)).collect()


def test_a_search_of_stored_postings_reads_few_buckets(spark, tables):
    store = PostingsStore.new(spark, "simple", buckets=16)
    store.add(search.searchable(tables.docs))
    one = spark.createDataFrame([(1, "the")], "query_id bigint, query string")
    plan = store.scores(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "dynamicpruning" in plan and "documents.parquet" not in plan


def test_pair_rank_walks_near_pairs_and_sums_far_ones(spark):
    import math
    import random

    from fjelldoc.functions import lexemes as lx

    rng = random.Random(5)
    at = sorted(rng.sample(range(1, 900), 120))
    occ = [(p, rng.choice("abc"), 1.0 if p < 40 else 0.4) for p in at]
    miss = 0.0
    for i, (p, x, v) in enumerate(occ):
        for q, y, w in occ[i + 1 :]:
            close = 1e-30 if q - p > 100 else 1 / (1.005 + 0.05 * math.exp((q - p) / 1.5 - 2))
            miss += math.log1p(-math.sqrt(v * w * close)) if x != y else 0.0
    df = spark.createDataFrame([(occ,)], "occ array<struct<pos:int,lexeme:string,w:double>>")
    assert df.select(lx.rank_pairs(df["occ"]).alias("r")).first().r == pytest.approx(-math.expm1(miss), abs=1e-9)
    far = [(1, "a", 1.0), (500, "b", 0.4)]
    df = spark.createDataFrame([(far,)], "occ array<struct<pos:int,lexeme:string,w:double>>")
    assert df.select(lx.rank_pairs(df["occ"]).alias("r")).first().r == pytest.approx(math.sqrt(0.4) * 1e-15, rel=1e-6)


def test_fuzzy_and_hybrid_ask_every_benchmark_text(spark, monkeypatch):
    texts = [(1, "The old mill by the river. " * 3 + "A stone bridge leads over the quiet water."), (2, "Nothing of it here, only snow and ice."), (3, "Bridges of stone; the miller sleeps.")]
    asked = [(7, "A stone bridge leads over the water."), (8, "The old miller by the quiet river sleeps."), (31, "snow and ice"), (32, " ")]
    docs = spark.createDataFrame([(i, "t", x, "ready") for i, x in texts], "id bigint, title string, content string, indexing_status string")
    t = SimpleNamespace(docs=docs, queries=spark.createDataFrame(asked, "query_id bigint, query string"))
    want = {}
    for q, query in asked:
        mine = set(wordsim.ordered_trigrams(query))
        for i, x in texts:
            grams = wordsim.ordered_trigrams(x)
            best = max(len(mine & (own := set(grams[a : b + 1]))) / len(mine | own) for a in range(len(grams)) for b in range(a, len(grams)))
            if best > 0.1:
                want[q, i] = round(best, 6)
    assert {q for q, _ in want} == {7, 8, 31}
    assert {(r.query_id, r.id): r.score for r in search_queries.fuzzy_search(t).collect()} == want
    monkeypatch.setattr(wordsim, "CELLS", 64)
    monkeypatch.setattr(wordsim, "BLOCK", 5)  # many blocks
    batch = wordsim.word_similarity_batch(pd.DataFrame(texts, columns=["id", "content"]), pd.DataFrame(asked, columns=["query_id", "query"]), 10, 0.1)
    assert {(r.query_id, r.id): r.score for r in batch.itertuples()} == want
    found = search_queries.hybrid_search(t).collect()
    assert {r.query_id for r in found} == {7, 8, 31} and (31, 2, "fulltext") in {(r.query_id, r.id, r.source) for r in search.hybrid_merge({"fulltext": search.search_full_text(t.docs, t.queries)}).collect()}
    assert all(r.score >= want.get((r.query_id, r.id), 0) for r in found)


def test_chunk_hits_carry_their_section(spark):
    docs = spark.createDataFrame([(1, "One", "w " * 400, "ready"), (2, "Two", "doc text", "partial"), (3, "Three", "hidden", "new")], "id bigint, title string, content string, indexing_status string")
    fields = "chunk_id bigint, document_id bigint, text string, heading_path string, section_title string, section_number string, topic_type string, alternative string, delomrade string, contains_table boolean, page_start int, page_end int, embedding array<float>"
    row = lambda i, d, text, v: (i, d, text, "1 A > 1.2 B", "B", "1.2", "metode", "alternativ 1", "N01", True, 2, 3, v)
    chunks = spark.createDataFrame([row(10, 1, "x" * 400, [1.0, 0.0]), row(11, 1, "other", [0.0, 1.0]), row(30, 3, "hidden", [1.0, 0.0])], fields)
    vectors_ = spark.createDataFrame([(1, "ready", [0.9, 0.1]), (2, "partial", [0.8, 0.6])], "id bigint, indexing_status string, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    hits = search.merge_semantic(search.search_semantic_chunks(chunks, docs, asked), search.search_semantic_documents(vectors_, asked))
    got = sorted(search.with_chunk(hits, chunks, docs).collect(), key=lambda r: r["rank"])
    assert [(r.id, r.chunk_id, r.title) for r in got] == [(1, 10, "One"), (2, None, "Two")]
    assert got[0].content == "x" * 300 + "…" and (got[0].heading_path, got[0].delomrade, got[0].page_end, got[0].contains_table) == ("1 A > 1.2 B", "N01", 3, True)
    assert got[1].content == "doc text" and got[1].heading_path is None
    queries = spark.createDataFrame([(7, "doc text")], "query_id bigint, query string")
    every = search.hybrid_search(docs, queries, chunks, vectors_, asked).collect()
    assert {r.id: r.source for r in every} == {1: "semantic", 2: "fuzzy"}
    only = search.hybrid_search(docs, queries, methods=("fulltext",)).collect()
    assert {(r.id, r.source) for r in only} == {(2, "fulltext")}
    assert {r.source for r in search.hybrid_search(docs, queries, None, vectors_, asked, methods=("semantic",)).collect()} == {"semantic"}


@pytest.mark.parametrize("seed", range(4))
def test_limits_from_glances_keep_the_best_texts(monkeypatch, seed):
    """The kth best glance is a limit for all tasks; with it few texts are left to sweep, and the best ones stay."""
    monkeypatch.setattr(wordsim, "BLOCK", 4)
    monkeypatch.setattr(wordsim, "SECTION", 3 if seed % 2 else 4096)
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 6))) for _ in range(40)]
    asked = pd.DataFrame([(q, " ".join(rng.choice(words, rng.integers(2, 8)))) for q in range(6)], columns=["query_id", "query"])
    texts = pd.DataFrame([(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(60)], columns=["id", "content"])
    texts.loc[::7, "content"] += " " + asked["query"].iloc[0]
    seen = wordsim.Glances(asked, 3, 0.1)
    seen.add(texts)
    kth = seen.rows().groupby("query_id")["score"].agg(["min", "size"]).query("size == 3")["min"]
    exact = word_similarity_batch(texts, asked, 3, 0.1)
    assert (seen.rows().merge(exact, on=["query_id", "id"], suffixes=("", "_best")).eval("score <= score_best")).all()
    swept = []
    real = wordsim.Text.best
    monkeypatch.setattr(wordsim.Text, "best", lambda self, index, live, limit: swept.append(len(live)) or real(self, index, live, limit))
    parts = []
    for part in (texts[:30], texts[30:]):  # two tasks
        parts.append(word_similarity_batch(part, asked.merge(kth.rename("limit"), on="query_id", how="left"), 3, 0.1))
    few = sum(swept)
    swept.clear()
    for part in (texts[:30], texts[30:]):
        word_similarity_batch(part, asked, 3, 0.1)
    assert few < sum(swept)
    got = pd.concat(parts).sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(3)
    want = exact.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    assert got.values.tolist() == want.values.tolist()


def test_embedding_holds_a_few_calls_at_a_time():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"id": list(range(1203)), "text": [f"word{i}" for i in range(1203)]})
    calls = []
    embedder = lambda part: calls.append(len(part)) or [[float(len(t))] if t != "word7" else None for t in part]
    out = list(embed.embed_batches(iter([rows]), embedder, "text", ["id", "text"], ["embedding"], 50))
    assert max(b.num_rows for b in out) == 50 * embed.CALLS and calls == [50] * 24 + [3]
    whole = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in whole] == list(range(1203)) and whole[7]["embedding"] is None and whole[1200]["embedding"] == [8.0]


def test_cells_and_scores_are_held_in_slices(spark, monkeypatch):
    """No table of all rows and all cells, and the same neighbours and cells as at once."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    items = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    asked = items.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    index = ann.InvertedFile.build(items, 12)
    at_once = [sorted(map(tuple, index.search(asked, 5, 4).collect())), sorted(index.visits(asked, 12).select("query_id", "cell", "nearness").collect())]
    monkeypatch.setattr(ann, "SCORES", 40)
    in_slices = [sorted(map(tuple, index.search(asked, 5, 4).collect())), sorted(index.visits(asked, 12).select("query_id", "cell", "nearness").collect())]
    assert at_once == in_slices


def test_scores_of_chunks_are_held_in_slices(monkeypatch):
    rng = np.random.default_rng(4)
    asked = pd.DataFrame({"query_id": range(8), "embedding": [rng.normal(size=3) for _ in range(8)]})
    items = pd.DataFrame({"id": np.arange(90) // 3, "chunk_id": range(90), "embedding": [rng.normal(size=3) for _ in range(90)]})
    whole, sliced = search.BestChunks(asked, 4), search.BestChunks(asked, 4)
    whole.add(items)
    monkeypatch.setattr(search, "MAX_SCORES", 80)
    sizes, real = [], search._unit_rows
    monkeypatch.setattr(search, "_unit_rows", lambda v, dim: sizes.append(len(v)) or real(v, dim))
    sliced.add(items)
    assert max(sizes) == 10 and whole.rows().values.tolist() == sliced.rows().values.tolist()


def test_place_of_the_content_is_found_once_for_a_document(spark):
    """A title of many words: its words are counted below the explode, not for each word of the content."""
    docs = spark.createDataFrame([(1, "en " * 3000, "to tre " * 20000)], "id bigint, title string, content string")
    for config in ("simple", "norwegian"):
        rows = search.build_postings(docs, config)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        above, _, below = plan.partition("Generate explode")
        assert "regexp_extract_all" not in above and "regexp_extract_all" in below
    last = search.build_postings(docs, "simple").agg(F.max("pos"), F.count("*")).first()
    assert tuple(last) == (43000, 43000)


def test_words_of_a_document_are_gathered_where_they_are(spark, monkeypatch):
    """Texts are moved once, by id; the lists need no exchange of single words, and documents are counted without a distinct."""
    docs = spark.createDataFrame([(1, "sild torsk", "sild sild makrell"), (2, "laks", "sild laks")], "id bigint, title string, content string")
    store, plans = PostingsStore.new(spark, "simple", 4), []
    write = store._write
    monkeypatch.setattr(store, "_write", lambda rows, *rest: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, *rest))
    number = store.add(docs)
    initial = plans[0]
    assert initial.count("Exchange hashpartitioning") == 1 and "hashpartitioning(id" in initial
    counted = store._read([number], "lexemes", "bucket int, lexeme string, documents bigint")
    assert {r["lexeme"]: r["documents"] for r in counted.collect()} == {"sild": 2, "torsk": 1, "makrell": 1, "laks": 1}
    got = {(r["lexeme"], r["id"], r["weight"]): r["positions"] for r in store.postings().collect()}
    assert got[("sild", 1, "A")] == [1] and got[("sild", 1, "B")] == [3, 4] and got[("laks", 2, "B")] == [3] and len(got) == 7


def test_chunks_are_embedded_once_for_their_hits(spark):
    """Neither the hits' cover of documents nor their fields embed the chunks again."""
    plan = entry.queries()["chunk_hits_with_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow partial(document_id") == 1


def test_added_words_are_not_moved_again_and_hits_gather_theirs_once(spark, monkeypatch):
    """Words lie where their text was dealt to; only a merge deals them by bucket. A search brings a document's words together by id alone."""
    docs = spark.createDataFrame([(i, f"sild torsk {i}", "sild sild makrell laks") for i in range(40)], "id bigint, title string, content string")
    kind, dealt = type(docs), []
    whole = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, *cols: dealt.append([c for c in cols if isinstance(c, str) and c == "bucket"]) or whole(self, *cols))
    store = PostingsStore.new(spark, "simple", 4)
    store.add(docs.where("id < 30"))
    store.add(docs.where("id >= 20"))
    assert sum(dealt, []) == []
    asked = spark.createDataFrame([(1, "sild laks"), (2, "torsk"), (3, "hval"), (4, "makrell 7")], "query_id bigint, query string")
    plan = store.scores(asked)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(query_id" in line]
    assert not any(", id#" in line for line in exchanges)
    before = sorted((r.query_id, r.id, r.score) for r in store.scores(asked).collect())
    assert [sum(1 for q, *_ in before if q == n) for n in (1, 2, 3, 4)] == [40, 40, 0, 1]
    store.merge()
    assert sum(dealt, []) == ["bucket"]
    assert sorted((r.query_id, r.id, r.score) for r in store.scores(asked).collect()) == before
