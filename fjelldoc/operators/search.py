"""Full-text, vector, trigram and combined search for many queries at once."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjelldoc.functions import lexemes as lx
from fjelldoc.functions.text import snippet
from fjelldoc.functions.trigrams import set_similarity, trigram_set
from fjelldoc.operators.scoring import scan_items, top_k
from fjelldoc.operators.wordsim import BestTexts, Glances

# Searchable states, default result size, trigram threshold, text configuration.
SEARCHABLE = ("ready", "partial")
DEFAULT_LIMIT = 10
FUZZY_THRESHOLD = 0.1
DEFAULT_CONFIG = "norwegian"


def searchable(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("indexing_status").isin(*SEARCHABLE))


def usable_queries(queries: DataFrame) -> DataFrame:
    """Blank queries give no rows."""
    return queries.filter(F.trim("query") != "").withColumn("query", F.trim("query"))


# -- full text ---------------------------------------------------------------


def build_postings(docs: DataFrame, config: str = DEFAULT_CONFIG, terms: DataFrame | None = None) -> DataFrame:
    """One row per (id, lexeme, weight, pos); one scan, no shuffle: each document is expanded in place.

    Title positions carry weight A; content positions carry weight B and continue after the title. Without a
    title column (chunks) all positions carry weight D.
    The outer form of explode keeps the optimizer from adding a size filter that would tokenise twice.
    With `terms` only words that can become one of those lexemes are kept: stemming never changes
    the first three letters, so a semi-join on them comes before the stemmer.
    """

    def part(text: str, weight: str) -> Column:
        return F.transform(lx.words(F.coalesce(F.col(text), F.lit(""))), lambda w, i: F.struct(w.alias("lexeme"), F.lit(weight).alias("weight"), (i + 1).alias("pos")))

    # where the content begins is found once for a document, as a column below the explode, and not for each word
    if "title" in docs.columns:
        found, after = F.concat(part("title", "A"), part("content", "B")), lx.last_title_position(F.col("title"), config)
    else:
        found, after = part("content", "D"), F.lit(0)
    both = docs.select("id", after.alias("_after"), found.alias("_o")).select("id", "_after", F.explode_outer("_o").alias("o")).where("o IS NOT NULL")
    pos = F.when(F.col("o.weight") == "B", F.col("o.pos") + F.col("_after")).otherwise(F.col("o.pos"))
    both = both.select("id", "o.lexeme", "o.weight", pos.alias("pos"))
    if terms is not None:
        heads = terms.select(F.left("lexeme", F.lit(3)).alias("_head")).distinct()
        both = both.withColumn("_head", F.left("lexeme", F.lit(3))).join(heads, "_head", "left_semi").drop("_head")
    return lx.normalise_lexemes(both, config)


def query_terms(queries: DataFrame, config: str = DEFAULT_CONFIG) -> DataFrame:
    tokens = usable_queries(queries).select("query_id", F.explode(lx.words(F.col("query"))).alias("lexeme"))
    terms = lx.normalise_lexemes(tokens, config).groupBy("query_id").agg(F.collect_set("lexeme").alias("terms"))
    return terms.select("query_id", "terms", F.size("terms").alias("n_terms"), F.explode("terms").alias("lexeme"))


def full_text_scores(postings: DataFrame, queries: DataFrame, config: str = DEFAULT_CONFIG) -> DataFrame:
    """(query_id, id, score) of every document holding all words of the query.

    A document meets a query only under the query's longest word; the common words of a long query
    then cost one posting each and not one for each query that has them.
    """
    terms = query_terms(queries, config)
    longest = F.array_max(F.transform("terms", lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    wanted = terms.groupBy("lexeme").agg(F.collect_set(F.when(F.col("lexeme") == longest, F.col("query_id"))).alias("asked"))
    occurrence = F.struct("pos", "lexeme", lx.weight_value(F.col("weight")).alias("w"))
    found = (
        postings.join(wanted, "lexeme")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(occurrence)).alias("occ"), F.flatten(F.collect_set("asked")).alias("asked"))
        .where(F.size("asked") > 0)
        .select("id", "occ", F.array_distinct(F.transform("occ", lambda o: o["lexeme"])).alias("held"), F.explode("asked").alias("query_id"))
    )
    asked = terms.select("query_id", "terms", "n_terms").distinct()
    # a set difference tells whether all words are there; only then are the occurrences looked through
    whole = found.join(asked, "query_id").where(F.size(F.array_except("terms", "held")) == 0)
    matched = whole.select("query_id", "id", "n_terms", F.filter("occ", lambda o: F.array_contains("terms", o["lexeme"])).alias("occ"))
    return ranked(matched)


def ranked(matched: DataFrame) -> DataFrame:
    """(query_id, id, score) of the rows (query_id, id, n_terms, occ) that hold all words."""
    matched = matched.filter(F.size(F.array_distinct(F.transform("occ", lambda o: o["lexeme"]))) == F.col("n_terms"))
    score = F.when(F.col("n_terms") == 1, lx.rank_single(F.col("occ"))).otherwise(lx.rank_pairs(F.col("occ")))
    return matched.select("query_id", "id", F.round(score, 6).alias("score"))


def search_full_text(
    docs: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, config: str = DEFAULT_CONFIG
) -> DataFrame:
    """Rank on ids first; text is read back only for the rows that are returned."""
    found = searchable(docs)
    postings = build_postings(found, config, query_terms(queries, config) if config != "simple" else None)
    hits = top_k(full_text_scores(postings, queries, config), "query_id", "score", "id", limit)
    return with_text(hits, found)


def with_text(hits: DataFrame, docs: DataFrame) -> DataFrame:
    return hits.join(docs.select("id", "title", snippet(F.col("content")).alias("content")), "id")


# -- vectors -----------------------------------------------------------------


def _unit_rows(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised matrix of the usable vectors and a mask of which rows those are."""
    ok = vectors.map(lambda v: v is not None and len(v) == dim).to_numpy(bool)
    rows = np.zeros((len(vectors), dim))
    if ok.any():
        rows[ok] = np.stack(vectors[ok].to_list()).astype(np.float64)
    norm = np.sqrt((rows * rows).sum(axis=1))
    ok &= norm > 0
    rows[ok] /= norm[ok, None]
    return rows, ok


#: Queries whose scores a task holds at once.
MAX_QUERIES = 2048
#: Scores of a slice of items that a task holds at once.
MAX_SCORES = 1 << 20


class BestChunks:
    """Per query, the best chunk of every document and the best k documents, over any number of batches.

    A query meets the items of its own dimension; one without a usable vector has no hits.
    """

    def __init__(self, queries: pd.DataFrame, k: int, max_queries: int = MAX_QUERIES):
        self.k, self.blocks, self.parts = k, [], []
        sizes = queries["embedding"].map(lambda v: 0 if v is None else len(v))
        for dim, asked in queries[sizes > 0].groupby(sizes[sizes > 0]):
            q, ok = _unit_rows(asked["embedding"], dim)
            ids, q = asked["query_id"].to_numpy()[ok], q[ok]
            self.blocks += [(dim, ids[i : i + max_queries], q[i : i + max_queries]) for i in range(0, len(ids), max_queries)]

    def add(self, items: pd.DataFrame) -> None:
        step = max(1, MAX_SCORES // max([len(ids) for _, ids, _ in self.blocks], default=1))
        for begin in range(0, len(items), step):
            self._add(items.iloc[begin : begin + step])

    def _add(self, items: pd.DataFrame) -> None:
        units: dict[int, tuple] = {}
        for dim, query_ids, q in self.blocks:
            if dim not in units:
                v, ok = _unit_rows(items["embedding"], dim)
                ids, chunks = items["id"].to_numpy()[ok], items["chunk_id"].to_numpy()[ok]
                order = np.lexsort((chunks, ids))
                units[dim] = v[ok][order], ids[order], chunks[order], np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
            v, ids, chunks, starts = units[dim]
            if not len(ids):
                continue
            scores = np.round(v @ q.T, 6)
            best = np.maximum.reduceat(scores, starts, axis=0)
            for col, query_id in enumerate(query_ids.tolist()):
                docs = np.lexsort((ids[starts], -best[:, col]))[: self.k]
                # of a document's equally good chunks the one with the least id, which comes first
                ends = np.append(starts[1:], len(ids))
                at = [starts[d] + int(np.argmax(scores[starts[d] : ends[d], col])) for d in docs]
                self.parts.append(pd.DataFrame({"query_id": query_id, "id": ids[at], "chunk_id": chunks[at], "score": scores[at, col]}))
        if len(self.parts) > 4096:
            self.parts = [self.rows()]

    def rows(self) -> pd.DataFrame:
        if not self.parts:
            return pd.DataFrame({"query_id": [], "id": [], "chunk_id": [], "score": []})
        rows = pd.concat(self.parts).sort_values(["query_id", "id", "score", "chunk_id"], ascending=[True, True, False, True]).drop_duplicates(["query_id", "id"])
        return rows.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(self.k)


def check_vectors(queries: DataFrame, dim: int) -> DataFrame:
    """Adds `error` to queries whose vector can't be searched with; null for the others."""
    v = F.col("embedding")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    reason = F.when(v.isNull(), "no vector").when(F.size(v) != dim, F.concat(F.lit("dimension is not "), F.lit(str(dim))))
    return queries.withColumn("error", reason.when(F.coalesce(length, F.lit(0.0)) == 0, "vector without a direction"))


def _nearest(items: DataFrame, queries: DataFrame, limit: int, max_queries: int | None = None, passes: int = 1) -> DataFrame:
    """Items are scored where they lie; a query set beyond one pass takes several scans."""
    schema = "query_id bigint, id bigint, chunk_id bigint, score double"
    make = partial(BestChunks, k=limit, max_queries=max_queries or MAX_QUERIES)
    rows = scan_items(items.select("id", "chunk_id", "embedding"), queries.select("query_id", "embedding"), make, schema, passes)
    w = Window.partitionBy("query_id", "id").orderBy(F.col("score").desc(), "chunk_id")
    per_doc = rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return top_k(per_doc, "query_id", "score", "id", limit)


def search_semantic_chunks(
    chunks: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, max_queries: int | None = None
) -> DataFrame:
    """Best chunk per searchable document by cosine similarity, best documents per query."""
    keep = searchable(docs).select(F.col("id").alias("document_id"))
    items = (
        chunks.filter(F.col("embedding").isNotNull())
        .join(keep, "document_id", "left_semi")
        .select(F.col("document_id").alias("id"), "chunk_id", "embedding")
    )
    return _nearest(items, queries, limit, max_queries)


def search_semantic_documents(doc_vectors: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Document-level cosine search; `doc_vectors` holds (id, indexing_status, embedding)."""
    items = (
        searchable(doc_vectors)
        .filter(F.col("embedding").isNotNull())
        .select("id", F.col("id").alias("chunk_id"), "embedding")
    )
    return _nearest(items, queries, limit).drop("chunk_id")


def merge_semantic(chunk_hits: DataFrame, doc_hits: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Chunk hits plus the document hits they do not cover, cut again."""
    # told apart by a mark and not by a join, which would search the chunks a second time
    marked = [hits.drop("rank").withColumn("_of_chunk", F.lit(of_chunk)) for hits, of_chunk in ((chunk_hits, True), (doc_hits, False))]
    both = marked[0].unionByName(marked[1], allowMissingColumns=True).withColumn("_covered", F.max("_of_chunk").over(Window.partitionBy("query_id", "id")))
    return top_k(both.where("_of_chunk = _covered").drop("_of_chunk", "_covered"), "query_id", "score", "id", limit)


#: Section fields that a chunk hit is returned with.
CHUNK_FIELDS = ["text", "heading_path", "section_title", "section_number", "topic_type", "alternative", "delomrade", "contains_table", "page_start", "page_end"]


def with_chunk(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Title, chunk text as snippet and section fields of the returned hits only; document hits have null fields and the document's snippet."""
    fields = chunks.select("chunk_id", *[F.col(c) for c in CHUNK_FIELDS])
    joined = hits.join(docs.select("id", "title", snippet(F.col("content")).alias("_content")), "id").join(fields, "chunk_id", "left")
    return joined.withColumn("content", F.coalesce(snippet(F.col("text")), F.col("_content"))).drop("_content")


def hybrid_search(
    docs: DataFrame, queries: DataFrame, chunks: DataFrame | None = None, doc_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    limit: int = DEFAULT_LIMIT, methods: tuple[str, ...] = ("fulltext", "semantic", "fuzzy"), store=None,
) -> DataFrame:
    """Full text, vectors (chunks first, documents they don't cover after) and fuzzy search, the best hit per document.

    A method that is left out of `methods`, or whose vectors are not given, is skipped. Full text uses stored postings
    if a `store` is given.
    """
    lists: dict[str, DataFrame] = {}
    if "fulltext" in methods:
        lists["fulltext"] = store.hits(queries, limit) if store is not None else search_full_text(docs, queries, limit)
    if "semantic" in methods and query_vectors is not None:
        legs = []
        if chunks is not None:
            legs.append(search_semantic_chunks(chunks, docs, query_vectors, limit))
        if doc_vectors is not None:
            legs.append(search_semantic_documents(doc_vectors, query_vectors, limit))
        if legs:
            lists["semantic"] = legs[0] if len(legs) == 1 else merge_semantic(*legs, limit)
    if "fuzzy" in methods:
        lists["fuzzy"] = search_fuzzy(docs, queries, limit)
    return hybrid_merge(lists, limit)


# -- trigrams ----------------------------------------------------------------


def title_similarity(docs: DataFrame, queries: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(query_id, id, similarity) above the threshold, found through shared title trigrams only."""
    title = docs.select("id", trigram_set(F.col("title")).alias("g")).select(
        "id", F.size("g").alias("n_title"), F.explode_outer("g").alias("gram")
    )
    asked = (
        usable_queries(queries)
        .select("query_id", trigram_set(F.col("query")).alias("g"))
        .select("query_id", F.size("g").alias("n_query"), F.explode("g").alias("gram"))
    )
    shared = title.join(asked, "gram").groupBy("query_id", "id", "n_title", "n_query").agg(F.count("*").alias("shared"))
    score = set_similarity(F.col("shared"), F.col("n_title"), F.col("n_query"))
    return shared.filter(score > threshold).select("query_id", "id", F.round(score, 6).alias("similarity"))


def search_fuzzy(docs: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT, passes: int = 1) -> DataFrame:
    """Greater of title similarity and word similarity in the content, above the threshold."""
    found = searchable(docs)
    in_title = top_k(title_similarity(found, queries), "query_id", "similarity", "id", limit).select(
        "query_id", "id", F.col("similarity").alias("score")
    )
    # sweeping a text costs far more than moving it, so texts are dealt evenly first
    texts = found.select("id", "content").repartition(F.col("id"))
    asked, schema = usable_queries(queries).select("query_id", "query"), "query_id bigint, id bigint, score double"
    # a glance at all texts gives each query a score that `limit` texts reach; every task begins with it
    seen = scan_items(texts, asked, partial(Glances, k=limit, threshold=FUZZY_THRESHOLD), schema, passes)
    seen = seen.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    limits = top_k(seen, "query_id", "score", "id", limit).where(F.col("rank") == limit).select("query_id", F.col("score").alias("limit"))
    asked = asked.join(limits, "query_id", "left")
    in_text = scan_items(texts, asked, partial(BestTexts, k=limit, threshold=FUZZY_THRESHOLD), schema, passes)
    best = in_title.unionByName(in_text).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(best, "query_id", "score", "id", limit)


# -- combination -------------------------------------------------------------

METHODS = ("fulltext", "semantic", "fuzzy")


def hybrid_merge(lists: dict[str, DataFrame], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Union of per-method hit lists; the highest score per document wins, earlier methods on ties."""
    tagged = [
        df.select("query_id", "id", "score", F.lit(name).alias("source"), F.lit(METHODS.index(name)).alias("_m"))
        for name, df in lists.items()
    ]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    best = union.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("_m")).alias("m"), "source")).alias("b"))
    return top_k(best.select("query_id", "id", "b.score", "b.source"), "query_id", "score", "id", limit)


def with_counts(hits: DataFrame) -> DataFrame:
    """Each hit together with the number of hits of its query (k per query, so the group is bounded)."""
    return hits.withColumn("count", F.count("*").over(Window.partitionBy("query_id")))
