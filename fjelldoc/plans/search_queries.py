"""Search: full text, vectors, trigrams and their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fjelldoc.functions import lexemes as lx
from fjelldoc.functions import vectors
from fjelldoc.functions.text import snippet
from fjelldoc.functions.trigrams import trigram_set
from fjelldoc.operators import chunking, search
from fjelldoc.operators.embed import embed_texts, hashing_embedder
from fjelldoc.operators.postings import PostingsStore
from fjelldoc.operators.scoring import top_k
from fjelldoc.plans.registry import query
from fjelldoc.sources.tables import Tables, with_tables


def label_vectors(t: Tables):
    """Query vectors: the mean vector of every label."""
    return vectors.mean_vector(t.embeddings, "label", "embedding").select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


LABEL_VECTORS = """
  qv AS (SELECT label::BIGINT AS query_id, list(v ORDER BY pos) AS qvec
         FROM (SELECT label, pos, avg(v::DOUBLE) AS v
               FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
               GROUP BY label, pos) GROUP BY label)"""

BEST_CHUNKS = f"""{LABEL_VECTORS},
  scored AS (SELECT query_id, document_id AS id, chunk_id,
                    round(list_cosine_similarity(c.embedding::DOUBLE[], qvec), 6) AS score
             FROM chunks c JOIN docs d ON c.document_id = d.id, qv
             WHERE d.indexing_status IN ('ready', 'partial') AND c.embedding IS NOT NULL),
  per_doc AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, chunk_id) = 1),
  chunk_hits AS (SELECT * FROM per_doc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(with_tables("chunks", "docs", body="").rstrip() + "," + BEST_CHUNKS + " SELECT query_id, id, chunk_id, score FROM chunk_hits")
def semantic_chunks(t: Tables):
    hits = search.search_semantic_chunks(t.chunks, t.docs, label_vectors(t))
    return hits.select("query_id", "id", "chunk_id", F.round("score", 6).alias("score"))


DOC_VECTORS = """
  dv AS (SELECT document_id AS id, list(v ORDER BY pos) AS dvec
         FROM (SELECT document_id, pos, avg(v::DOUBLE) AS v
               FROM (SELECT document_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM chunks)
               GROUP BY document_id, pos) GROUP BY document_id),
  doc_hits AS (SELECT query_id, dv.id, round(list_cosine_similarity(dvec, qvec), 6) AS score
               FROM dv JOIN docs USING (id), qv WHERE indexing_status IN ('ready', 'partial')
               QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(dvec, qvec), 6) DESC, dv.id) <= 10)"""


def doc_vectors(t: Tables):
    """Document vectors: the mean of a document's chunk vectors."""
    means = vectors.mean_vector(t.chunks, "document_id", "embedding").withColumnRenamed("document_id", "id")
    return means.join(t.docs.select("id", "indexing_status"), "id")


@query(with_tables("chunks", "docs").rstrip() + "," + LABEL_VECTORS + "," + DOC_VECTORS + " SELECT query_id, id, score FROM doc_hits")
def semantic_documents(t: Tables):
    hits = search.search_semantic_documents(doc_vectors(t), label_vectors(t))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


MERGED = f"""{BEST_CHUNKS},{DOC_VECTORS},
  supplement AS (SELECT d.query_id, d.id, d.score FROM doc_hits d
                 WHERE NOT EXISTS (SELECT 1 FROM chunk_hits c WHERE c.query_id = d.query_id AND c.id = d.id)),
  merged AS (SELECT query_id, id, chunk_id, score FROM chunk_hits UNION ALL SELECT query_id, id, NULL, score FROM supplement)"""


@query(with_tables("chunks", "docs").rstrip() + "," + MERGED + " SELECT query_id, id, score FROM supplement")
def chunk_hit_supplement(t: Tables):
    chunk_hits = search.search_semantic_chunks(t.chunks, t.docs, label_vectors(t))
    doc_hits = search.search_semantic_documents(doc_vectors(t), label_vectors(t))
    extra = doc_hits.join(chunk_hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return extra.select("query_id", "id", F.round("score", 6).alias("score"))


@query(with_tables("chunks", "docs").rstrip() + "," + MERGED + """
  SELECT query_id, id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def semantic_search(t: Tables):
    chunk_hits = search.search_semantic_chunks(t.chunks, t.docs, label_vectors(t))
    doc_hits = search.search_semantic_documents(doc_vectors(t), label_vectors(t))
    return search.merge_semantic(chunk_hits, doc_hits).select(
        "query_id", "id", "chunk_id", F.round("score", 6).alias("score"), "rank"
    )


@query(with_tables("chunks").rstrip() + """
  SELECT document_id, pos - 1 AS pos, round(avg(v::DOUBLE), 6) AS v
  FROM (SELECT document_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM chunks) GROUP BY document_id, pos""")
def average_vector(t: Tables):
    means = vectors.mean_vector(t.chunks, "document_id", "embedding")
    return means.select("document_id", F.posexplode("embedding").alias("pos", "v")).select(
        "document_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v")
    )


@query("""
  SELECT vec_id, len(e) AS dim, round(list_sum(e), 3) AS total, broken IS NULL AS malformed
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e, NULL AS broken FROM embeddings)""")
def vector_text_codec(t: Tables):
    """Vectors written as text and read back; a damaged text gives null."""
    text = t.embeddings.select("vec_id", vectors.format_vector(F.col("embedding")).alias("txt"))
    back = text.select(
        "vec_id",
        vectors.parse_vector(F.col("txt")).alias("e"),
        vectors.parse_vector(F.concat(F.lit("x"), F.col("txt"))).alias("broken"),
    )
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.select(
        "vec_id", F.size("e").cast("bigint").alias("dim"), F.round(total, 3).alias("total"), F.col("broken").isNull().alias("malformed")
    )


@query(with_tables("docs") + "SELECT id, title, indexing_status FROM docs WHERE indexing_status IN ('ready', 'partial')")
def searchable_documents(t: Tables):
    return search.searchable(t.docs).select("id", "title", "indexing_status")


@query("""
  SELECT page_id, trim(q) AS query FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN '  ' || url ELSE '   ' END AS q FROM pages)
  WHERE trim(q) <> ''""")
def blank_query_guard(t: Tables):
    asked = t.pages.select(
        "page_id", F.when(F.col("url").like("https%"), F.concat(F.lit("  "), "url")).otherwise(F.lit("   ")).alias("query")
    )
    return search.usable_queries(asked)


@query(with_tables("chunks", "docs") + """
  SELECT c.chunk_id, c.document_id, d.title FROM chunks c JOIN docs d ON c.document_id = d.id WHERE c.embedding IS NOT NULL""")
def chunks_with_documents(t: Tables):
    docs = t.docs.select(F.col("id").alias("document_id"), "title")
    return t.chunks.filter(F.col("embedding").isNotNull()).join(docs, "document_id").select("chunk_id", "document_id", "title")


# -- full text ---------------------------------------------------------------

WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"

POSTINGS = f"""
  tw AS (SELECT id, {WORDS_SQL.format('title')} AS t, {WORDS_SQL.format('content')} AS c FROM docs),
  postings AS (SELECT id, unnest(t) AS lexeme, generate_subscripts(t, 1) AS pos, 'A' AS weight FROM tw
               UNION ALL
               SELECT id, unnest(c), generate_subscripts(c, 1) + len(t), 'B' FROM tw)"""


@query(with_tables("docs").rstrip() + "," + POSTINGS + """
  SELECT lexeme, weight, count(*) AS occurrences, count(DISTINCT id) AS documents, sum(pos)::BIGINT AS position_sum
  FROM postings GROUP BY lexeme, weight""")
def search_vector_postings(t: Tables):
    p = search.build_postings(t.docs, "simple")
    return p.groupBy("lexeme", "weight").agg(
        F.count("*").alias("occurrences"), F.count_distinct("id").alias("documents"), F.sum("pos").alias("position_sum")
    )


FULLTEXT = POSTINGS.replace("FROM docs", "FROM docs WHERE indexing_status IN ('ready', 'partial')") + r""",
  terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS lexeme FROM queries),
  nt AS (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id),
  occ AS (SELECT query_id, id, lexeme, pos, CASE weight WHEN 'A' THEN 1e0 ELSE 0.4e0 END AS w FROM postings JOIN terms USING (lexeme)),
  matched AS (SELECT query_id, id, n FROM occ JOIN nt USING (query_id) GROUP BY query_id, id, n HAVING count(DISTINCT lexeme) = n),
  held AS (SELECT o.* FROM occ o JOIN matched USING (query_id, id)),
  many AS (SELECT a.query_id, a.id,
             1e0 - exp(sum(ln(1e0 - sqrt(a.w * b.w * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30
                ELSE 1e0 / (1.005e0 + 0.05e0 * exp(abs(a.pos - b.pos) / 1.5e0 - 2e0)) END)))) AS score
           FROM held a JOIN held b ON a.query_id = b.query_id AND a.id = b.id AND a.lexeme < b.lexeme GROUP BY a.query_id, a.id),
  numbered AS (SELECT o.*, row_number() OVER (PARTITION BY o.query_id, o.id ORDER BY pos) AS j FROM occ o JOIN matched m
               ON m.query_id = o.query_id AND m.id = o.id WHERE m.n = 1),
  top1 AS (SELECT query_id, id, w, j FROM numbered QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY w DESC, j) = 1),
  single AS (SELECT n.query_id, n.id, (max(t.w) + sum(n.w / (n.j * n.j)) - max(t.w / (t.j * t.j))) / 1.64493406685e0 AS score
             FROM numbered n JOIN top1 t ON n.query_id = t.query_id AND n.id = t.id GROUP BY n.query_id, n.id),
  ranked AS (SELECT query_id, id, round(score, 6) AS score FROM many UNION ALL SELECT query_id, id, round(score, 6) FROM single),
  ft_hits AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(with_tables("docs", "queries").rstrip() + "," + FULLTEXT + " SELECT query_id, id, score FROM ranked")
def fulltext_rank(t: Tables):
    postings = search.build_postings(search.searchable(t.docs), "simple")
    return search.full_text_scores(postings, t.queries, "simple")


@query(with_tables("docs", "queries").rstrip() + "," + FULLTEXT + """
  SELECT query_id, h.id, score, title, CASE WHEN length(content) > 300 THEN left(content, 300) || '…' ELSE content END AS content
  FROM ft_hits h JOIN docs USING (id)""")
def fulltext_search(t: Tables):
    return search.search_full_text(t.docs, t.queries, config="simple").select("query_id", "id", "score", "title", "content")


_ONE_WORD = FULLTEXT.replace("FROM queries)", "FROM (SELECT query_id, regexp_extract(query, '^[^ ]+') AS query FROM queries))")


@query(with_tables("docs", "queries").rstrip() + "," + _ONE_WORD + " SELECT query_id, id, score FROM ft_hits")
def fulltext_single_word(t: Tables):
    one = t.queries.select("query_id", F.split_part("query", F.lit(" "), F.lit(1)).alias("query"))
    return search.search_full_text(t.docs, one, config="simple").select("query_id", "id", "score")


_STOPS = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)
_V = lx.VOWELS
_S1 = "|".join(lx.STEP1_DELETE + lx.STEP1_TO_ER + ["s"])
_S3 = "|".join(lx.STEP3_DELETE)
STEM_SQL = f"""
  r1 AS (SELECT w, CASE WHEN length(w) >= 3 AND regexp_matches(w, '^[^{_V}]*[{_V}]+[^{_V}]')
                 THEN greatest(3, length(regexp_extract(w, '^[^{_V}]*[{_V}]+[^{_V}]'))) ELSE length(w) END AS p FROM vocab),
  s1 AS (SELECT w, p, regexp_extract(substr(w, p + 1), '({_S1})$', 1) AS suf FROM r1),
  w1 AS (SELECT w, p, CASE WHEN suf = 's' THEN CASE WHEN regexp_matches(left(w, length(w) - 1), '{lx.S_ENDING}') THEN left(w, length(w) - 1) ELSE w END
                WHEN suf IN ('erte', 'ert') THEN left(w, length(w) - length(suf)) || 'er'
                ELSE left(w, length(w) - length(suf)) END AS x FROM s1),
  w2 AS (SELECT w, p, CASE WHEN regexp_matches(substr(x, p + 1), '(dt|vt)$') THEN left(x, length(x) - 1) ELSE x END AS x FROM w1),
  stems AS (SELECT w, left(x, length(x) - length(regexp_extract(substr(x, p + 1), '({_S3})$', 1))) AS stem FROM w2)"""


@query(f"""
  WITH vocab AS (SELECT DISTINCT unnest({WORDS_SQL.format('text')}) AS w FROM documents), {STEM_SQL}
  SELECT w AS word, stem, w IN ({_STOPS}) AS is_stop FROM stems""")
def norwegian_stems(t: Tables):
    """Stem and stop-word flag of every word of the documents."""
    vocab = t.documents.select(F.explode(F.array_distinct(lx.words(F.col("text")))).alias("word")).distinct()
    stems = lx.with_norwegian_stem(vocab, "word", "stem")
    return stems.select("word", "stem", F.col("word").isin(lx.STOP_WORDS).alias("is_stop"))


NORWEGIAN = f""",
  tw AS (SELECT id, {WORDS_SQL.format('title')} AS t, {WORDS_SQL.format('content')} AS c FROM docs WHERE indexing_status IN ('ready', 'partial')),
  raw AS (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS pos, 'A' AS weight FROM tw
          UNION ALL SELECT id, unnest(c), generate_subscripts(c, 1), 'B' FROM tw),
  qraw AS (SELECT query_id, unnest({WORDS_SQL.format('query')}) AS w FROM queries),
  vocab AS (SELECT DISTINCT w FROM raw UNION SELECT DISTINCT w FROM qraw), {STEM_SQL},
  kept AS (SELECT id, stem AS lexeme, pos, weight FROM raw JOIN stems USING (w) WHERE w NOT IN ({_STOPS})),
  last_a AS (SELECT id, max(pos) AS m FROM kept WHERE weight = 'A' GROUP BY id),
  postings AS (SELECT kept.id, lexeme, CASE WHEN weight = 'B' THEN pos + coalesce(m, 0) ELSE pos END AS pos, weight
               FROM kept LEFT JOIN last_a USING (id)),
  terms AS (SELECT DISTINCT query_id, stem AS lexeme FROM qraw JOIN stems USING (w) WHERE w NOT IN ({_STOPS})),
""" + FULLTEXT[FULLTEXT.index("  nt AS"):]


@query(with_tables("docs", "queries").rstrip() + NORWEGIAN + " SELECT query_id, id, score FROM ft_hits")
def fulltext_norwegian(t: Tables):
    return search.search_full_text(t.docs, t.queries).select("query_id", "id", "score")


#: Two to four words of each search text, so that many documents hold them all.
FEW_WORDS = "SELECT query_id, array_to_string(string_split(query, ' ')[2:3 + query_id % 3], ' ') AS query FROM queries"
_STORED = NORWEGIAN.replace("FROM queries)", f"FROM ({FEW_WORDS}))").replace("IN ('ready', 'partial'))", "IN ('ready', 'partial') AND id % 19 <> 0)")


@query(with_tables("docs", "queries").rstrip() + _STORED + """
  SELECT query_id, h.id, score, title, CASE WHEN length(content) > 300 THEN left(content, 300) || '…' ELSE content END AS content
  FROM ft_hits h JOIN docs USING (id)""")
def stored_fulltext(t: Tables):
    """Short searches in stored postings: half of the documents indexed first, the rest added, some replaced and some removed."""
    docs = search.searchable(t.docs)
    store = PostingsStore.new(t.spark)
    stale = F.when(F.col("id") % 7 == 0, F.concat(F.lit("outdated "), "content")).otherwise(F.col("content"))
    store.add(docs.where("id % 2 = 0").withColumn("content", stale))
    store.add(docs.where("id % 2 = 1 OR id % 7 = 0"))
    store.merge()
    store.remove(docs.where("id % 19 = 0").select("id"))
    few = t.queries.select("query_id", F.array_join(F.slice(F.split("query", " "), F.lit(2), F.col("query_id") % 3 + 2), " ").alias("query"))
    return store.search(few, docs).select("query_id", "id", "score", "title", "content")


@query(with_tables("docs") + r"""
  SELECT query_id, id, round(occurrences_score, 6) AS score FROM (
    SELECT query_id, id, (0.1e0 + sum(0.1e0 / (n * n)) - 0.1e0) / 1.64493406685e0 AS occurrences_score
    FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id, c.id ORDER BY c.pos) AS n
          FROM (SELECT id * 1000 + part AS id, unnest(w) AS lexeme, generate_subscripts(w, 1) AS pos
                FROM (SELECT id, part, regexp_extract_all(lower(substr(content, part * 900 + 1, 1000)), '[\p{L}\p{N}_]+') AS w
                      FROM (SELECT id, content, unnest(range(0, greatest(1, (length(content) + 899) // 900))) AS part FROM docs))) c
          JOIN (SELECT item_id AS query_id, lower(regexp_extract(text, '[\p{L}\p{N}_]+')) AS lexeme FROM benchmark) q USING (lexeme))
    GROUP BY query_id, id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(occurrences_score, 6) DESC, id) <= 10""")
def stored_chunk_search(t: Tables):
    """Postings of fixed-size chunks, unweighted, searched for the first word of each benchmark text."""
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / 900), F.lit(1)) - 1))
    chunks = t.docs.select("id", "content", part.alias("part")).select(
        (F.col("id") * 1000 + F.col("part")).alias("id"), F.expr("substring(content, CAST(part * 900 + 1 AS INT), 1000)").alias("content")
    )
    store = PostingsStore.new(t.spark, "simple")
    store.add(chunks)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", lx.WORD, 0).alias("query"))
    return store.hits(asked).select("query_id", "id", "score")


# -- trigrams ----------------------------------------------------------------

GRAMS_SQL = r"""list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""

SIMILARITY = f"""
  td AS (SELECT id, {GRAMS_SQL.format('title')} AS g FROM docs WHERE indexing_status IN ('ready', 'partial')),
  tq AS (SELECT query_id, {GRAMS_SQL.format('query')} AS g FROM queries),
  sim AS (SELECT query_id, id, round(len(list_intersect(td.g, tq.g)) / (len(td.g) + len(tq.g) - len(list_intersect(td.g, tq.g))), 6) AS similarity
          FROM td, tq),
  fuzzy_hits AS (SELECT query_id, id, similarity AS score FROM sim WHERE similarity > 0.1e0
                 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 10)"""


@query(with_tables("docs", "queries").rstrip() + "," + SIMILARITY + " SELECT query_id, id, similarity FROM sim WHERE similarity > 0.1e0")
def trigram_title_similarity(t: Tables):
    return search.title_similarity(search.searchable(t.docs), t.queries)


@query(f"SELECT item_id, len(g) AS n_trigrams, list_aggregate(list_sort(g), 'string_agg', '|') AS grams FROM (SELECT item_id, {GRAMS_SQL.format('text')} AS g FROM benchmark)")
def trigram_sets(t: Tables):
    g = t.benchmark.select("item_id", F.array_sort(trigram_set(F.col("text"))).alias("g"))
    return g.select("item_id", F.size("g").cast("bigint").alias("n_trigrams"), F.array_join("g", "|").alias("grams"))


@query()
def fuzzy_search(t: Tables):
    """Title similarity or word similarity over the whole contents; tested against brute force."""
    return search.search_fuzzy(t.docs, t.queries).select("query_id", "id", "score")


# -- combination -------------------------------------------------------------

EMBED_DIM = 64
EMBED_SQL = """
  {name}_b AS (SELECT {key}, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS b, count(*) AS n
     FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) GROUP BY {key}, b),
  {name}_n AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_b GROUP BY {key})"""

TEXT_COSINE = (
    EMBED_SQL.format(name="dh", key="id", text="content", source="docs WHERE indexing_status IN ('ready', 'partial')")
    + ","
    + EMBED_SQL.format(name="qh", key="query_id", text="query", source="queries")
    + """,
  sem AS (SELECT query_id, id, round(sum(d.n * q.n) / (max(dn.norm) * max(qn.norm)), 6) AS score
          FROM dh_b d JOIN qh_b q USING (b) JOIN dh_n dn USING (id) JOIN qh_n qn USING (query_id) GROUP BY query_id, id),
  alldocs AS (SELECT query_id, id, coalesce(score, 0) AS score FROM (SELECT id, query_id FROM dh_n, qh_n) LEFT JOIN sem USING (id, query_id)),
  sem_hits AS (SELECT * FROM alldocs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""
)


def text_vectors(t: Tables, queries: DataFrame):
    """Hashed word vectors of the documents and of the search texts."""
    embed = hashing_embedder(EMBED_DIM)
    docs = embed_texts(t.docs.select("id", "indexing_status", "content"), embed, "content")
    asked = embed_texts(search.usable_queries(queries), embed, "query")
    return docs, asked


@query(with_tables("docs", "queries").rstrip() + "," + TEXT_COSINE + " SELECT query_id, id, score FROM sem_hits")
def semantic_text_search(t: Tables):
    docs, asked = text_vectors(t, t.queries)
    return search.search_semantic_documents(docs, asked).select("query_id", "id", F.round("score", 6).alias("score"))


def _title_hits(t: Tables):
    sims = search.title_similarity(search.searchable(t.docs), t.queries).withColumnRenamed("similarity", "score")
    return top_k(sims, "query_id", "score", "id", search.DEFAULT_LIMIT)


def _merged_methods(t: Tables):
    docs, asked = text_vectors(t, t.queries)
    full = top_k(
        search.full_text_scores(search.build_postings(search.searchable(t.docs), "simple"), t.queries, "simple"), "query_id", "score", "id", 10
    )
    return search.hybrid_merge(
        {"fulltext": full, "semantic": search.search_semantic_documents(docs, asked), "fuzzy": _title_hits(t)}
    )


HYBRID = f"""{FULLTEXT},{SIMILARITY},{TEXT_COSINE},
  methods AS (SELECT query_id, id, score, 'fulltext' AS source, 0 AS m FROM ft_hits
              UNION ALL SELECT query_id, id, score, 'semantic', 1 FROM sem_hits
              UNION ALL SELECT query_id, id, score, 'fuzzy', 2 FROM fuzzy_hits),
  best AS (SELECT query_id, id, score, source FROM methods QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, m) = 1),
  merged_hits AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""


@query(with_tables("docs", "queries").rstrip() + "," + HYBRID + " SELECT query_id, id, score, source FROM merged_hits")
def hybrid_best_hits(t: Tables):
    return _merged_methods(t).select("query_id", "id", "score", "source")


@query(with_tables("docs", "queries").rstrip() + "," + HYBRID + """
  SELECT query_id, id, score, source, count(*) OVER (PARTITION BY query_id) AS count FROM merged_hits""")
def search_result_envelope(t: Tables):
    return search.with_counts(_merged_methods(t)).select("query_id", "id", "score", "source", "count")


def plain_chunks(t: Tables):
    """Chunks of the documents with their section fields."""
    return chunking.chunk_documents(t.blocks).withColumn("chunk_id", F.col("doc_id") * 100_000 + F.col("chunk_index")).withColumnRenamed("doc_id", "document_id")


def embedded_chunks(t: Tables):
    """Chunks with hashed word vectors, without the fields that no search reads."""
    return embed_texts(plain_chunks(t).select("document_id", "chunk_id", "text"), hashing_embedder(EMBED_DIM), "text")


@query()
def hybrid_search(t: Tables):
    """Full text, vectors of chunks and documents, and fuzzy search with word similarity together."""
    docs, asked = text_vectors(t, t.queries)
    chunks = embedded_chunks(t) if hasattr(t, "blocks") else None
    return search.hybrid_search(t.docs, t.queries, chunks, docs, asked).select("query_id", "id", "score", "source")


@query()
def chunk_hits_with_fields(t: Tables):
    """Vector search over chunks, each hit with title, snippet, heading path, topic, alternative, area code, table flag and pages."""
    docs, asked = text_vectors(t, t.queries)
    hits = search.merge_semantic(search.search_semantic_chunks(embedded_chunks(t), t.docs, asked), search.search_semantic_documents(docs, asked))
    found = search.with_chunk(hits, plain_chunks(t), t.docs)  # the fields need no vectors
    return found.select("query_id", "rank", "id", "chunk_id", "score", "title", "content", *[c for c in search.CHUNK_FIELDS if c != "text"])


@query(with_tables("docs") + """
  SELECT id, CASE WHEN length(content) > 300 THEN left(content, 300) || '…' ELSE content END AS content FROM docs""")
def content_snippets(t: Tables):
    return t.docs.select("id", snippet(F.col("content")).alias("content"))
