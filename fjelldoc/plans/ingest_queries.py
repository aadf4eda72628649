"""Indexing decisions, status changes, the embedding cache and catalogue lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjelldoc.operators import catalogue, embed, ingest, keyed
from fjelldoc.plans.chat_queries import incoming_layers, INCOMING, STORED, stored_layers
from fjelldoc.plans.registry import query
from fjelldoc.session import checkpoint_root
from fjelldoc.sources import files
from fjelldoc.sources.tables import Tables, with_tables


def doc_state(t: Tables):
    """The stored document table; English documents have been indexed before."""
    return t.docs.select(
        "*",
        F.when(F.col("indexing_status") == "failed", "boom").alias("error_message"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.when(F.col("indexing_status") == "ready", F.col("updated_at")).alias("indexed_at"),
        F.col("last_modified").alias("created_at"),
    ).drop("id")


STATE = """
  state AS (SELECT * EXCLUDE (id), CASE WHEN indexing_status = 'failed' THEN 'boom' END AS error_message,
                   CASE WHEN indexing_status = 'ready' THEN updated_at END AS indexed_at, last_modified AS created_at FROM docs)"""

JOINED = """
  found AS (SELECT b.*, d.indexing_status, d.last_modified AS slm, d.file_hash AS sh, d.source_blob IS NOT NULL AS known FROM blobs b LEFT JOIN docs d ON d.source_blob = b.name)"""


@query(with_tables("blobs", "docs").rstrip() + "," + JOINED + """
  SELECT name, CASE WHEN NOT known THEN true WHEN indexing_status = 'processing' THEN false WHEN indexing_status = 'ready' THEN slm <> last_modified OR sh <> file_hash
         WHEN indexing_status = 'failed' THEN false ELSE true END AS reindex FROM found""")
def reindex_decisions(t: Tables):
    return ingest.reindex_decision(t.blobs, t.docs, retry_failed=False).select("name", "reindex")


@query(with_tables("blobs", "docs").rstrip() + "," + JOINED + """
  SELECT name, file_hash FROM found WHERE NOT known OR CASE indexing_status WHEN 'processing' THEN false
    WHEN 'ready' THEN slm IS DISTINCT FROM last_modified OR sh IS DISTINCT FROM file_hash ELSE true END""")
def claimed_files(t: Tables):
    return ingest.claim(t.blobs, t.docs).select("name", "file_hash")


@query(with_tables("blobs", "docs").rstrip() + "," + JOINED + """
  SELECT name, known, coalesce(slm <> last_modified OR sh <> file_hash, true) AS changed FROM found""")
def file_changes(t: Tables):
    found = ingest.with_state(t.blobs, t.docs)
    differs = (F.col("stored_last_modified") != F.col("last_modified")) | (F.col("stored_file_hash") != F.col("file_hash"))
    return found.select("name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce(differs, F.lit(True)).alias("changed"))


def stale_time():
    return F.timestamp_seconds(F.lit(1704067200 + 40000))


STALE_SQL = "TIMESTAMP '2024-01-01' + INTERVAL 40000 SECOND"


@query(with_tables("docs").rstrip() + "," + STATE + f"""
  SELECT source_blob, CASE WHEN s THEN 'new' ELSE indexing_status END AS indexing_status, CASE WHEN s THEN 'Reclaimed from stale processing state' ELSE error_message END AS error_message
  FROM (SELECT *, indexing_status = 'processing' AND updated_at < {STALE_SQL} - INTERVAL 30 MINUTE AS s FROM state)""")
def stale_reclaim(t: Tables):
    return ingest.reclaim_stale(doc_state(t), stale_time()).select("source_blob", "indexing_status", "error_message")


@query(with_tables("docs", "blobs").rstrip() + "," + STATE + f"""
  SELECT source_blob, strftime(CASE WHEN indexing_status = 'processing' AND source_blob IN (SELECT name FROM blobs) THEN {STALE_SQL} ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM state""")
def lease_refresh(t: Tables):
    out = ingest.refresh_lease(doc_state(t), t.blobs, stale_time())
    return out.select("source_blob", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(with_tables("docs", "blobs") + """
  SELECT source_blob, CASE WHEN source_blob IN (SELECT name FROM blobs WHERE length(file_hash) = 32) THEN 'new' ELSE indexing_status END AS indexing_status FROM docs""")
def forced_reset(t: Tables):
    changed = t.blobs.filter(F.length("file_hash") == 32)
    return ingest.force_reset(doc_state(t), changed).select("source_blob", "indexing_status")


@query(with_tables("docs").rstrip() + "," + STATE + """,
  changes AS (SELECT source_blob, CASE WHEN quality = 1 THEN 'ready' ELSE 'failed' END AS status, CASE WHEN toxic = 1 THEN 'toxic' END AS error FROM labels JOIN docs ON id = doc_id)
  SELECT source_blob, coalesce(status, indexing_status) AS indexing_status, CASE WHEN status IS NULL THEN error_message ELSE error END AS error_message
  FROM state LEFT JOIN changes USING (source_blob)""")
def status_transitions(t: Tables):
    ids = t.docs.select(F.col("id").alias("doc_id"), "source_blob")
    changes = t.labels.join(ids, "doc_id").select(
        "source_blob", F.when(F.col("quality") == 1, "ready").otherwise("failed").alias("status"), F.when(F.col("toxic") == 1, "toxic").alias("error")
    )
    return ingest.set_status(doc_state(t), changes).select("source_blob", "indexing_status", "error_message")


@query(with_tables("docs").rstrip() + "," + STATE + """
  SELECT source_blob, CASE WHEN n THEN 'ready' ELSE indexing_status END AS indexing_status, strftime(CASE WHEN n THEN updated_at ELSE indexed_at END, '%Y-%m-%d %H:%M:%S') AS indexed_at
  FROM (SELECT *, indexing_status = 'new' AND content <> '' AS n FROM state)""")
def status_backfill(t: Tables):
    out = ingest.backfill(doc_state(t))
    return out.select("source_blob", "indexing_status", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))


@query(with_tables("docs") + """
  SELECT indexing_status, count(*) AS count FROM docs GROUP BY indexing_status UNION ALL SELECT 'total', count(*) FROM docs""")
def indexing_status_counts(t: Tables):
    return ingest.indexing_status(t.docs)


@query(with_tables("docs").rstrip() + "," + STATE + " SELECT source_blob, error_message FROM state WHERE indexing_status = 'failed'")
def failed_document_list(t: Tables):
    return ingest.failed_documents(doc_state(t))


def partial_chunks(t: Tables):
    """Chunk vectors, some of them missing."""
    return t.chunks.withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))


OUTCOME = """
  outcome AS (SELECT document_id, count(*) AS total, count(CASE WHEN label <> 3 THEN 1 END) AS embedded FROM chunks GROUP BY document_id)"""


@query(with_tables("chunks").rstrip() + "," + OUTCOME + """
  SELECT document_id, total, embedded, CASE WHEN total > 0 AND embedded = total THEN 'ready' ELSE 'partial' END AS status FROM outcome""")
def embedding_outcomes(t: Tables):
    return ingest.embedding_outcome(partial_chunks(t), "document_id")


@query(with_tables("docs") + """
  SELECT count(*) AS total, count(*) FILTER (indexing_status = 'ready') AS indexed, count(*) FILTER (indexing_status = 'partial') AS partial,
         count(*) FILTER (indexing_status IN ('new', 'processing')) AS skipped, count(*) FILTER (indexing_status = 'failed') AS failed FROM docs""")
def run_summary(t: Tables):
    word = F.when(F.col("indexing_status") == "ready", "ok").when(F.col("indexing_status") == "failed", "error")
    word = word.when(F.col("indexing_status") == "partial", "partial").otherwise("skipped")
    return ingest.run_summary(t.docs.select(word.alias("status")))


CACHE = """
  old AS (SELECT document_id, vec_id AS chunk_id, sha256(d.text) AS h, CASE WHEN label = 2 THEN NULL ELSE embedding END AS embedding
          FROM (SELECT vec_id, vec_id // 10 AS document_id, label, embedding FROM embeddings) e JOIN documents d ON d.doc_id = e.vec_id),
  cache AS (SELECT document_id, h, chunk_id FROM old WHERE embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, h ORDER BY chunk_id DESC) = 1)"""


@query("WITH" + CACHE + """
  SELECT o.chunk_id, c.chunk_id AS source_chunk FROM old o LEFT JOIN cache c ON c.document_id = o.document_id AND c.h = o.h""")
def embedding_cache_lookup(t: Tables):
    """Vectors found again by text hash within the same document; the first vector entry tags the source."""
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    joined = t.chunks.join(texts, "chunk_id")
    tagged = F.concat(F.array(F.col("chunk_id").cast("float")), F.col("embedding"))
    old = joined.select("document_id", "chunk_id", "text", F.when(F.col("label") != 2, tagged).alias("embedding"))
    found = embed.attach_cache(old.drop("embedding"), embed.cached_vectors(old, 65, "chunk_id"))
    return found.select("chunk_id", F.element_at("embedding", 1).cast("bigint").alias("source_chunk"))


@query("""
  SELECT d.doc_id, sum(('0x' || substr(md5(w), 1, 4))::INTEGER % 64)::BIGINT AS bucket_sum, count(*) AS words
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents) d GROUP BY d.doc_id""")
def embedded_documents(t: Tables):
    """The embedding job with a deterministic embedder over whole texts."""
    rows = embed.embed_texts(t.documents.select("doc_id", "text"), embed.hashing_embedder(64))
    cells = rows.select("doc_id", F.posexplode("embedding").alias("b", "n"))
    totals = cells.groupBy("doc_id").agg(F.sum(F.col("b") * F.col("n")).cast("bigint").alias("bucket_sum"), F.sum("n").cast("bigint").alias("words"))
    return totals.filter("words > 0")


@query("""
  SELECT doc_id, b::BIGINT AS pos, round(n / k, 6) AS v FROM (
    SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS b, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(substr(text, i * 900 + 1, 1000)), '[\\p{L}\\p{N}]+')) AS w
          FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 899) // 900)) AS i FROM documents)) GROUP BY 1, 2)
  JOIN (SELECT doc_id, (length(text) + 899) // 900 AS k FROM documents) USING (doc_id)""")
def document_vector_fallback(t: Tables):
    texts = t.documents.select("doc_id", F.col("text").alias("content"))
    v = ingest.fallback_vectors(texts, embed.hashing_embedder(64))
    return v.select("doc_id", F.posexplode("doc_vector").alias("pos", "v")).filter("v > 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v")
    )


@query(with_tables("chunks").rstrip() + """,
  owners AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), fresh AS (SELECT doc_id AS document_id, -doc_id AS chunk_id FROM owners)
  SELECT document_id, chunk_id FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM owners) UNION ALL SELECT document_id, chunk_id FROM fresh""")
def chunk_replacement(t: Tables):
    owners = t.labels.filter("quality = 0").select(F.col("doc_id").alias("document_id")).distinct()
    fresh = owners.select("document_id", (-F.col("document_id")).alias("chunk_id"))
    return keyed.replace_children(t.chunks.select("document_id", "chunk_id"), fresh, owners, "document_id")


@query(with_tables("docs", "blobs") + """
  SELECT coalesce(n.name, d.source_blob) AS source_blob, coalesce(n.file_hash, d.file_hash) AS file_hash, CASE WHEN n.name IS NULL THEN d.indexing_status ELSE 'ready' END AS indexing_status
  FROM docs d FULL JOIN blobs n ON n.name = d.source_blob""")
def document_upsert(t: Tables):
    current = doc_state(t).select("source_blob", "file_hash", "indexing_status", "created_at", "updated_at")
    incoming = t.blobs.select(F.col("name").alias("source_blob"), "file_hash", F.lit("ready").alias("indexing_status"), "last_modified")
    return keyed.upsert(current, incoming, ["source_blob"], ["last_modified"], stale_time()).select("source_blob", "file_hash", "indexing_status")


@query()
def indexing_run(t: Tables):
    """The whole run over all found files, as outcome per file."""
    names = t.docs.select(F.col("id").alias("doc_id"), "source_blob")
    blocks = t.blocks.join(names, "doc_id").drop("doc_id").withColumnRenamed("source_blob", "doc_id")
    html = files.blocks_from_html(t.pages.select(F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("doc_id"), "html"))
    stored = t.docs.select(
        F.col("source_blob").alias("document_id"),
        F.lit(0).alias("chunk_index"),
        F.col("content").alias("text"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    every = blocks.unionByName(html.select(*blocks.columns))
    run = ingest.index_run(doc_state(t), stored, t.blobs, every, embed.hashing_embedder(64), 64, stale_time())
    return run.outcomes


@query("""
  SELECT n.name, string_agg(p.text, '' ORDER BY p.page) AS content, CASE WHEN count(p.text) = 0 THEN 'Kunne ikke hente dokumentet ''' || n.name || '''.' END AS error
  FROM (SELECT DISTINCT o_custkey::VARCHAR AS name FROM orders) n
  LEFT JOIN (SELECT conv_id::VARCHAR AS name, turn AS page, text FROM conversations) p USING (name) GROUP BY n.name""")
def fetched_documents(t: Tables):
    names = t.orders.select(F.col("o_custkey").cast("string").alias("name")).distinct()
    pages = t.conversations.select(F.col("conv_id").cast("string").alias("name"), F.col("turn").alias("page"), "text")
    return files.fetch_documents(names, pages)


@query()
def html_blocks(t: Tables):
    """Blocks of every page with font sizes and bold marks."""
    return files.blocks_from_html(t.pages.select(F.col("page_id").alias("doc_id"), "html"))


# -- catalogue ---------------------------------------------------------------


def nation_codes(t: Tables):
    return t.nation.select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("identifier"), F.col("n_name").alias("description"))


@query("SELECT lpad(n_nationkey::VARCHAR, 4, '0') AS identifier, n_name AS description FROM nation WHERE lpad(n_nationkey::VARCHAR, 4, '0') ILIKE '%n_1%' OR n_name ILIKE '%n_1%'")
def code_search(t: Tables):
    return catalogue.search_codes(nation_codes(t), "n_1")


@query("SELECT r_regionkey::VARCHAR AS identifier, r_name AS description FROM region")
def code_list(t: Tables):
    return catalogue.search_codes(t.region.select(F.col("r_regionkey").cast("string").alias("identifier"), F.col("r_name").alias("description")))


def tools(t: Tables):
    """Parts read as tool records, in key order."""
    return t.part.select(
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") == 7, " ").otherwise(F.col("p_brand")).alias("desc"),
        F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("tool_id"),
        F.lit("vector").alias("server"), F.when(F.col("p_size") != 9, F.col("p_size") > 40).alias("hidden"),
    )


TOOLS = """
  tools AS (SELECT p_partkey AS pos, p_name AS name, p_type AS category, CASE WHEN p_size = 7 THEN ' ' ELSE p_brand END AS desc_,
                   p_brand || '-' || p_size AS tool_id, CASE WHEN p_size <> 9 THEN p_size > 40 END AS hidden FROM part)"""


@query("WITH" + TOOLS + " SELECT pos, name, category FROM tools WHERE NOT hidden AND category IN ('ECONOMY', 'SMALL') AND contains(lower(name), 'ri')")
def tool_filter(t: Tables):
    return catalogue.filter_tools(tools(t), ["ECONOMY", "SMALL"], "RI").select("pos", "name", "category")


@query("WITH" + TOOLS + """
  SELECT pos, tool_id, CASE WHEN trim(desc_) = '' THEN 'required field missing' WHEN hidden IS NULL THEN 'hidden must be a boolean'
         WHEN pos > min(pos) OVER (PARTITION BY tool_id) THEN 'duplicate id' END AS error FROM tools""")
def tool_validation(t: Tables):
    return catalogue.validate_tools(tools(t)).select("pos", "tool_id", "error")


@query("WITH" + TOOLS + " SELECT category, min(pos) AS first_pos FROM tools GROUP BY category")
def tool_categories(t: Tables):
    return catalogue.distinct_categories(tools(t))


@query()
def tools_by_name(t: Tables):
    """Norwegian alphabetical order of all tool names."""
    return catalogue.sort_by_name(tools(t)).select("name", "tool_id")


HINT_WORDS = ["the", "of", "and", "in", "on", "that", "it", "is", "de", "la", "le", "der", "die", "und"]


@query(f"""
  WITH w AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS h, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM conversations),
  k AS (SELECT conv_id, turn, trim(h) AS h, min(i) AS i FROM w WHERE trim(h) IN ({', '.join(repr(x) for x in HINT_WORDS)}) GROUP BY ALL),
  top AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) <= 10),
  j AS (SELECT conv_id, turn, string_agg(h, ',' ORDER BY i) AS hints FROM top GROUP BY conv_id, turn)
  SELECT c.conv_id, c.turn, coalesce(hints, '') AS hints FROM conversations c LEFT JOIN j USING (conv_id, turn)""")
def known_tool_hints(t: Tables):
    hints = catalogue.known_hints(F.split(F.lower("text"), " "), HINT_WORDS)
    return t.conversations.select("conv_id", "turn", F.array_join(hints, ",").alias("hints"))


@query("WITH" + TOOLS + """
  SELECT l_orderkey, l_linenumber, l_partkey, coalesce(n.name, hint) AS name FROM (SELECT *, 'Brand#' || (l_partkey % 30) || '-' || (l_quantity::BIGINT) AS hint FROM lineitem)
  LEFT JOIN (SELECT tool_id, arg_min(name, pos) AS name FROM tools GROUP BY tool_id) n ON n.tool_id = hint""")
def hint_display_names(t: Tables):
    hint = F.concat(F.lit("Brand#"), (F.col("l_partkey") % 30).cast("string"), F.lit("-"), F.col("l_quantity").cast("bigint").cast("string"))
    return catalogue.hint_names(t.lineitem.withColumn("hint", hint), tools(t)).select("l_orderkey", "l_linenumber", "l_partkey", "name")


@query(with_tables("layers").rstrip() + "," + STORED + "," + INCOMING + """,
  prev AS (SELECT chat_id, layer_id, min(seq) AS pos FROM incoming GROUP BY chat_id, layer_id),
  avail AS (SELECT chat_id, layer_id, epoch(created_at)::BIGINT AS pos FROM stored WHERE geojson IS NOT NULL)
  SELECT chat_id, layer_id, 0 AS part, pos FROM prev WHERE EXISTS (SELECT 1 FROM avail a WHERE a.chat_id = prev.chat_id AND a.layer_id = prev.layer_id)
  UNION ALL SELECT chat_id, layer_id, 1, pos FROM avail WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.chat_id = avail.chat_id AND p.layer_id = avail.layer_id)""")
def selection_sync(t: Tables):
    prev = incoming_layers(t).groupBy("chat_id", "layer_id").agg(F.min("seq").alias("pos"))
    avail = stored_layers(t).filter("geojson IS NOT NULL").select("chat_id", "layer_id", F.unix_timestamp("created_at").alias("pos"))
    return catalogue.sync_selection(prev, avail, ["chat_id", "layer_id"])


@query("SELECT o_custkey, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS spent FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice)::DECIMAL(18,2) DESC, o_custkey LIMIT 200")
def capped_adhoc_query(t: Tables):
    sql = "SELECT o_custkey, cast(cast(sum(o_totalprice) AS decimal(18,2)) AS double) AS spent FROM {o} GROUP BY o_custkey ORDER BY spent DESC, o_custkey"
    return catalogue.capped_query(t.spark, sql, o=t.orders)


@query("SELECT n_name AS table_name, n_regionkey AS ordinal, n_nationkey::VARCHAR AS column_name FROM nation")
def ordered_overview(t: Tables):
    """Rows ordered by table name and position."""
    rows = t.nation.select(F.col("n_name").alias("table_name"), F.col("n_regionkey").alias("ordinal"), F.col("n_nationkey").cast("string").alias("column_name"))
    return rows.orderBy("table_name", "ordinal")


@query()
def demo_peek(t: Tables):
    return catalogue.peek(t.documents)


@query(with_tables("blobs").rstrip() + """,
  now_listed AS (SELECT name, last_modified, length(file_hash) + length(name) % 3 AS length FROM blobs WHERE length(name) % 11 <> 0),
  before AS (SELECT name, CASE WHEN length(name) % 5 = 0 THEN last_modified + INTERVAL 1 HOUR ELSE last_modified END AS last_modified, length(file_hash) + name_tail % 3 AS length
             FROM (SELECT *, CASE WHEN name LIKE '%7.pdf' THEN length(name) + 1 ELSE length(name) END AS name_tail FROM blobs WHERE name NOT LIKE 'web/%'))
  SELECT name, CASE WHEN b.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'removed'
                    WHEN n.last_modified IS NOT DISTINCT FROM b.last_modified AND n.length IS NOT DISTINCT FROM b.length THEN 'same' ELSE 'changed' END AS change
  FROM now_listed n FULL JOIN before b USING (name)""")
def listing_changes(t: Tables):
    """A listing of the store against the one remembered: times that went back, other lengths, new and removed files."""
    n = F.length("name")
    size = lambda k: (F.length("file_hash") + k % 3).cast("bigint").alias("length")
    found = t.blobs.where(n % 11 != 0).select("name", "last_modified", size(n))
    tail = F.when(F.col("name").endswith("7.pdf"), n + 1).otherwise(n)
    time = F.when(n % 5 == 0, F.col("last_modified") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("last_modified"))
    state = t.blobs.where(~F.col("name").startswith("web/")).select("name", time.alias("last_modified"), size(tail))
    return files.changes(found, state).select("name", "change")


@query("""
  SELECT 'first' AS writer, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'second', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 2 = 1""")
def versioned_writes(t: Tables):
    """Two writers that began from the same state: each has a version of its own, and neither loses its rows."""
    from uuid import uuid4

    table = f"{checkpoint_root(t.spark)}/versions-{uuid4().hex}"
    own = {name: files.write_version(t.documents.where(F.col("doc_id") % 2 == odd), table) for name, odd in (("first", 0), ("second", 1))}
    parts = [files.read_version(t.spark, table, v).agg(F.lit(name).alias("writer"), F.count("*").alias("rows"), F.sum("doc_id").alias("ids")) for name, v in own.items()]
    return parts[0].unionByName(parts[1]).select("writer", "rows", "ids")
