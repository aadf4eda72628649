"""Structure-aware chunking of block tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fjelldoc.functions import headings as hd
from fjelldoc.operators import chunking
from fjelldoc.plans.registry import query
from fjelldoc.sources.tables import Tables, with_tables

BODY = """
  sizes AS (SELECT doc_id, round_even(font_size, 0) AS size, count(*) AS n, min(block_ix) AS f FROM blocks WHERE font_size > 0 GROUP BY 1, 2),
  body AS (SELECT doc_id, size AS body_size FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""


@query(with_tables("blocks").rstrip() + "," + BODY + " SELECT doc_id, body_size FROM body")
def body_font_sizes(t: Tables):
    return chunking.body_font_size(t.blocks)


_KW = " OR ".join(f"(starts_with(lower(clean), '{k}') AND length(clean) < {len(k) + 40})" for k in hd.SECTION_KEYWORDS)
_NUM = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,3})\s+(.+)"
MARKED = BODY + rf""",
  cleaned AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM blocks LEFT JOIN body USING (doc_id)),
  flagged AS (SELECT *, regexp_extract(clean, '{_NUM}', 1) AS num,
     length(clean) >= 2 AND NOT regexp_matches(clean, '^-?\s*\d{{1,3}}\s*-?$')
       AND (regexp_matches(clean, '{_NUM}') OR font_size >= greatest(13e0, coalesce(body_size, 11) * 1.2e0) OR (is_bold AND length(clean) <= 120) OR {_KW}) AS heading
     FROM cleaned),
  marked AS (SELECT doc_id, block_ix, page, clean, heading, CASE WHEN heading THEN num END AS number,
     CASE WHEN heading THEN CASE WHEN num <> '' THEN trim(regexp_extract(clean, '{_NUM}', 2)) ELSE clean END END AS title,
     CASE WHEN heading THEN CASE WHEN num = '' THEN 1 ELSE length(num) - length(replace(num, '.', '')) + 1 END END AS depth FROM flagged)"""


@query(with_tables("blocks").rstrip() + "," + MARKED + " SELECT doc_id, block_ix, heading, number, title, depth::INTEGER AS depth FROM marked")
def heading_blocks(t: Tables):
    return chunking.mark_headings(t.blocks).select("doc_id", "block_ix", "heading", "number", "title", "depth")


SECTIONS = MARKED + """,
  placed AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY doc_id ORDER BY block_ix) AS section FROM marked),
  secs AS (SELECT doc_id, section, max(clean) FILTER (heading) AS heading_text, coalesce(max(number) FILTER (heading), '') AS number,
     coalesce(max(title) FILTER (heading), 'Preamble') AS title, coalesce(max(depth) FILTER (heading), 0) AS depth,
     coalesce(string_agg(clean, chr(10) || chr(10) ORDER BY block_ix) FILTER (NOT heading AND clean <> ''), '') AS body,
     arg_min(page, block_ix) AS page_start, coalesce(arg_max(page, block_ix) FILTER (NOT heading AND clean <> ''), arg_min(page, block_ix)) AS page_end
     FROM placed GROUP BY doc_id, section),
  sections AS (SELECT *, sum((number <> '' OR title NOT IN ('Preamble', ''))::INTEGER) OVER (PARTITION BY doc_id) AS named_sections,
     number <> '' OR title NOT IN ('Preamble', '') AS named FROM secs)"""


@query(with_tables("blocks").rstrip() + "," + SECTIONS + """
  SELECT doc_id, section::BIGINT AS section, title, depth::INTEGER AS depth, body, page_start, page_end, named_sections::BIGINT AS named_sections FROM sections""")
def document_sections(t: Tables):
    return chunking.detect_sections(t.blocks).select(
        "doc_id", "section", "title", "depth", "body", "page_start", "page_end", "named_sections"
    )


_TOPICS = " ".join(
    "WHEN " + " OR ".join(f"contains(hay, '{k}')" for k in keys) + f" THEN '{topic}'" for topic, keys in hd.TOPIC_RULES
)
PATHS = SECTIONS + """,
  labelled AS (SELECT *, CASE WHEN number <> '' THEN number || ' ' || title ELSE title END AS label FROM sections),
  ancestors AS (SELECT s.doc_id, s.section, a.depth AS d, a.label, a.section AS asec FROM labelled s JOIN labelled a
     ON a.doc_id = s.doc_id AND a.section < s.section AND a.named AND (NOT s.named OR a.depth < s.depth)
     WHERE NOT EXISTS (SELECT 1 FROM labelled b WHERE b.doc_id = s.doc_id AND b.named AND b.section > a.section AND b.section < s.section AND b.depth <= a.depth)),
  trails AS (SELECT doc_id, section, string_agg(label, ' > ' ORDER BY asec) AS trail FROM ancestors GROUP BY doc_id, section),
  paths AS (SELECT l.*, concat_ws(' > ', trail, CASE WHEN named THEN label END) AS heading_path FROM labelled l LEFT JOIN trails USING (doc_id, section))"""


@query(with_tables("blocks").rstrip() + "," + PATHS + rf"""
  SELECT doc_id, section::BIGINT AS section, heading_path, CASE {_TOPICS} ELSE 'other' END AS topic_type,
    nullif(regexp_replace(lower(regexp_extract(heading_path, '(?i)\b(nullalternativ|alternativ\s*\d+[a-z]?|alternativ\s*[a-z])', 1)), '\s+', ' ', 'g'), '') AS alternative,
    nullif(regexp_extract(heading_path, '(?:^|[^\p{{L}}\p{{N}}_])([NØSV][A-ZÆØÅ]?[A-ZÆØÅ]?\d{{1,3}}[a-z]?)(?:$|[^\p{{L}}\p{{N}}_])', 1), '') AS delomrade,
    len(list_filter(string_split(body, chr(10)), lambda l: contains(l, chr(9)) OR length(l) - length(replace(l, '|', '')) >= 2)) >= 3 AS contains_table
  FROM (SELECT *, lower(heading_path || ' ' || title) AS hay FROM paths)""")
def heading_paths(t: Tables):
    rich = chunking.with_section_metadata(chunking.with_heading_path(chunking.detect_sections(t.blocks)))
    return rich.select("doc_id", "section", "heading_path", "topic_type", "alternative", "delomrade", "contains_table")


@query(with_tables("blocks") + """
  SELECT doc_id, coalesce(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(10) ORDER BY block_ix) FILTER (trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), '') AS content,
         sum(length(text))::BIGINT AS total_chars FROM blocks GROUP BY doc_id""")
def document_texts(t: Tables):
    return chunking.document_text(t.blocks)


@query()
def document_chunks(t: Tables):
    """All chunks with metadata; checked by invariants and hand-made cases in the tests."""
    return chunking.chunk_documents(t.blocks)


@query()
def chunk_parents(t: Tables):
    return chunking.resolve_parents(chunking.chunk_documents(t.blocks)).select("doc_id", "local_id", "local_parent_id", "error")


@query("""
  SELECT doc_id, i AS window_ix, CASE WHEN n <= 1 THEN 1 ELSE greatest(1, round_even(1 + i * (pages - 1) / (n - 1)::DOUBLE, 0)::INTEGER) END AS page
  FROM (SELECT doc_id, unnest(range(0, n)) AS i, n, 1 + n_chars // 2000 AS pages FROM (SELECT doc_id, n_chars, (length(text) + 899) // 900 AS n FROM documents))""")
def page_estimates(t: Tables):
    n = F.ceil(F.length("text") / 900)
    rows = t.documents.filter(F.length("text") > 0).select(
        "doc_id", n.alias("n"), (F.floor(F.col("n_chars") / 2000) + 1).alias("pages"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("window_ix")
    )
    return rows.select("doc_id", "window_ix", hd.page_estimate(F.col("window_ix"), F.col("n"), F.col("pages")).alias("page"))


@query(r"""
  SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: contains(l, chr(9)) OR length(l) - length(replace(l, '|', '')) >= 2)) >= 3 AS contains_table FROM documents""")
def table_detection(t: Tables):
    return t.documents.select("doc_id", hd.contains_table(F.col("text")).alias("contains_table"))
