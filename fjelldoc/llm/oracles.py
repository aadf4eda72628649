"""DuckDB text of the training-data queries that plain SQL can express."""

TOP_K = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS query_id, b.r AS other, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SEARCH = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), totals AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM texts WHERE len(terms) > 0
), sized AS (
  SELECT r, doc_id, 75 + (25 * len(terms) * docs) // words AS m FROM texts, totals WHERE len(terms) > 0
), counted AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) GROUP BY r, term
), weighed AS (
  SELECT term, floor(1000 * ln((2.0 * (SELECT docs FROM totals) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted GROUP BY term
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term
), scored AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM wanted JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (r)
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def _edge(letter: str, cost: str, path: str) -> str:
    """A weight in text is eight digits of cost and the initials."""
    return f"lpad((substr({path}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || '{letter}' || substr({path}, 9)"


def _row(state: str, keep: dict[str, str]) -> str:
    """The least weight before a message, in one state; keep: the state that an initial leads to."""
    cut = "CASE WHEN fault = 'cut' THEN 3 ELSE 0 END"
    options = [_edge("D", "4", state)]
    for initial, to in keep.items():
        options.append(f"CASE WHEN fault IN ('cut', 'fine') AND initial = '{initial}' THEN {_edge('K', cut, to)} END")
        if initial != "s":
            options.append(f"CASE WHEN fault IN ('cut', 'fine') THEN {_edge('R', '3 + ' + cut, to)} END")
    return f"least({', '.join(options)})"


_INSERT_U, _INSERT_A = _edge("I", "3", "wu"), _edge("I", "3", "wa")
_INSERT_UA = _edge("I", "3", f"({_INSERT_A})")

REPAIR = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(t[((xor(c, b) & 255) + 1)::INTEGER], c >> 8))) % 20 AS code
  FROM conversations, crc_table
), changed AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, code,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded WHERE code <> 0
), copied AS (
  SELECT *, 0 AS copy FROM changed UNION ALL SELECT *, 1 FROM changed WHERE code = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM copied
), judged AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 'cut' ELSE 'fine' END AS fault
  FROM placed
), facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'cut') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), paths AS (
  SELECT conv_id, n + 1 AS i, '00000000' AS v0, '00000006II' AS vs, '00000003I' AS vu, '00000000' AS va FROM facts
  UNION ALL
  SELECT conv_id, i, least(w0, {_INSERT_U}, {_INSERT_UA}), least(ws, {_INSERT_U}, {_INSERT_UA}), least(wu, {_INSERT_A}), least(wa, {_INSERT_U})
  FROM (
    SELECT p.conv_id, j.i, {_row("v0", {"s": "vs", "u": "vu"})} AS w0, {_row("vs", {"u": "vu"})} AS ws, {_row("vu", {"a": "va"})} AS wu, {_row("va", {"u": "vu"})} AS wa
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i - 1
  )
), solved AS (
  SELECT conv_id, substr(v0, 1, 8)::BIGINT AS cost, substr(v0, 9) AS audit FROM paths WHERE i = 1
), letters AS (
  SELECT conv_id, audit, k, substr(audit, k::INTEGER, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM solved)
), counted AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w - 1 AS made, len(replace(audit, 'D', '')) % 2 AS odd
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), results AS (
  SELECT c.conv_id, k, CASE WHEN edit = 'K' THEN role WHEN (made - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line
  FROM counted c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id AND j.i = c.i WHERE edit <> 'D'
), lines AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM results GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""
